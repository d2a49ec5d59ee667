"""Token counts by a digest cache.

A count depends on the normalised text and on the tokenizer alone, so it is stored under the digests of both: SHA-256 of the
text in the normal form that the tokenizer itself starts from, and SHA-256 of the tokenizer's file and of the library's
version. Counts are looked up by a join; of the texts whose digest is not stored yet each distinct one is encoded once, and
its count is appended to the cache. A later run over the same or a grown corpus encodes only what is new, another tokenizer
starts anew beside the old counts.

Of copies one text per input partition travels (partial aggregation), and rows whose digests lie in a range that many rows
share are salted before the counts are joined back, so a text that a third of all rows hold meets in no single task.

A null text counts as empty; repeated rows get a row each. Texts are encoded whole, whatever their length. Columns other
than doc_id and text are not looked at. An empty table gives no rows. Two jobs that append the same digests at once leave
equal counts twice, of which one is read.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import cache as once

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrose.llm.common import map_arrow, text_chunks, written
from windrose.llm.packing import encoder

TOKEN_LIMIT = 2048
#: Bytes of text that one call of the tokenizer takes; a longer text is a call by itself.
CALL_BYTES = 1 << 20
#: Digests are told apart by their first 4 digits; ranges of more than this share of the rows are dealt over so many salts.
HOT_DIGITS, HOT_SHARE, SALTS = 4, 512, 64
CACHE_SCHEMA = "digest binary, n_tokens bigint, tokenizer string"


def tokenizer_digest(path: str) -> str:
    """SHA-256 over the library, its version and the vocabulary file."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        return "sha256-" + hashlib.sha256(f"{library.__name__} {library.__version__}\n".encode() + f.read()).hexdigest()


def _declared(path: str) -> dict:
    if path.endswith(".model"):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _collapses(declared: dict) -> bool:
    """Whether the tokenizer's own normaliser replaces every run of white space by one space."""
    normalizer = declared.get("normalizer") or {}
    return {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "} in (normalizer.get("normalizers") or [normalizer])


def _drops_space(declared: dict) -> bool:
    """Whether it then only keeps the matches of a pattern that has no white space, so that words are encoded one by one."""
    first = declared.get("pre_tokenizer") or {}
    first = (first.get("pretokenizers") or [first])[0]
    pattern = (first.get("pattern") or {}).get("Regex", r"\s")
    return _collapses(declared) and first.get("behavior") == "Removed" and first.get("invert") is True and r"\s" not in pattern.replace(r"[^\s", "") and " " not in pattern


def normal_form(path: str, text: Column) -> Column:
    """The text with what the tokenizer's own normaliser makes equal made equal: runs of ASCII white space, where it
    replaces every run by one space. Whatever else a tokenizer does to a text is left to it."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.regexp_replace(text, "[\\t-\\r ]+", " ") if _collapses(_declared(path)) else text


@once
def _counter(path: str):  # noqa: ANN202
    """Texts to token counts; one per worker. Where words are encoded one by one, each distinct word of a call is, once."""
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts)]
    if _drops_space(_declared(path)):
        return lambda texts: [len(ids) for ids in encoder(path).encode([t.encode() for t in texts])]
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(e.ids) for e in model.encode_batch_fast(texts, add_special_tokens=False)]


def encoded(texts: DataFrame, path: str, name: str) -> DataFrame:
    """digest, n_tokens and tokenizer of ``texts`` (digest, text)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, _, _ in text_chunks(batch, "text", CALL_BYTES):
            counts = _counter(path)(batch.column("text")[lo:hi].to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("digest")[lo:hi], pa.array(counts, pa.int64()), pa.array([name] * (hi - lo), pa.string())], names=["digest", "n_tokens", "tokenizer"])

    return map_arrow(texts.select("digest", "text"), run, CACHE_SCHEMA)


class TokenCache:
    """Stored counts at ``path``, a folder that the driver and all executors reach."""

    def __init__(self, docs: DataFrame, path: str, tokenizer: str) -> None:
        self.docs, self.path, self.tokenizer, self.name = docs, path, tokenizer, tokenizer_digest(tokenizer)

    def stored(self) -> DataFrame:
        """digest and n_tokens of this tokenizer."""
        spark = self.docs.sparkSession
        try:
            rows = spark.read.schema(CACHE_SCHEMA).parquet(self.path)
            return rows.filter(F.col("tokenizer") == self.name).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], "digest binary, n_tokens bigint")

    def keyed(self, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        """doc_id, text in its normal form, size and digest of every row."""
        normal = normal_form(self.tokenizer, F.col(text))
        size = F.octet_length(F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("bigint")
        return self.docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), size.alias("n_bytes"), normal.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))

    def misses(self) -> DataFrame:
        """digest and text, once for each distinct text that is not stored."""
        return self.keyed().groupBy("digest").agg(F.first("text").alias("text")).join(self.stored(), "digest", "left_anti")

    def fill(self) -> None:
        """Encode the misses and append their counts."""
        encoded(self.misses(), self.tokenizer, self.name).write.mode("append").partitionBy("tokenizer").parquet(self.path)

    def counted(self, limit: int = TOKEN_LIMIT) -> DataFrame:
        """Every row with its count; the cache must be filled."""
        rows = written(self.keyed().select("doc_id", "n_bytes", "digest"), "digests")
        place = F.substring(F.hex("digest"), 1, HOT_DIGITS)
        sizes = rows.groupBy(place.alias("place")).agg(F.count("*").alias("n"))
        total = rows.count()
        #: At most HOT_SHARE of them.
        hot = [r.place for r in sizes.filter(F.col("n") * HOT_SHARE > total).select("place").collect()]
        salted = place.isin(hot) if hot else F.lit(False)
        left = rows.withColumn("salt", F.when(salted, F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
        right = self.stored().withColumn("salt", F.explode(F.when(salted, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        return left.join(right, ["digest", "salt"]).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def count_tokens(docs: DataFrame, tokenizer: str, path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row, by way of the cache at ``path``."""
    cache = TokenCache(docs, path, tokenizer)
    cache.fill()
    return cache.counted(limit)
