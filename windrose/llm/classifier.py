"""Quality classifier by compression: one zstandard dictionary of good and one of bad labelled text.

The score of a text is the difference of its sizes compressed under either dictionary, per byte of text, put through a
monotone calibration. Folds are crc32(doc_id as text) mod 5: rows of fold 0 are held out of everything that is fitted,
folds 1 to 3 train the dictionaries, fold 4 calibrates. Fitting takes a documented sample: of each class at most
``per_class`` labelled documents of at most ``sample_bytes``, in order of a hash of their ids. Every whole text is scored.

Null texts count as empty; an empty text has difference 0 and the calibrated score of that. A null doc_id is in fold 0.
Labels without quality are ignored, of repeated labels the higher counts, of documents that share an id the first text
in order is the one fitted on. Without both classes every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrose.llm.common import map_arrow, text_chunks

DICTIONARY_BYTES, LEVEL = 32 << 10, 3
PER_CLASS, SAMPLE_BYTES = 3000, 64 << 10
THRESHOLD = 0.3
#: Strength, in labelled rows, with which each calibrated step is drawn to the overall share.
PRIOR_ROWS = 2.0


@cache
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_dict_id=False, write_checksum=False)


def difference(text: bytes, good: bytes, bad: bytes) -> float:
    """Bytes saved by the good dictionary over the bad one, per byte of text."""
    return (len(_compressor(bad).compress(text)) - len(_compressor(good).compress(text))) / max(1, len(text))


def _dictionary(texts: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        return b"".join(texts)[:DICTIONARY_BYTES] or b"\0" * 8


def monotone_steps(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing share of y over x: neighbouring violators are pooled."""
    share, steps = y.mean(), []
    for at, value in sorted(zip(x.tolist(), y.tolist(), strict=True)):
        steps.append([at, value, 1])
        while len(steps) > 1 and steps[-2][1] / steps[-2][2] >= steps[-1][1] / steps[-1][2]:
            last = steps.pop()
            steps[-1] = [(steps[-1][0] * steps[-1][2] + last[0] * last[2]) / (steps[-1][2] + last[2]), steps[-1][1] + last[1], steps[-1][2] + last[2]]
    knots = np.array([s[0] for s in steps])
    return knots, np.maximum.accumulate(np.array([(s[1] + PRIOR_ROWS * share) / (s[2] + PRIOR_ROWS) for s in steps]))


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5


class Model:
    """Two dictionaries and the knots of the calibration, or a constant."""

    def __init__(self, good: bytes, bad: bytes, knots: np.ndarray, shares: np.ndarray) -> None:
        self.good, self.bad, self.knots, self.shares = good, bad, knots, shares

    def score(self, text: bytes) -> float:
        if not len(self.knots):
            return float(self.shares[0])
        return float(np.interp(difference(text, self.good, self.bad), self.knots, self.shares))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") > 0).cast("int")).alias("quality"))
    known = known.withColumn("fold", fold()).filter("fold > 0")
    chosen = None
    for quality in (0, 1):
        part = known.filter(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.octet_length("text").between(1, sample_bytes))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "fold", "quality").agg(F.min("text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: r.doc_id)
    train = [[r.text.encode() for r in rows if r.fold != 4 and r.quality == q] for q in (0, 1)]
    held = [(r.text.encode(), r.quality) for r in rows if r.fold == 4]
    if not all(train) or not held:
        share = np.mean([r.quality for r in rows]) if rows else 0.5
        return Model(b"", b"", np.zeros(0), np.array([share]))
    bad, good = map(_dictionary, train)
    return Model(good, bad, *monotone_steps(np.array([difference(t, good, bad) for t, _ in held]), np.array([q for _, q in held], float)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        scores = []
        for _, _, data, offsets in text_chunks(batch, "text"):
            raw = data.tobytes()
            scores += [shared.value.score(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        found = np.array(scores, float)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (fold() == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id bigint, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
