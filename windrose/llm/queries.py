"""The training-data queries and their SQL, by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrose.llm import classifier, decontaminate, html_text, masked_lm, neardup, packing, pii, quality_rules, ranked_search, sharding, spelling, suffix_dedup, token_counts
from windrose.llm.common import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pii_key(spark: SparkSession) -> str:
    """The secret of the session, spark.windrose.pii.key; the synthetic tables need none."""
    return spark.conf.get("spark.windrose.pii.key", "for synthetic tables")


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced(_read(spark, sf_dir, "documents"), pii_key(spark)).select("doc_id", "text", "n_entities")


def op2_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.likelihoods(_read(spark, sf_dir, "documents"))


def op5_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeats(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontaminate.build_index(_read(spark, sf_dir, "documents"))
    return decontaminate.search(index, _read(spark, sf_dir, "benchmark")).drop("n_near", "text_key")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), TOKENIZER)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(spelling.damaged_words(_read(spark, sf_dir, "documents"))))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spark.windrose.token_cache names a cache that is kept; without it the run begins with an empty one of its own."""
    cache = spark.conf.get("spark.windrose.token_cache", None) or f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}"
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), TOKENIZER, cache)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, n_docs = ranked_search.build_index(_read(spark, sf_dir, "documents"))
    return ranked_search.search(index, n_docs, _read(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_pii_surrogates, op2_histogram_sort, op3_quality_rules, op4_masked_lm, op5_probminhash, op6_suffix_dedup, op7_decontamination, op8_packing, op9_quality_classifier, op10_html_text, op11_spelling_variants, op12_token_counts, op13_ranked_search)}


def oracle_sql() -> dict[str, str]:
    return {"op2_histogram_sort": sharding.SQL, "op5_probminhash": neardup.SQL, "op6_suffix_dedup": suffix_dedup.SQL, "op7_decontamination": decontaminate.SQL, "op11_spelling_variants": spelling.SQL, "op13_ranked_search": ranked_search.SQL}
