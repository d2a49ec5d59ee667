"""The stages of the pipeline on odd rows, each against what a plain reading of its rule gives."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tests.llm.conftest import prose

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, label string, rank int"


def tables(spark: SparkSession, folder: Path, rows: list[tuple], items: list[tuple]) -> DataFrame:
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "clash", 3) for i, t in rows], SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_stages_on_odd_rows(spark: SparkSession, tmp_path: Path) -> None:
    a, b, item = prose(1, 90), prose(2, 90), prose(3, 20)
    near = " ".join(a.split()[:-1] + ["end"])
    rows = [(1, a), (2, near), (3, b), (3, b), (3, prose(4, 70)), (None, a), (None, prose(5, 60)), (None, prose(5, 60)), (6, None), (7, ""), (8, "too short"), (9, "word " * 200), (10, prose(6, 60) + " " + item), (11, prose(7, 60) + " mail jo.doe@web.org")]
    docs = tables(spark, tmp_path, rows, [(1, item), (2, None)])
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["quality", "near_dedup", "decontamination", "pii", "packing"]

    kept = stages["quality"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(x for x in rows if x[1] and 50 <= len(x[1].split()) and x[0] != 9)
    kept = stages["near_dedup"](spark, kept, str(tmp_path))
    expected = [(1, a), (3, b), (3, rows[4][1]), (None, rows[6][1]), rows[12], rows[13]]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(expected)
    kept = stages["decontamination"](spark, kept, str(tmp_path))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(expected[:4] + expected[5:])
    kept = stages["pii"](spark, kept, str(tmp_path))
    texts = {(r.doc_id, r.n_chars): r.text for r in kept.collect()}
    assert kept.columns == docs.columns and all(n == len(t) for (_, n), t in texts.items()) and not any("jo.doe" in t for t in texts.values())
    packed = stages["packing"](spark, kept, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed) == Counter(i for i, _ in expected if i != 10)


def test_empty_tables(spark: SparkSession, tmp_path: Path) -> None:
    tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
