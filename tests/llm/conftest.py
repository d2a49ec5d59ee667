"""Documents that every operator has to take: nulls, empty texts, repeated rows, columns with clashing names."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, kept boolean, node string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark: SparkSession) -> DataFrame:
    texts = [None, "", " \n ", "x", "é" * 30, prose(1, 80), prose(1, 80), prose(2, 5000)]
    rows = [(i, t, "en" if i % 2 else None, None, None, 1, True, "n") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], (None, prose(3, 70), None, None, None, None, None, None)], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, 0, 0), (5, 1, 0), (5, None, None), (None, 1, 1), (6, 1, 0)], "doc_id bigint, quality int, toxic int")
