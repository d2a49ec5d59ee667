"""Every query of the reference's operators gives the rows of its SQL; nothing of the training-data operators is needed."""

from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.sql import SparkSession

from windrose import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value: object) -> object:
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value if value is None or isinstance(value, (int, bool, str)) else str(value)


def rows_of(names: list[str], rows: list) -> list[str]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def duck() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(name: str, spark: SparkSession, duck: duckdb.DuckDBPyConnection) -> None:
    df = registry.queries()[name](spark, SF)
    given = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in given.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, given.fetchall())


def test_entry_runs(spark: SparkSession) -> None:
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
