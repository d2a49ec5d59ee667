"""Copies on write, streamed appends, the weather source and the annotator on small tables."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from windrose.operators import annotate
from windrose.sources import weather
from windrose.sources.versioned import ConcurrentChange, VersionedTable
from windrose.streaming import append

KIND = StructType([StructField("k", LongType()), StructField("a", StringType()), StructField("b", IntegerType())])


@pytest.fixture
def table(spark: SparkSession, tmp_path: Path) -> VersionedTable:
    out = VersionedTable(spark, str(tmp_path / "t"), KIND)
    out.append(spark.range(40).selectExpr("id AS k", "if(id % 2 = 0, 'x', null) AS a", "int(id) AS b").repartitionByRange(4, "k"))
    return out


def test_only_files_with_changed_rows_are_written_anew(spark: SparkSession, table: VersionedTable) -> None:
    before = table.files()
    update = spark.createDataFrame([(1, "new", None), (2, "new", 2), (2, "a", 9), (None, "none", 0)], KIND)
    version, replaced = table.upsert(update, ["k"])
    assert (version, len(before), len(replaced)) == (2, 4, 1)
    assert len(set(before) & set(table.files())) == 3
    rows = {r.k: (r.a, r.b) for r in table.read().collect()}
    assert len(rows) == 41 and rows[1] == ("new", 1) and rows[2] == ("new", 2) and rows[None] == ("none", 0) and rows[3] == (None, 3)
    assert table.read(1).filter("k = 1").first().a is None
    assert table.upsert(update, ["k"]) == (2, []) and table.versions() == [1, 2]


def test_only_missing_values_are_filled(spark: SparkSession, table: VersionedTable) -> None:
    version, _ = table.upsert(spark.createDataFrame([(0, "y", None), (39, "y", None), (77, "y", None)], KIND), ["k"], only_missing=True, insert=False)
    rows = {r.k: r.a for r in table.read().collect()}
    assert version == 2 and rows[0] == "x" and rows[39] == "y" and 77 not in rows
    assert table.upsert(spark.createDataFrame([], KIND), ["k"]) == (2, [])


def test_two_writers_of_one_version(table: VersionedTable) -> None:
    with pytest.raises(ConcurrentChange):
        table.commit(1, table.files())
    assert table.versions() == [1] and len(table.files()) == 4


def test_an_empty_table(spark: SparkSession, tmp_path: Path) -> None:
    table = VersionedTable(spark, str(tmp_path / "e"), KIND)
    assert table.read().count() == 0 and table.versions() == []
    assert table.upsert(spark.createDataFrame([(1, "a", 1)], KIND), ["k"])[0] == 1 and table.read().count() == 1


def test_a_replayed_batch_adds_nothing(spark: SparkSession, tmp_path: Path) -> None:
    path, keep = str(tmp_path / "sink"), lambda df: df
    first, second = (spark.createDataFrame(rows, "k bigint, v string") for rows in ([(1, "a"), (2, "a"), (2, "a"), (None, "a")], [(2, "b"), (3, "b"), (None, "b")]))
    for batch, number in ((first, 0), (second, 1), (second, 1), (first, 0)):
        append.write_batch(batch, number, path, ["k"], keep)
    assert sorted(((r.k, r.v) for r in append.stored(spark, path).collect()), key=str) == sorted([(1, "a"), (2, "a"), (None, "a"), (3, "b")], key=str)


def test_a_stream_goes_on_where_it_stopped(spark: SparkSession, tmp_path: Path) -> None:
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for lot, first in ((range(10), 0), (range(5, 20), 0), (range(15, 30), 100)):
        spark.createDataFrame([(k,) for k in lot], "k bigint").write.mode("append").parquet(source)
        stream = spark.readStream.schema("k bigint").option("maxFilesPerTrigger", 1).parquet(source)
        # The last run has lost its checkpoint and reads all files again.
        append.append_stream(stream, path, str(tmp_path / f"checkpoint{first}"), ["k"], first=first).awaitTermination()
    assert sorted(r.k for r in append.stored(spark, path).collect()) == list(range(30))


def answer(folder: Path, place: str, month: str, text: str) -> None:
    at = folder / "archive" / f"place={place}" / f"month={month}"
    at.mkdir(parents=True)
    (at / "part-0.json").write_text(text)


def test_weather_is_planned_by_place_and_month(spark: SparkSession, tmp_path: Path) -> None:
    hourly = lambda month: json.dumps({"hourly": {"time": [f"{month}-01T00:00", f"{month}-02T05:00"], "t": [1.5, None], "short": [3.0]}})
    answer(tmp_path, "A", "2023-12", hourly("2023-12"))
    answer(tmp_path, "A", "2024-01", hourly("2024-01"))
    answer(tmp_path, "B", "2024-01", "<html>no</html>")
    answer(tmp_path, "C", "2024-01", '{"error": true}')
    df = weather.hourly(spark, str(tmp_path), "archive", ["A", "B", "C", "missing"], ["t", "short"], "2023-12-02", "2024-02-10")
    assert df.rdd.getNumPartitions() == 12
    assert [(r.airport, str(r.time), r.t, r.short) for r in df.orderBy("time").collect()] == [("A", "2023-12-02 05:00:00", None, None), ("A", "2024-01-01 00:00:00", 1.5, 3.0), ("A", "2024-01-02 05:00:00", None, None)]
    some = df.filter((F.col("airport") == "A") & (F.col("time") > F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))
    assert [str(r.time) for r in some.collect()] == ["2024-01-02 05:00:00"]
    reader = weather.HourlyReader({"path": str(tmp_path), "kind": "archive", "places": "A,B", "measures": "t", "start": "2023-11-30", "end": "2024-02-01"})
    assert [(p.place, p.month) for p in reader.partitions()][:4] == [("A", "2023-11"), ("A", "2023-12"), ("A", "2024-01"), ("A", "2024-02")]
    left = list(reader.pushFilters([weather.EqualTo(("airport",), "B"), weather.LessThan(("time",), __import__("datetime").datetime(2023, 12, 5))]))
    assert len(left) == 1 and [(p.place, p.month) for p in reader.partitions()] == [("B", "2023-11"), ("B", "2023-12")]


def test_answers_in_any_form(spark: SparkSession) -> None:
    texts = ['{"Delay_Code": "CODE_71", "Reason": "r"}', '```json\n{"Delay_Code": "CODE_93", "Reason": "a {b} c"}\n```', 'Sure: {"Delay_Code": " CODE_06 "} ok', "```\n{\"Delay_Code\": \"CODE_81\"}", "none", "", None, '{"Delay_Code": ""}', "{broken", "[1]"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, answer string").withColumn("x", annotate.parsed(F.col("answer"))).orderBy("i").collect()
    assert [r.x.code for r in rows] == ["CODE_71", "CODE_93", "CODE_06", "CODE_81"] + ["CODE_99"] * 6
    assert [r.x.reason for r in rows][:4] == ["r", "a {b} c", None, None]


def test_equal_questions_are_asked_once(spark: SparkSession, tmp_path: Path) -> None:
    log, path = str(tmp_path / "asked"), str(tmp_path / "answers")

    def ask(questions: list[str]) -> list[str]:
        with open(log, "a") as f:
            f.writelines(q + "\n" for q in questions)
        return [json.dumps({"Delay_Code": q.upper(), "Reason": q}) for q in questions]

    def asked() -> list[str]:
        return sorted(Path(log).read_text().split())

    rows = spark.createDataFrame([(i, q) for i, q in enumerate(["a", "b", None] * 200)], "i int, q string").repartition(6)
    out = annotate.annotated(rows, F.col("q"), ask, "m", path, batch=3).collect()
    assert asked() == ["a", "b"] and len(out) == 600 and {(r.q, r.code) for r in out} == {("a", "A"), ("b", "B"), (None, None)}
    more = rows.unionByName(spark.createDataFrame([(7, "c")], rows.schema))
    assert {(r.q, r.code) for r in annotate.annotated(more, F.col("q"), ask, "m", path).collect()} == {("a", "A"), ("b", "B"), ("c", "C"), (None, None)}
    assert asked() == ["a", "b", "c"]


def test_a_failing_annotator_is_asked_again_by_the_next_run(spark: SparkSession, tmp_path: Path) -> None:
    path, rows = str(tmp_path / "answers"), spark.createDataFrame([(1, "a")], "i int, q string")

    def fail(questions: list[str]) -> list[str]:
        raise OSError

    assert annotate.annotated(rows, F.col("q"), fail, "m", path).first().code == "CODE_99"
    assert annotate.annotated(rows, F.col("q"), lambda q: ['{"Delay_Code": "X"}'] * len(q), "m", path).first().code == "X"
