"""Edge cases of the repair of flights, the turnaround set, readers and writers, and models on small fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrose.functions import rules, times
from windrose.operators import flights as repair
from windrose.operators import learning, turnaround
from windrose.plans.source_queries import folder
from windrose.sources import tables

COLUMNS = "row_id bigint, airport string, mode string, iata string, flight_no string, tail string, scheduled string, actual string, category string, runway string, airline string"


def movements(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(airport, mode, iata, flight, tail, scheduled, actual, category, runway) with clocks of 2026-01-10, or full times."""
    full = lambda t: t if t is None or len(t) > 5 else f"2026-01-10 {t}"
    df = spark.createDataFrame([(i, *r[:5], full(r[5]), full(r[6]), *r[7:], "X") for i, r in enumerate(rows)], COLUMNS)
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("scheduled", "actual")})


def found(df: DataFrame, *columns: str) -> dict[int, tuple]:
    return {r.row_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_clusters_of_records(spark: SparkSession) -> None:
    a = lambda t, day="2026-01-10", flight="VN1", iata="HAN", mode="arrival", airport="SGN": (airport, mode, iata, flight, None, "2026-01-10 09:00", t and f"{day} {t}", "passenger", None)
    rows = [a("10:00"), a("11:00"), a("12:30"), a("15:01"), a("23:50", flight="VN2"), a("00:10", "2026-01-11", "VN2"), a(None, flight="VN3"), a("09:00", flight=None), a("09:00", flight=None)]
    rows += [a("10:00", flight="VN4", iata="SGN"), a("10:08", flight="VN4", iata="SGN"), a("08:00", flight="VN4", iata="HAN", mode="departure"), a("10:00", flight="VN5", iata="SGN"), a("10:20", flight="VN5", iata="SGN"), a("09:00", flight="VN5", iata="HAN", mode="departure"), a("09:30", flight="VN5", iata="HAN", mode="departure")]
    kept = found(repair.deduplicated(movements(spark, rows)), "kept_row")
    assert [kept[i][0] for i in range(len(rows))] == [2, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 13, 14, 15]


def test_returns_and_what_becomes_of_them(spark: SparkSession) -> None:
    rows = [("SGN", "departure", "HAN", "VN1", None, None, "10:00", "passenger", None)]
    rows += [("SGN", "arrival", "SGN", f, None, None, t, c, r) for f, t, c, r in (("VN1", "12:30", "passenger", "25R"), ("VN1", "12:31", "Passenger", "25R"), ("VN9", "12:00", "private", "07L"), ("VN1", "10:00", "cargo", None))]
    rows += [("SGN", "arrival", "HAN", "VN1", None, None, "12:40", "passenger", "25R")]
    out = found(repair.same_origin(repair.oriented(movements(spark, rows))), "action", "is_return", "runway", "iata", "return_gap")
    assert out == {1: ("keep_return_emergency", True, "25L", "SGN", 150.0), 2: ("drop_unmatched_same_origin", False, "25R", "SGN", 151.0), 3: ("keep_noncommercial_same_origin", False, "25R", None, None), 4: ("keep_return_emergency", True, "25L", "SGN", 0.0), 5: (None, False, "25R", "HAN", None)}


def test_swaps_at_the_edges(spark: SparkSession) -> None:
    d = lambda f, t, tail: ("SGN", "departure", "DAD", f, tail, None, t, "passenger", None)
    a = lambda f, t, tail: ("DAD", "arrival", "SGN", f, tail, None, t, "passenger", None)
    rows = [d("A", "10:00", "T1"), a("A", "10:00", "T9"), d("B", "10:00", "T1"), a("B", "16:00", " t1 "), d("C", "10:00", "T1"), a("C", "16:01", "T2"), d("D", "10:00", "T1"), a("D", "11:00", None), a("D", "12:00", "T2"), d("E", "10:00", None), a("E", "11:00", "T2")]
    table = movements(spark, rows)
    out = found(repair.swaps(table), "arr_row", "match_gap", "matched_tail", "is_swapped")
    assert out == {0: (None, None, None, False), 2: (3, 360.0, " t1 ", False), 4: (None, None, None, False), 6: (7, 60.0, "T2", True), 9: (10, 60.0, "T2", False)}
    assert found(repair.with_tails_of_swaps(table), "tail")[7] == ("T1",)
    status = found(repair.match_quality(table), "match_status")
    assert [status[i][0] for i in (0, 1, 2, 4, 5)] == ["matched", "matched", "matched", "dep_without_arrival", "arrival_without_departure"]


def test_runways_are_filled_in_order(spark: SparkSession) -> None:
    rows = [("SGN", "arrival", "HAN", "F", None, None, t, "passenger", r) for t, r in (("10:00", "25R"), ("10:20", None), ("10:40", "07L"), ("12:00", "unknown"), ("10:10", "07L"), (None, None))]
    rows += [("DAD", "arrival", "HAN", "F", None, t, None, "passenger", r) for t, r in (("10:00", "35L"), ("12:00", None), ("14:00", "17R"))]
    out = found(repair.filled_runways(movements(spark, rows)), "runway", "filled_by")
    assert (out[1], out[3], out[5], out[7]) == (("07L", "near"), ("25R", "usual"), ("25R", "usual"), ("17R", "any"))


def test_turnaround_set(spark: SparkSession) -> None:
    rows = [("2026-01-10 12:00", "2026-01-06 12:00", 60), ("2026-01-10 12:00", "2026-01-10 11:30", 60), ("2026-01-10 12:00", None, 60), ("2026-01-10 12:00", "2026-01-10 13:00", 90)]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id bigint, scheduled string, prev_arrival string, standard_turnaround int").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("scheduled", "prev_arrival")}).withColumn("actual", F.col("scheduled"))
    out = found(turnaround.ground_times(table), "is_long_ground", "turnaround_buffer", "turnaround_buffer_model", "turnaround_deficit", "turnaround_slack", "tobt_deficit")
    assert out == {0: (1, 4320, None, 0, 5700, 0.0), 1: (0, 30, 30.0, 30, 0, 30.0), 2: (0, 0, None, 0, 0, 0.0), 3: (0, 0, None, 150, 0, 150.0)}
    assert turnaround.leakage(table).first().violation_count == 1


def test_rules_of_aircraft_and_clocks(spark: SparkSession) -> None:
    row = spark.createDataFrame([("A346", " a359", "AT76", None, "9:05", "25", "x")], "a string, b string, c string, d string, e string, f string, g string")
    got = row.select(*(rules.standard_turnaround(F.col(c)) for c in "abcd"), *(times.clock_minutes(F.col(c)) for c in "efg")).first()
    assert tuple(got) == (60, 90, 35, 60, 545, -1, -1)


def test_readers_and_writers(spark: SparkSession) -> None:
    path = folder(spark)
    tables.write_csv(spark.createDataFrame([], "a string, b int"), path, mark=True)
    assert tables.read_csv(spark, path, ["a", "b"]).count() == 0 and spark.read.option("header", True).csv(path).columns[1] == "b"
    try:
        tables.present(spark, [path, path + "-none"])
    except FileNotFoundError as e:
        assert "-none" in str(e)
    else:
        raise AssertionError
    bad = spark.createDataFrame([('{"hourly": {"time": ["t1", "t2"], "rain": [1.5]}}',), ("no json",)], "body string")
    got = bad.select(F.explode_outer(tables.hourly_rows(F.col("body"), ["rain", "wind"])).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in got] in ([("t1", 1.5, None), ("t2", None, None), (None, None, None)], [(None, None, None)] * 2)


def test_models_beat_the_median(spark: SparkSession) -> None:
    rows = spark.range(400).select((F.col("id") % 7).alias("x"), F.when(F.col("id") % 5 > 0, F.when(F.col("id") % 2 == 0, "u").otherwise("v")).alias("w"), ((F.col("id") % 7) * 20 + F.when(F.col("id") % 2 == 0, 50).otherwise(0)).alias("target"))
    data = learning.as_inputs(rows, ["x"], ["w"], "target")
    out = {(r.features, r.model): r.mae for r in learning.ablation(data, data, {"x": (["x"], []), "both": (["x"], ["w"])}, ["median", "ridge", "forest"]).collect()}
    assert out["both", "ridge"] < out["x", "ridge"] < out["x", "median"] and out["both", "forest"] < out["both", "median"]
    assert learning.available(rows, ["x", "target", "none"], ["target"]) == ["x"]
