"""Report tables and matches on small tables with nulls, constants and ties."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import SparkSession

from windrose.operators import matching, profile, tables
from windrose.plans import source_queries
from windrose.sources import tables as files


def test_constants_have_no_correlation(spark: SparkSession) -> None:
    df = spark.createDataFrame([(1.0, 3.0, 2.0, 0), (2.0, 3.0, None, 1), (3.0, 3.0, 1.0, 2)], "a double, c double, n double, risk int")
    got = {(r.a, r.b): r.correlation for r in profile.correlations(df, ["a", "c", "n"]).collect()}
    assert got[("a", "c")] is None and round(got[("a", "n")], 9) == -1
    ranking = {r.column: r for r in tables.predictive_ranking(df, ["a", "c", "n"], "risk").collect()}
    assert round(ranking["a"].correlation, 9) == 1 and ranking["c"].correlation is None and ranking["n"].correlation is None
    assert (ranking["a"].mean_from_2, ranking["n"].mean_from_1, round(ranking["n"].missing_percent, 3)) == (3.0, 1.0, 33.333)


def test_audit_counts_null_as_a_value(spark: SparkSession) -> None:
    df = spark.createDataFrame([(1.0, None), (None, None), (None, None)], "a double, b double")
    rows = {r.column: r for r in tables.feature_audit(df, ["a", "b"]).collect()}
    assert (rows["a"].n_distinct, rows["a"].missing, round(rows["a"].top_percent, 3)) == (2, 2, 66.667)
    assert (rows["b"].n_distinct, rows["b"].lowest, rows["b"].top_percent) == (1, None, 100.0)
    assert tables.feature_audit(df.limit(0), ["a"]).count() == 0


def test_thresholds_by_null_keys(spark: SparkSession) -> None:
    df = spark.createDataFrame([(None, float(i)) for i in range(101)] + [("k", None)], "k string, v double")
    rows = {r.k: r for r in tables.threshold_candidates(df, ["k"], ["v"]).collect()}
    assert (rows[None].p50, rows[None].p99, rows[None].highest) == (50.0, 99.0, 100.0) and rows["k"].p50 is None


def test_legs_by_priority_and_past_midnight(spark: SparkSession) -> None:
    day = datetime.date(2024, 1, 2)
    before = day - datetime.timedelta(days=1)
    legs = [("A", day, "10:00", "10:20", 1), ("A", day, "12:00", "12:05", 2), ("B", before, "23:50", "0:10", 1), ("C", before, "08:00", "08:05", 1), ("D", before, "09:00", "09:10", 1)]
    records = [(1, "A", day, "12:00", "9:99"), (2, "A", day, None, "10:20"), (3, "A", day, "7:00", None), (4, "B", day, None, "0:12"), (5, "C", day, None, "09:30"), (6, "D", day, "09:00", "x"), (7, None, day, None, None), (8, "A", None, "12:00", None)]
    got = matching.best_leg(spark.createDataFrame(records, "id int, f string, day date, std string, atd string"), spark.createDataFrame(legs, "f string, day date, std string, atd string, n int"), ["f"], "id", "day", "std", "atd", "n", ["n"]).collect()
    assert {r.id: (r.n, r.leg_day) for r in got} == {1: (2, day), 2: (1, day), 3: (1, day), 4: (1, before), 5: (None, None), 6: (1, before), 7: (None, None), 8: (None, None)}


def test_first_match_of_a_pattern(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    for name in ("b_2.csv", "b_1.csv"):
        (tmp_path / name).write_text("x\n1\n")
    assert files.first_match(spark, [f"{tmp_path}/b_*.csv"])[0].endswith("b_1.csv")
    try:
        files.first_match(spark, [f"{tmp_path}/c_*.csv"])
    except FileNotFoundError:
        pass
    else:
        raise AssertionError("a pattern without files must be an error")


def test_best_legs_equal_all_pairs(spark: SparkSession) -> None:
    """With unknown clocks, legs of one order, and keys of many legs; legs are grouped before they are joined, so no pairs are made."""
    rng = random.Random(7)
    clock = lambda: rng.choice([None, "none", f"{rng.randrange(4)}:{rng.choice(['00', '30'])}"])
    row = lambda: (rng.choice(["a", "b", None]), datetime.date(2024, 1, rng.randrange(1, 9)), clock(), clock())
    records, legs = [(i, *row()) for i in range(300)], [(*row(), rng.randrange(40)) for _ in range(60)]
    got = matching.best_leg(spark.createDataFrame(records, "id int, f string, day date, std string, atd string"), spark.createDataFrame(legs, "f string, day date, std string, atd string, n int"), ["f"], "id", "day", "std", "atd", "n", ["n"])
    minutes = lambda x: -1 if x is None or ":" not in x else int(x.split(":")[0]) * 60 + int(x.split(":")[1])
    want = {}
    for i, f, day, std, atd in records:
        found = []
        for lf, lday, lstd, latd, n in legs:
            before = (day - lday).days
            if f is not None and lf == f and before in (0, 1):
                rank = 0 if std is not None and lstd == std else 1 if atd is not None and latd == atd else 2
                found.append((before, rank, n, rank < 2 or before == 0 or -1 not in (minutes(lstd), minutes(atd)) and minutes(lstd) > minutes(atd), lday))
        best = min(found, default=None)
        want[i] = (best[2], best[4]) if best and best[3] else (None, None)
    assert {r.id: (r.n, r.leg_day) for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2


def test_files_keep_their_order_however_rows_arrive(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start, i % 3, "error" if i % 2 else "signup", 1.0) for i in range(3000, -1, -1)]
    for part in range(3):
        spark.createDataFrame(rows[part::3], "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = source_queries.first_files_with_rows(spark, str(tmp_path)).collect()
    assert {r.event_id: r.source_row for r in got} == {i: i % 1000 // 2 for i in range(3001)}
