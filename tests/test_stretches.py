"""Range sums and windows in stretches against plain versions, with nulls, ties and gaps."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windrose.functions.times import HOUR, MINUTE
from windrose.operators import history, impute, stretches, temporal

START = datetime(2024, 1, 1)
SCHEMA = "id bigint, k string, ts timestamp_ntz, v double, n bigint"


def rows(spark: SparkSession, seed: int, n: int) -> DataFrame:
    rng = random.Random(seed)
    at = lambda: None if rng.random() < 0.05 else START + timedelta(minutes=rng.choice([rng.randrange(300), rng.randrange(20_000)]))
    return spark.createDataFrame([(i, rng.choice(["a", "a", "b", None]), at(), None if rng.random() < 0.7 else rng.random(), rng.randrange(5)) for i in range(n)], SCHEMA)


def test_range_sums_equal_all_pairs(spark: SparkSession) -> None:
    probes, events = rows(spark, 1, 400), rows(spark, 2, 600)
    spans = [(-30 * MINUTE, 30 * MINUTE), (-60 * MINUTE, -1), (0, 0), (5 * MINUTE, 9 * HOUR)]
    ranges = [temporal.Range(events, "ts", low, high, {f"c{i}": F.lit(1), f"s{i}": F.col("n")}) for i, (low, high) in enumerate(spans)]
    got = temporal.all_range_sums(probes, ["k"], "ts", ranges).orderBy("id").collect()
    told = [e for e in events.collect() if e.ts and e.k]
    for r in got:
        for i, (low, high) in enumerate(spans):
            seen = [e.n for e in told if r.ts and e.k == r.k and low <= (e.ts - r.ts) / timedelta(microseconds=1) <= high]
            assert (r[f"c{i}"], r[f"s{i}"]) == (len(seen), sum(seen))
    assert len(got) == 400


def test_dense_ranges_take_time_in_proportion(spark: SparkSession) -> None:
    """All events of one key and hour: each probe's range holds them all, yet no frame slides over them."""
    df = spark.range(40_000).select("id", F.lit("a").alias("k"), F.timestamp_add("MICROSECOND", F.col("id") * 1000, F.lit(START).cast("timestamp_ntz")).alias("ts"))
    out = temporal.range_sums(df, df, ["k"], "ts", "ts", -HOUR, HOUR, {"c": F.lit(1)})
    assert "specifiedwindowframe(rangeframe" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert out.agg(F.min("c"), F.max("c")).first() == (40_000, 40_000)


@pytest.mark.parametrize("bucket", [10 * MINUTE, 50 * HOUR])
def test_stretches_equal_whole_keys(spark: SparkSession, bucket: int) -> None:
    df = rows(spark, 3, 500).withColumn("known", F.col("ts") + F.expr("make_dt_interval(0, 0, n * 40)"))
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    for n in (1, 3):
        plain, cut = (history.safe_lags(df, ["k"], "ts", "known", "id", "n", n, bucket=b).selectExpr("id", "lag_1", f"lag_{n}", "round(rolling_mean, 9)", "known_mean") for b in (None, bucket))
        assert same(plain, cut)
    frames = {"a": ("sum", "n", 4), "b": ("max", "v", 3), "c": ("diff", "n", 5), "d": ("lag", "v", 2)}
    assert same(*(history.rolling(df, ["k"], ["ts", "id"], frames, bucket=b) for b in (None, bucket)))
    assert same(*(history.changed_within(df, ["k"], "ts", "id", "n", HOUR, bucket=b) for b in (None, bucket)))
    assert same(*(impute.filled_both_ways(df, ["k"], ["ts", "id"], "v", "f", b) for b in (None, bucket)))
    assert same(*(impute.interpolated(df, ["k"], ["ts", "id"], "v", "f", b).withColumn("f", F.round("f", 9)) for b in (None, bucket)))


def test_fills_equal_a_plain_window(spark: SparkSession) -> None:
    df = rows(spark, 4, 300)
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = df.withColumn("f", F.coalesce(F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing))))
    got = impute.filled_both_ways(df, ["k"], ["ts", "id"], "v", "f", HOUR)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_keys_go_to_many_tasks(spark: SparkSession) -> None:
    df = rows(spark, 5, 2000).filter("k = 'a' AND ts IS NOT NULL")
    parts = stretches.with_halo(df, ["k"], ["ts", "id"], HOUR, 2, ["v"])
    assert parts.repartition(16, "k", "_stretch").select(F.spark_partition_id().alias("p")).distinct().count() > 3
    assert parts.filter("NOT _halo").count() == df.count()


def test_empty_tables(spark: SparkSession) -> None:
    none = spark.createDataFrame([], SCHEMA)
    assert temporal.range_sums(none, none, ["k"], "ts", "ts", -1, 1, {"c": F.lit(1)}).count() == 0
    assert impute.interpolated(none, ["k"], ["ts", "id"], "v", "f", HOUR).count() == 0
    assert history.rolling(none, ["k"], ["ts", "id"], {"a": ("sum", "n", 4)}, bucket=HOUR).count() == 0


def test_range_sums_cut_within_keys_equal_all_pairs(spark: SparkSession) -> None:
    """Stretches of few points, many rows of one time, two kinds of events, probes far outside, and gaps without events."""
    probes, events, others = rows(spark, 6, 300), rows(spark, 7, 500), rows(spark, 8, 200)
    hot = spark.range(200).select((F.col("id") + 1000).alias("id"), F.lit("a").alias("k"), F.lit(START + timedelta(minutes=77)).cast("timestamp_ntz").alias("ts"), F.lit(0.5).alias("v"), F.lit(3).cast("bigint").alias("n"))
    far = hot.limit(5).withColumn("ts", F.col("ts") + F.expr("INTERVAL 90 DAYS"))
    probes, events = probes.unionByName(hot).unionByName(far.withColumn("id", F.col("id") + 1000)), events.unionByName(hot)
    one, spans = F.lit(1), [(events, -30 * MINUTE, 30 * MINUTE), (others, -60 * MINUTE, -1), (events, 0, 0), (events, 5 * MINUTE, 900 * HOUR)]
    ranges = [temporal.Range(e, "ts", low, high, {f"c{i}": one, f"s{i}": F.col("n")}) for i, (e, low, high) in enumerate(spans)]
    out = temporal.all_range_sums(probes, ["k"], "ts", ranges, asked=probes.select("ts", "k"), stretch_rows=20)
    got = out.collect()
    told = {id(e): [x for x in e.collect() if x.ts and x.k] for e in (events, others)}
    for r in got:
        for i, (e, low, high) in enumerate(spans):
            seen = [x.n for x in told[id(e)] if r.ts and x.k == r.k and low <= (x.ts - r.ts) / timedelta(microseconds=1) <= high]
            assert (r[f"c{i}"], r[f"s{i}"]) == (len(seen), sum(seen))
    assert len(got) == probes.count()


def test_a_dense_hour_is_cut_and_carries_no_rows(spark: SparkSession) -> None:
    """One key whose events all lie within a minute: the windows' keys include a stretch at quantiles of time, their rows are narrow."""
    df = spark.range(20_000).select("id", F.lit("a").alias("k"), F.timestamp_add("MICROSECOND", F.col("id") * 1000, F.lit(START).cast("timestamp_ntz")).alias("ts"), F.lit("x" * 50).alias("wide"))
    out = temporal.all_range_sums(df, ["k"], "ts", [temporal.Range(df, "ts", -HOUR, HOUR, {"c": F.lit(1)})], stretch_rows=1000)
    windows = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x]
    assert windows and all("_stretch" in x and "wide" not in x for x in windows)
    assert out.agg(F.min("c"), F.max("c")).first() == (20_000, 20_000)
