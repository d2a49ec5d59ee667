"""As-of, interval, range and history queries over the event table: users stand for aircraft, purchases for departures,
errors for arrivals, signups for observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrose.functions.times import DAY, HOUR, MINUTE, hour_grid
from windrose.operators import history, temporal
from windrose.registry import oracle_of, register

STRETCH = DAY


def events(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.filter(F.col("event_type").isin(*kinds)) if kinds else df


def _side(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return events(spark, sf_dir, kind).select("event_id", "user_id", "ts", "value")


@register("asof_prev_strict", """
SELECT d.event_id, a.event_id AS prev_id, a.value AS prev_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') d ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') a ON d.user_id = a.user_id AND d.ts > a.ts""")
def asof_prev_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal.asof(_side(spark, sf_dir, "purchase"), _side(spark, sf_dir, "error"), ["user_id"], "ts", "ts", {"event_id": "prev_id", "value": "prev_value"}, strict=True, tie="event_id")
    return out.select("event_id", "prev_id", "prev_value")


@register("asof_inclusive", """
WITH l AS (SELECT event_id, ts, event_id % 3 AS station FROM events WHERE event_type = 'purchase'), r AS (SELECT ts, value, event_id % 3 AS station FROM events WHERE event_type = 'signup')
SELECT l.event_id, r.value AS observed FROM l ASOF LEFT JOIN r ON l.station = r.station AND l.ts >= r.ts""")
def asof_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = (_side(spark, sf_dir, k).withColumn("station", F.col("event_id") % 3) for k in ("purchase", "signup"))
    return temporal.asof(left, right, ["station"], "ts", "ts", {"value": "observed"}, bucket=STRETCH, tie="event_id").select("event_id", "observed")


@register("asof_tolerance_flag", """
SELECT a.event_id, coalesce(date_diff('microsecond', d.ts, a.ts) <= 150 * 60000000::BIGINT, false) AS returned
FROM (SELECT * FROM events WHERE event_type = 'error') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') d ON a.user_id = d.user_id AND a.ts >= d.ts""")
def asof_tolerance_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal.asof(_side(spark, sf_dir, "error"), _side(spark, sf_dir, "purchase"), ["user_id"], "ts", "ts", {"ts": "left_at"})
    gap = F.timestamp_diff("MICROSECOND", F.col("left_at"), F.col("ts"))
    return out.select("event_id", F.coalesce(gap <= 150 * MINUTE, F.lit(False)).alias("returned"))


@register("asof_nearest", """
WITH l AS (SELECT event_id, ts, event_id % 3 AS k FROM events WHERE event_type = 'purchase'), r AS (SELECT event_id AS rid, ts, event_id % 3 AS k FROM events WHERE event_type = 'signup'),
p AS (SELECT l.event_id, l.ts, l.k, r.rid, date_diff('microsecond', r.ts, l.ts) AS g FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.ts >= r.ts),
n AS (SELECT l.event_id, r.rid, date_diff('microsecond', l.ts, r.ts) AS g FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.ts <= r.ts),
b AS (SELECT p.event_id, CASE WHEN n.rid IS NOT NULL AND (p.rid IS NULL OR n.g < p.g) THEN n.rid ELSE p.rid END AS rid, CASE WHEN n.rid IS NOT NULL AND (p.rid IS NULL OR n.g < p.g) THEN n.g ELSE p.g END AS g FROM p JOIN n USING (event_id))
SELECT event_id, CASE WHEN g <= 30 * 60000000::BIGINT THEN rid END AS nearest_id, CASE WHEN g <= 30 * 60000000::BIGINT THEN g END AS gap_us FROM b""")
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = (_side(spark, sf_dir, k).withColumn("station", F.col("event_id") % 3) for k in ("purchase", "signup"))
    out = temporal.nearest(left, right, ["station"], "ts", "ts", {"event_id": "nearest_id"}, tolerance=30 * MINUTE, bucket=STRETCH, tie="event_id")
    return out.select("event_id", "nearest_id", "gap_us")


@register("range_semi_link", """
SELECT event_id FROM events d WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM events a WHERE a.event_type = 'error' AND a.user_id = d.user_id AND a.ts >= d.ts AND a.ts <= d.ts + INTERVAL 150 MINUTE)""")
def range_semi_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.within_after(_side(spark, sf_dir, "purchase"), _side(spark, sf_dir, "error"), ["user_id"], "ts", "ts", 150 * MINUTE).filter("matched").select("event_id")


@register("interval_top1", """
SELECT d.event_id, arg_min(a.value, a.ts) FILTER (WHERE a.value > 20) AS first_large, arg_min(a.event_id, a.ts) AS first_id
FROM (SELECT * FROM events WHERE event_type = 'purchase') d LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') a ON a.user_id = d.user_id AND a.ts > d.ts AND a.ts <= d.ts + INTERVAL 6 HOUR
GROUP BY d.event_id""")
def interval_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = _side(spark, sf_dir, "error").select("user_id", "ts", "event_id", F.when(F.col("value") > 20, F.col("value")).alias("large"))
    out = temporal.first_known_after(_side(spark, sf_dir, "purchase"), right, ["user_id"], "ts", "ts", {"large": "first_large", "event_id": "first_id"}, 6 * HOUR)
    return out.select("event_id", "first_large", "first_id")


@register("interval_anti_reason", """
SELECT event_id, CASE WHEN NOT EXISTS (SELECT 1 FROM events a WHERE a.event_type = 'error' AND a.user_id = d.user_id) THEN 'no_arrival_rows' ELSE 'no_arrival_match' END AS reason
FROM events d WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events a WHERE a.event_type = 'error' AND a.user_id = d.user_id AND a.ts >= d.ts AND a.ts <= d.ts + INTERVAL 6 HOUR)""")
def interval_anti_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = _side(spark, sf_dir, "error")
    open_rows = temporal.within_after(_side(spark, sf_dir, "purchase"), right, ["user_id"], "ts", "ts", 6 * HOUR).filter("NOT matched")
    seen = right.select("user_id").distinct().withColumn("seen", F.lit(True))
    return open_rows.join(seen, "user_id", "left").select("event_id", F.when(F.col("seen").isNull(), "no_arrival_rows").otherwise("no_arrival_match").alias("reason"))


@register("dedup_keep_latest", """
WITH g AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) <= 150 * 60000000::BIGINT THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id, event_type, ts::DATE ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY ts, event_id) AS s FROM g)
SELECT event_id FROM s QUALIFY row_number() OVER (PARTITION BY user_id, event_type, ts::DATE, s ORDER BY ts DESC, event_id) = 1""")
def dedup_keep_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.latest_of_near(events(spark, sf_dir), ["user_id", "event_type"], "ts", 150 * MINUTE, "event_id").select("event_id")


@register("gap_sessions", """
WITH g AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) <= 90 * 60000000::BIGINT THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM g)
SELECT user_id, session, count(*) AS n, min(ts) AS started, max(ts) AS ended FROM s GROUP BY ALL""")
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal.gap_sessions(events(spark, sf_dir), ["user_id"], "ts", 90 * MINUTE, "event_id")
    return out.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


@register("centered_load", """
SELECT event_id, (SELECT count(*) FROM events e WHERE e.event_type = 'error' AND e.event_id % 3 = p.event_id % 3 AND e.ts BETWEEN p.ts - INTERVAL 30 MINUTE AND p.ts + INTERVAL 30 MINUTE) AS load
FROM events p WHERE event_type = 'purchase'""")
def centered_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = (_side(spark, sf_dir, k).withColumn("station", F.col("event_id") % 3) for k in ("purchase", "error"))
    return temporal.range_sums(left, right, ["station"], "ts", "ts", -30 * MINUTE, 30 * MINUTE, {"load": F.lit(1).cast("bigint")}).select("event_id", "load")


@register("trailing_halfopen", """
SELECT event_id, (SELECT count(*) FROM events e WHERE e.event_type = 'error' AND e.event_id % 3 = p.event_id % 3 AND e.ts >= p.ts - INTERVAL 60 MINUTE AND e.ts < p.ts) AS last_hour
FROM events p WHERE event_type = 'purchase'""")
def trailing_halfopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = (_side(spark, sf_dir, k).withColumn("station", F.col("event_id") % 3) for k in ("purchase", "error"))
    return temporal.range_sums(left, right, ["station"], "ts", "ts", -60 * MINUTE, -1, {"last_hour": F.lit(1).cast("bigint")}).select("event_id", "last_hour")


@register("disruption_ratio", """
SELECT p.event_id, round(coalesce(count(e.event_id) FILTER (WHERE e.value > 45)::DOUBLE / nullif(count(e.event_id), 0), 0), 9) AS ratio
FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') e ON e.event_id % 3 = p.event_id % 3 AND e.ts BETWEEN p.ts - INTERVAL 60 MINUTE AND p.ts GROUP BY p.event_id""")
def disruption_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = (_side(spark, sf_dir, k).withColumn("station", F.col("event_id") % 3) for k in ("purchase", "error"))
    out = temporal.range_sums(left, right, ["station"], "ts", "ts", -60 * MINUTE, 0, {"n": F.lit(1).cast("bigint"), "bad": (F.col("value") > 45).cast("bigint")})
    return out.select("event_id", F.round(F.coalesce(F.try_divide(F.col("bad").cast("double"), F.col("n")), F.lit(0.0)), 9).alias("ratio"))


@register("same_key_pressure", """
SELECT event_id, (SELECT count(*) FROM events e WHERE e.user_id = p.user_id AND e.event_type = p.event_type AND e.ts BETWEEN p.ts - INTERVAL 45 MINUTE AND p.ts) AS pressure FROM events p""")
def same_key_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir)
    return temporal.range_sums(df, df, ["user_id", "event_type"], "ts", "ts", -45 * MINUTE, 0, {"pressure": F.lit(1).cast("bigint")}).select("event_id", "pressure")


@register("orientation_majority", """
WITH m AS (SELECT *, value < 30 AS usual, event_id % 3 AS k FROM events WHERE event_type = 'error'),
c AS (SELECT a.event_id, count(*) FILTER (WHERE b.usual) AS u, count(*) AS n FROM m a JOIN m b ON a.k = b.k AND b.ts BETWEEN a.ts - INTERVAL 30 MINUTE AND a.ts + INTERVAL 30 MINUTE GROUP BY 1)
SELECT event_id, CASE WHEN u >= n - u AND u >= 0.6 * n THEN 'default' WHEN n - u > u AND n - u >= 0.6 * n THEN 'reverse' ELSE 'default' END AS orientation FROM c""")
def orientation_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _side(spark, sf_dir, "error").withColumn("station", F.col("event_id") % 3)
    out = temporal.range_sums(df, df, ["station"], "ts", "ts", -30 * MINUTE, 30 * MINUTE, {"n": F.lit(1).cast("bigint"), "u": (F.col("value") < 30).cast("bigint")})
    other = F.col("n") - F.col("u")
    return out.select("event_id", F.when((other > F.col("u")) & (other >= 0.6 * F.col("n")), "reverse").otherwise("default").alias("orientation"))


@register("config_swap", """
SELECT event_id, coalesce(lag(value > 30) OVER w <> (value > 30) AND date_diff('microsecond', lag(ts) OVER w, ts) <= 60 * 60000000::BIGINT, false) AS changed
FROM events WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def config_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _side(spark, sf_dir, "purchase").withColumn("high", F.col("value") > 30)
    return history.changed_within(df, ["user_id"], "ts", "event_id", "high", 60 * MINUTE).select("event_id", "changed")


@register("seq_exclusive_sum", """
SELECT event_id, row_number() OVER w AS sequence, row_number() OVER w = 1 AS is_first,
       round(greatest(coalesce(sum(value - 30) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0), 6) AS accumulated
FROM events WINDOW w AS (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id)""")
def seq_exclusive_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).withColumn("delay", F.col("value") - 30)
    return history.day_sequence(df, ["user_id"], "ts", "event_id", "delay").select("event_id", F.col("sequence").cast("bigint").alias("sequence"), "is_first", F.round("accumulated", 6).alias("accumulated"))


@register("safe_lags", """
WITH e AS (SELECT *, ts + to_microseconds((value * 3600000000 / 10)::BIGINT) AS known FROM events),
l AS (SELECT event_id, CASE WHEN lag(known, 1) OVER w <= ts THEN lag(value, 1) OVER w END AS lag_1, CASE WHEN lag(known, 2) OVER w <= ts THEN lag(value, 2) OVER w END AS lag_2,
      CASE WHEN lag(known, 3) OVER w <= ts THEN lag(value, 3) OVER w END AS lag_3, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS r
      FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, lag_1, lag_2, lag_3, round(r, 6) AS rolling_mean,
       round((coalesce(lag_1, 0) + coalesce(lag_2, 0) + coalesce(lag_3, 0)) / nullif((lag_1 IS NOT NULL)::INT + (lag_2 IS NOT NULL)::INT + (lag_3 IS NOT NULL)::INT, 0), 6) AS known_mean FROM l""")
def safe_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).withColumn("known", F.timestamp_add("MICROSECOND", F.round(F.col("value") * 360000000).cast("bigint"), F.col("ts")))
    out = history.safe_lags(df, ["user_id"], "ts", "known", "event_id", "value")
    return out.select("event_id", "lag_1", "lag_2", "lag_3", F.round("rolling_mean", 6).alias("rolling_mean"), F.round("known_mean", 6).alias("known_mean"))


@register("completed_history", """
WITH e AS (SELECT *, date_trunc('second', ts) + to_seconds((value * 360)::BIGINT) AS done FROM events WHERE event_type = 'purchase'),
j AS (SELECT q.event_id, h.value, row_number() OVER (PARTITION BY q.event_id ORDER BY h.done DESC, h.ts DESC, h.event_id DESC) AS k FROM e q JOIN e h ON h.user_id = q.user_id AND h.done < q.ts AND h.event_id <> q.event_id)
SELECT e.event_id, round(avg(j.value), 6) AS history_mean, CASE WHEN count(*) FILTER (WHERE k <= 10) >= 3 THEN round(stddev_samp(j.value) FILTER (WHERE k <= 10), 6) END AS history_std
FROM e LEFT JOIN j USING (event_id) GROUP BY 1""")
def completed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _side(spark, sf_dir, "purchase")
    done = F.timestamp_add("SECOND", F.round(F.col("value") * 360).cast("bigint"), F.date_trunc("second", "ts").cast("timestamp_ntz"))
    out = history.completed_history(df.withColumn("done", done), ["user_id"], "ts", "done", "event_id", "value")
    return out.select("event_id", F.round("history_mean", 6).alias("history_mean"), F.round("history_std", 6).alias("history_std"))


@register("rolling_rows", """
SELECT event_id, round(sum(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS sum_3, round(sum(value) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS sum_6,
       max(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS max_3, round(value - lag(value, 1) OVER w, 6) AS diff_1, round(value - lag(value, 3) OVER w, 6) AS diff_3
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def rolling_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {"sum_3": ("sum", "value", 3), "sum_6": ("sum", "value", 6), "max_3": ("max", "value", 3), "diff_1": ("diff", "value", 1), "diff_3": ("diff", "value", 3)}
    out = history.rolling(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], frames)
    return out.select("event_id", *(F.round(c, 6).alias(c) for c in frames))


@register("hour_completeness", """
WITH h AS (SELECT event_type, date_trunc('hour', ts) AS h FROM events)
SELECT event_type, min(h) AS first_hour, max(h) AS last_hour, count(DISTINCT h) AS present, date_diff('hour', min(h), max(h)) + 1 AS expected,
       round(100.0 * count(DISTINCT h) / (date_diff('hour', min(h), max(h)) + 1), 6) AS percent FROM h GROUP BY 1""")
def hour_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = events(spark, sf_dir).select("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h"))
    out = hours.groupBy("event_type").agg(F.min("h").alias("first_hour"), F.max("h").alias("last_hour"), F.count_distinct("h").alias("present"))
    expected = F.timestamp_diff("HOUR", F.col("first_hour"), F.col("last_hour")) + 1
    return out.select("*", expected.alias("expected"), F.round(F.col("present") * 100.0 / expected, 6).alias("percent"))


@register("missing_hours", """
WITH b AS (SELECT event_type, min(date_trunc('hour', ts)) AS lo, max(date_trunc('hour', ts)) AS hi FROM events GROUP BY 1),
g AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour FROM b)
SELECT event_type, hour FROM g EXCEPT SELECT event_type, date_trunc('hour', ts) FROM events""")
def missing_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir)
    seen = df.select("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).distinct()
    return hour_grid(df, "event_type", "ts").join(seen, ["event_type", "hour"], "left_anti")


@register("hourly_zero_filled", """
WITH b AS (SELECT event_type, min(date_trunc('hour', ts)) AS lo, max(date_trunc('hour', ts)) AS hi FROM events GROUP BY 1),
g AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour FROM b),
c AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, sum(value) AS v FROM events GROUP BY 1, 2)
SELECT event_type, hour, coalesce(n, 0) AS n, round(coalesce(v, 0), 6) AS total FROM g LEFT JOIN c USING (event_type, hour)""")
def hourly_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir)
    sums = df.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return hour_grid(df, "event_type", "ts").join(sums, ["event_type", "hour"], "left").select("event_type", "hour", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("v", F.lit(0.0)), 6).alias("total"))


def _by_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn("station", F.col("event_id") % 3)


def _registered_by_station(name: str):  # noqa: ANN202
    """The SQL of a query by user, by station."""
    return register(f"{name}_station", oracle_of(name).replace("PARTITION BY user_id", "PARTITION BY event_id % 3"))


@_registered_by_station("safe_lags")
def safe_lags_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.timestamp_add("MICROSECOND", F.round(F.col("value") * 360000000).cast("bigint"), F.col("ts"))
    out = history.safe_lags(_by_station(spark, sf_dir).withColumn("known", known), ["station"], "ts", "known", "event_id", "value", bucket=STRETCH)
    return out.select("event_id", "lag_1", "lag_2", "lag_3", F.round("rolling_mean", 6).alias("rolling_mean"), F.round("known_mean", 6).alias("known_mean"))


@_registered_by_station("config_swap")
def config_swap_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _side(spark, sf_dir, "purchase").select("event_id", "ts", (F.col("event_id") % 3).alias("station"), (F.col("value") > 30).alias("high"))
    return history.changed_within(df, ["station"], "ts", "event_id", "high", 60 * MINUTE, bucket=STRETCH).select("event_id", "changed")


@_registered_by_station("rolling_rows")
def rolling_rows_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {"sum_3": ("sum", "value", 3), "sum_6": ("sum", "value", 6), "max_3": ("max", "value", 3), "diff_1": ("diff", "value", 1), "diff_3": ("diff", "value", 3)}
    out = history.rolling(_by_station(spark, sf_dir), ["station"], ["ts", "event_id"], frames, bucket=STRETCH)
    return out.select("event_id", *(F.round(c, 6).alias(c) for c in frames))
