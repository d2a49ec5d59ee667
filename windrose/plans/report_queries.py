"""Profiles, distributions, grouped measures and report tables over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrose.functions.times import daypart
from windrose.operators import impute, metrics, profile, seasonal, weather
from windrose.plans.temporal_queries import STRETCH, events
from windrose.registry import oracle_of, register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("profile_columns", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(*) AS n_rows, (count(*) - count({c}))::BIGINT AS n_missing, count(DISTINCT {c}) AS n_distinct, min({c}) AS lowest, max({c}) AS highest, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS deviation,
       {', '.join(f'round(quantile_cont({c}, {q}), 6) AS p{round(100 * q):02d}' for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99))} FROM lineitem""" for c in NUMBERS))
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.described(_table(spark, sf_dir, "lineitem"), NUMBERS)
    exact = ("column", "n_rows", "n_missing", "n_distinct", "lowest", "highest")
    return out.select(*exact, *(F.round(c, 4 if c in ("mean", "deviation") else 6).alias(c) for c in out.columns if c not in exact))


@register("daily_rates", """
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS highest, round(median(value), 6) AS mid, round(100.0 * count(*) FILTER (WHERE value > 45) / count(*), 6) AS high_percent FROM events GROUP BY 1""")
def daily_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    sums = df.groupBy("day").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("highest"), F.round(profile.rate(F.col("value") > 45), 6).alias("high_percent"))
    return profile.joined_by(sums, profile.quantiles_of(df, ["day"], "value", [0.5]), ["day"]).select("day", "n", "mean", "highest", F.round("p50", 6).alias("mid"), "high_percent")


@register("monthly_rates", """
SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 6) AS done_percent FROM orders GROUP BY 1""")
def monthly_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(profile.rate(F.col("o_orderstatus") == "F"), 6).alias("done_percent"))


@register("hour_pivot", "SELECT hour(ts)::INTEGER AS hour, " + ", ".join(f"count(*) FILTER (WHERE isodow(ts) = {d + 1}) AS d{d}" for d in range(7)) + " FROM events GROUP BY 1")
def hour_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events(spark, sf_dir).select(F.hour("ts").alias("hour"), F.concat(F.lit("d"), F.weekday("ts")).alias("day")).groupBy("hour").pivot("day", [f"d{d}" for d in range(7)]).count()
    return out.na.fill(0)


@register("daypart_profile", """
SELECT event_type, CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS part, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def daypart_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("event_type", daypart(F.hour("ts")).alias("part")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@register("grouping_sets_metrics", """
WITH d AS (SELECT n_regionkey AS region, month(o_orderdate)::INTEGER AS month, o_totalprice AS y, 150000.0 + 40000 * (o_orderstatus = 'F')::INT AS p FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT region, month, count(*) AS n, round(avg(abs(y - p)), 3) AS mae, round(median(abs(y - p)), 3) AS medae, round(sqrt(avg((y - p) ** 2)), 3) AS rmse, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2
FROM d GROUP BY GROUPING SETS ((region), (month), (region, month), ())""")
def grouping_sets_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (_table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    rows = rows.select(F.col("n_regionkey").alias("region"), F.month("o_orderdate").alias("month"), F.col("o_totalprice").alias("y"), (150000.0 + 40000 * (F.col("o_orderstatus") == "F").cast("int")).alias("p"))
    out = metrics.regression(rows, "y", "p", [["region"], ["month"], ["region", "month"], []])
    return out.select("region", "month", "n", *(F.round(c, 3).alias(c) for c in ("mae", "medae", "rmse")), F.round("r2", 6).alias("r2"))


@register("markov", """
WITH s AS (SELECT event_type AS state, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events)
SELECT state, next, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY state), 9) AS share FROM s WHERE next IS NOT NULL GROUP BY 1, 2""")
def markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.transitions(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "event_type").withColumn("share", F.round("share", 9))


@register("corr_pairs", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS correlation FROM lineitem" for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]))
def corr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.correlations(_table(spark, sf_dir, "lineitem"), NUMBERS).withColumn("correlation", F.round("correlation", 6))


@register("corr_lags", """
WITH l AS (SELECT value, """ + ", ".join(f"lag(value, {k}) OVER w AS l{k}" for k in (1, 2, 3, 4, 6)) + " FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) " + " UNION ALL ".join(f"SELECT {k} AS lag, round(corr(value, l{k}), 6) AS correlation FROM l" for k in (1, 2, 3, 4, 6)))
def corr_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    lags = (1, 2, 3, 4, 6)
    row = events(spark, sf_dir).select("value", *(F.lag("value", k).over(w).alias(f"l{k}") for k in lags)).agg(*(profile.correlation(F.col("value"), F.col(f"l{k}")).alias(f"l{k}") for k in lags))
    return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.round(f"l{k}", 6).alias("correlation")) for k in lags))).alias("x")).select("x.*")


@register("auc_rank", """
WITH r AS (SELECT event_type, value > 45 AS y, s, avg(rn) OVER (PARTITION BY event_type, s) AS rank FROM (SELECT event_type, value, json_extract_string(props, '$.k')::INT AS s, row_number() OVER (PARTITION BY event_type ORDER BY json_extract_string(props, '$.k')::INT) AS rn FROM events))
SELECT event_type, round((sum(rank) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2.0) / (count(*) FILTER (WHERE y) * count(*) FILTER (WHERE NOT y)), 9) AS auc FROM r GROUP BY 1""")
def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_type", (F.col("value") > 45).alias("y"), F.get_json_object("props", "$.k").cast("int").alias("s"))
    return metrics.auc(rows, "y", "s", ["event_type"]).withColumn("auc", F.round("auc", 9))


@register("topk_per_group", """
SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id)::INTEGER AS place FROM events QUALIFY place <= 3""")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_per_group(events(spark, sf_dir), ["event_type"], [F.desc("value"), F.asc("event_id")], 3).select("event_type", "event_id", "value", "place")


@register("share_of_group", """
SELECT c_mktsegment, c_nationkey, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY c_mktsegment), 9) AS share FROM customer GROUP BY 1, 2""")
def share_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
    return profile.share_of_group(counts, ["c_mktsegment"], "n").withColumn("share", F.round("share", 9))


@register("value_counts_share", "SELECT p_brand, p_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM part GROUP BY 1, 2")
def value_counts_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_counts(_table(spark, sf_dir, "part"), ["p_brand", "p_type"]).withColumn("share", F.round("share", 9))


@register("near_zero_var", " UNION ALL ".join(f"""SELECT '{c}' AS "column", round(max(n) / sum(n), 9) AS top_share, max(n) / sum(n) >= 0.1 AS near_constant FROM (SELECT {c}, count(*) AS n FROM lineitem GROUP BY 1)""" for c in NUMBERS))
def near_zero_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.near_constant(_table(spark, sf_dir, "lineitem"), NUMBERS, 0.1).withColumn("top_share", F.round("top_share", 9))


@register("lineage_pivot", """
SELECT event_type, count(*) AS bronze, count(*) FILTER (WHERE value >= 1) AS silver, (count(*) FILTER (WHERE value >= 1) - count(*))::BIGINT AS delta FROM events GROUP BY 1""")
def lineage_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = events(spark, sf_dir)
    layers = raw.select("event_type", F.lit("bronze").alias("layer")).unionByName(raw.filter("value >= 1").select("event_type", F.lit("silver").alias("layer")))
    return layers.groupBy("event_type").pivot("layer", ["bronze", "silver"]).count().na.fill(0).withColumn("delta", F.col("silver") - F.col("bronze"))


@register("fixed_flag", """
SELECT o_custkey, count(DISTINCT o_orderpriority) = 1 AND count(DISTINCT o_orderdate::DATE) > 1 AS is_fixed FROM orders GROUP BY 1""")
def fixed_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(((F.count_distinct("o_orderpriority") == 1) & (F.count_distinct(F.to_date("o_orderdate")) > 1)).alias("is_fixed"))


@register("mean_duration_default", """
SELECT c_custkey, coalesce(floor(avg(date_diff('minute', o_orderdate, l_shipdate)))::BIGINT, 90) AS minutes FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def mean_duration_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    spans = orders.join(items, orders.o_orderkey == items.l_orderkey).groupBy("o_custkey").agg(F.floor(F.avg(F.timestamp_diff("MINUTE", F.col("o_orderdate"), F.col("l_shipdate")))).alias("m"))
    return _table(spark, sf_dir, "customer").join(spans, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("m", F.lit(90)).alias("minutes"))


@register("iqr_clip", """
WITH b AS (SELECT event_type, quantile_cont(least(value, 250), 0.25) AS q1, quantile_cont(least(value, 250), 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_id, round(greatest(least(least(value, 250), q3 + 3 * (q3 - q1)), q1 - 3 * (q3 - q1)), 6) AS clipped FROM events JOIN b USING (event_type)""")
def iqr_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute.clipped_to_usual(events(spark, sf_dir), ["event_type"], "value", "clipped", (0.0, 250.0)).select("event_id", F.round("clipped", 6).alias("clipped"))


@register("outlier_audit", """
WITH b AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_id, value, CASE WHEN value > 250 THEN 'physical' ELSE 'quartile' END AS reason FROM events JOIN b USING (event_type) WHERE value > 250 OR value > q3 + 3 * (q3 - q1) OR value < q1 - 3 * (q3 - q1)""")
def outlier_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute.outliers(events(spark, sf_dir), ["event_type"], "value", ["event_id", "value"], (0.0, 250.0))


@register("ffill_bfill", """
WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (value::INT % 7) END AS code FROM events),
m AS (SELECT code AS m FROM e WHERE code IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT event_id, coalesce(last_value(code IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       first_value(code IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), (SELECT m FROM m)) AS filled FROM e""")
def ffill_bfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("event_id") % 3 != 0, F.bround("value").cast("int") % 7)
    return impute.filled_both_ways(events(spark, sf_dir).withColumn("code", code), ["user_id"], ["ts", "event_id"], "code", "filled").select("event_id", "filled")


@register("linear_interp", """
WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
n AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER p AS pi, last_value(v IGNORE NULLS) OVER p AS pv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER f AS ni, first_value(v IGNORE NULLS) OVER f AS nv FROM e
      WINDOW p AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(coalesce(v, pv + (nv - pv) * (i - pi) / nullif(ni - pi, 0), pv, nv, (SELECT median(v) FROM e)), 6) AS filled FROM n""")
def linear_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).withColumn("v", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    return impute.interpolated(df, ["user_id"], ["ts", "event_id"], "v", "filled").select("event_id", F.round("filled", 6).alias("filled"))


#: Known values on every fourth day only, so that whole stretches lie between them.
GAPS = ("CASE WHEN event_id % 3 = 0 THEN NULL", "CASE WHEN event_id % 3 < 2 OR day(ts) % 4 > 0 THEN NULL")


def _sparse(spark: SparkSession, sf_dir: str, value: Column) -> DataFrame:
    known = (F.col("event_id") % 3 == 2) & (F.dayofmonth("ts") % 4 == 0)
    return events(spark, sf_dir).withColumn("station", F.col("event_id") % 5).withColumn("v", F.when(known, value))


@register("ffill_bfill_station", oracle_of("ffill_bfill").replace("PARTITION BY user_id", "PARTITION BY event_id % 5").replace(*GAPS))
def ffill_bfill_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _sparse(spark, sf_dir, F.bround("value").cast("int") % 7)
    return impute.filled_both_ways(df, ["station"], ["ts", "event_id"], "v", "filled", bucket=STRETCH).select("event_id", "filled")


@register("linear_interp_station", oracle_of("linear_interp").replace("SELECT event_id, user_id, CASE", "SELECT event_id, event_id % 5 AS user_id, CASE").replace("OVER (PARTITION BY user_id ORDER BY ts", "OVER (PARTITION BY event_id % 5 ORDER BY ts").replace(*GAPS))
def linear_interp_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _sparse(spark, sf_dir, F.col("value"))
    return impute.interpolated(df, ["station"], ["ts", "event_id"], "v", "filled", bucket=STRETCH).select("event_id", F.round("filled", 6).alias("filled"))


@register("seasonal_index", """
WITH d AS (SELECT o_orderpriority AS airport, month(o_orderdate)::INTEGER AS month, o_totalprice AS y FROM orders), w AS (SELECT avg(y) AS m FROM d)
SELECT airport, month, count(*) AS n, round(avg(y), 3) AS mean, round(avg(y) / any_value(m), 9) AS "index" FROM d, w GROUP BY 1, 2""")
def seasonal_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("airport"), F.month("o_orderdate").alias("month"), F.col("o_totalprice").alias("y"))
    return profile.seasonal_index(rows, ["airport", "month"], "y").select("airport", "month", "n", F.round("mean", 3).alias("mean"), F.round("index", 9).alias("index"))


@register("weather_trends", """
WITH e AS (SELECT event_id, event_id % 3 AS k, ts, value AS temperature, 1000 - value AS pressure, CASE WHEN event_id % 4 > 0 THEN value / 10 END AS precipitation, value * 0.7 AS wind, value * 0.3 AS crosswind, value * 120 AS visibility, value - 2 AS dew_point FROM events)
SELECT event_id, round(temperature - lag(temperature, 3) OVER w, 6) AS temperature_change_3h, round(pressure - lag(pressure, 3) OVER w, 6) AS pressure_change_3h, round(sum(precipitation) OVER (w ROWS 5 PRECEDING), 6) AS precipitation_6h,
  round(max(wind) OVER (w ROWS 2 PRECEDING), 6) AS gust, round((max(wind) OVER (w ROWS 2 PRECEDING) - wind) / 1.852, 6) AS gust_variation_kt, round(max(crosswind) OVER (w ROWS 2 PRECEDING) / 1.852, 6) AS crosswind_max_3h_kt,
  round(visibility / 1609.344, 6) AS visibility_miles, round(greatest(0, 5000 - visibility), 6) AS visibility_deficit_low, round(greatest(0, 4828.032 - visibility), 6) AS visibility_deficit_3sm, round(temperature - dew_point, 6) AS dew_point_spread
FROM e WINDOW w AS (PARTITION BY k ORDER BY ts, event_id)""")
def weather_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    rows = events(spark, sf_dir).select("event_id", (F.col("event_id") % 3).alias("k"), "ts", v.alias("temperature"), (1000 - v).alias("pressure"), F.when(F.col("event_id") % 4 > 0, v / 10).alias("precipitation"), (v * 0.7).alias("wind"), (v * 0.3).alias("crosswind"), (v * 120).alias("visibility"), (v - 2).alias("dew_point"))
    shown = ["temperature_change_3h", "pressure_change_3h", "precipitation_6h", "gust", "gust_variation_kt", "crosswind_max_3h_kt", "visibility_miles", "visibility_deficit_low", "visibility_deficit_3sm", "dew_point_spread"]
    return weather.trends(rows, ["k"], ["ts", "event_id"], STRETCH).select("event_id", *(F.round(c, 6).alias(c) for c in shown))


@register("fleiss", """
WITH r AS (SELECT doc_id, unnest([quality, toxic, CASE WHEN doc_id % 4 = 0 THEN 1 - quality ELSE quality END]) AS label FROM labels),
c AS (SELECT doc_id, label, count(*) AS n FROM r GROUP BY 1, 2),
o AS (SELECT avg(p) AS observed FROM (SELECT sum(n * (n - 1)) / 6.0 AS p FROM c GROUP BY doc_id)),
e AS (SELECT sum(s * s) / (sum(s) * sum(s)) AS expected FROM (SELECT sum(n)::DOUBLE AS s FROM c GROUP BY label))
SELECT round(observed, 9) AS observed, round(expected, 9) AS expected, round((observed - expected) / (1 - expected), 9) AS kappa FROM o, e""")
def fleiss(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.when(F.col("doc_id") % 4 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    ratings = _table(spark, sf_dir, "labels").select("doc_id", F.explode(F.array(F.col("quality"), F.col("toxic"), third)).alias("label"))
    return metrics.fleiss_kappa(ratings, "doc_id", "label").select(*(F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")))


@register("majority_vote", """
SELECT doc_id, CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b ELSE 'CONFLICT' END AS vote FROM (SELECT doc_id, 'L' || quality AS a, 'L' || (toxic * 2) AS b, 'L' || (doc_id % 3) AS c FROM labels)""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = [F.concat(F.lit("L"), x.cast("string")) for x in (F.col("quality"), F.col("toxic") * 2, F.col("doc_id") % 3)]
    return _table(spark, sf_dir, "labels").select("doc_id", metrics.majority(votes).alias("vote"))


@register("class_report", """
WITH d AS (SELECT quality AS t, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS p FROM labels),
c AS (SELECT l AS label, count(*) FILTER (WHERE t = l) AS support, count(*) FILTER (WHERE p = l) AS called, count(*) FILTER (WHERE t = l AND p = l) AS ok FROM d, (SELECT DISTINCT t AS l FROM d UNION SELECT DISTINCT p FROM d) GROUP BY 1)
SELECT label, support, round(coalesce(ok / nullif(called, 0), 0), 9) AS precision, round(coalesce(ok / nullif(support, 0), 0), 9) AS recall, round(coalesce(2.0 * ok / nullif(called + support, 0), 0), 9) AS f1 FROM c""")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "labels").select(F.col("quality").alias("t"), F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("p"))
    return metrics.class_report(rows, "t", "p").select("label", "support", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@register("acf", """
WITH h AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1), g AS (SELECT unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS h FROM h),
s AS (SELECT h, coalesce(n, 0) AS n FROM g LEFT JOIN h USING (h)), d AS (SELECT row_number() OVER (ORDER BY h) AS i, n - avg(n) OVER () AS d FROM s),
p AS (SELECT k AS lag, sum(a.d * b.d) AS s FROM d a, (SELECT unnest(range(0, 25)) AS k), d b WHERE b.i = a.i - k GROUP BY 1)
SELECT lag::INTEGER AS lag, round(s / (SELECT s FROM p WHERE lag = 0), 9) AS acf FROM p""")
def acf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from windrose.functions.times import hour_grid

    df = events(spark, sf_dir).withColumn("one", F.lit(1))
    counts = df.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))
    series = hour_grid(df, "one", "ts").join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).cast("double").alias("n"))
    return profile.autocorrelations(series, ["hour"], "n", 24, bucket=5 * STRETCH).select("lag", F.round("acf", 9).alias("acf"))


@register("seasonal_parts")
def seasonal_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means of each type of event, hours without any as 0, decomposed by the day; loops of regressions have no SQL."""
    from windrose.functions.times import hour_grid

    df = events(spark, sf_dir)
    means = df.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.avg("value").alias("v"))
    series = hour_grid(df, "event_type", "ts").join(means, ["event_type", "hour"], "left").select("event_type", "hour", F.coalesce("v", F.lit(0.0)).alias("v"))
    return seasonal.stl(series, ["event_type"], "hour", "v", 24)


@register("radar_scaled", """
WITH a AS (SELECT event_type, avg(value) AS m, max(value) AS h, count(*)::DOUBLE AS n FROM events GROUP BY 1)
SELECT event_type, round((m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ()), 6) AS m, round((h - min(h) OVER ()) / (max(h) OVER () - min(h) OVER ()), 6) AS h, round((n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ()), 6) AS n FROM a""")
def radar_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = events(spark, sf_dir).groupBy("event_type").agg(F.avg("value").alias("m"), F.max("value").alias("h"), F.count("*").cast("double").alias("n"))
    return profile.min_max_scaled(a, ["m", "h", "n"]).select("event_type", *(F.round(c, 6).alias(c) for c in ("m", "h", "n")))


@register("rollup_profile", "SELECT coalesce(event_type, 'ALL') AS event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ROLLUP (event_type)")
def rollup_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).rollup("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).withColumn("event_type", F.coalesce("event_type", F.lit("ALL")))


@register("duplicate_rows", "SELECT (count(*) - count(DISTINCT (l_orderkey, l_linenumber)))::BIGINT AS n FROM lineitem")
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").agg((F.count("*") - F.count_distinct(F.struct("l_orderkey", "l_linenumber"))).alias("n"))


@register("context_medians", """
WITH a AS (SELECT event_type, hour(ts)::INTEGER AS hour, median(value) AS m, count(*) AS n FROM events GROUP BY 1, 2), f AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1)
SELECT event_type, hour, round(CASE WHEN n >= 80 THEN a.m ELSE f.m END, 6) AS value FROM a JOIN f USING (event_type)""")
def context_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir)
    df = df.withColumn("hour", F.hour("ts"))
    middle = lambda on, name: profile.quantiles_of(df, on, "value", [0.5]).withColumnRenamed("p50", name)
    by_hour = profile.joined_by(df.groupBy("event_type", "hour").agg(F.count("*").alias("n")), middle(["event_type", "hour"], "m"), ["event_type", "hour"])
    overall = middle(["event_type"], "f")
    return by_hour.join(overall, "event_type").select("event_type", "hour", F.round(F.when(F.col("n") >= 80, F.col("m")).otherwise(F.col("f")), 6).alias("value"))
