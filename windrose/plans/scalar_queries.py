"""Cleaning, repair, rules, lookups and patches over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windrose.functions import clean, rules, times
from windrose.operators import profile
from windrose.plans.temporal_queries import events
from windrose.registry import register
from windrose.sources.pages import board_fields


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("na_token_clean", """
WITH c AS (SELECT c_custkey, trim(CASE c_custkey % 5 WHEN 0 THEN ' NaN ' WHEN 1 THEN 'n/a' WHEN 2 THEN '' ELSE ' ' || c_mktsegment || ' ' END) AS t, upper(trim(substr(c_mktsegment, 1, 2 + (c_custkey % 3)::INT))) AS code FROM customer)
SELECT c_custkey, CASE WHEN lower(t) IN ('', 'nan', 'none', 'na', 'n/a', 'null') THEN NULL ELSE t END AS segment, CASE WHEN regexp_matches(code, '^[A-Z]{3}$') THEN code END AS code FROM c""")
def na_token_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    raw = F.when(k == 0, " NaN ").when(k == 1, "n/a").when(k == 2, "").otherwise(F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" ")))
    code = F.expr("substring(c_mktsegment, 1, cast(2 + c_custkey % 3 as int))")
    return _table(spark, sf_dir, "customer").select("c_custkey", clean.no_missing_words(raw).alias("segment"), clean.valid_or_null(code, clean.IATA).alias("code"))


@register("header_row_filter", """
SELECT p_partkey, p_type FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'P_Type ' ELSE p_type END AS p_type FROM part) WHERE upper(trim(p_type)) <> 'P_TYPE'""")
def header_row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, "P_Type ").otherwise(F.col("p_type")).alias("p_type"))
    return clean.without_header_rows(raw)


@register("time_parse_repair", """
WITH c AS (SELECT event_id, ts, strptime(strftime(ts, '%Y-%m-%d') || ' ' || strftime(ts - INTERVAL 40 MINUTE, '%H:%M'), '%Y-%m-%d %H:%M') AS parsed FROM events)
SELECT event_id, parsed, CASE WHEN date_diff('microsecond', ts, parsed) > 43200000000 THEN parsed - INTERVAL 1 DAY WHEN date_diff('microsecond', ts, parsed) < -43200000000 THEN parsed + INTERVAL 1 DAY ELSE parsed END AS repaired FROM c""")
def time_parse_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock = F.date_format(F.col("ts") - F.expr("INTERVAL 40 MINUTE"), "HH:mm")
    parsed = events(spark, sf_dir).select("event_id", "ts", times.parse_on_date(F.to_date("ts"), clock).alias("parsed"))
    return parsed.select("event_id", "parsed", times.near_reference(F.col("parsed"), F.col("ts")).alias("repaired"))


@register("delay_minutes_clip", """
SELECT l_orderkey, l_linenumber, least(greatest(round_even((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 60000000.0, 0)::BIGINT, -60), 720 * 100) AS delay FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def delay_minutes_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, orders = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders")
    delay = F.bround(times.minutes_between(F.col("l_shipdate"), F.col("o_orderdate"))).cast("bigint")
    return items.join(orders, items.l_orderkey == orders.o_orderkey).select("l_orderkey", "l_linenumber", clean.clipped(delay, -60, 72000).cast("bigint").alias("delay"))


@register("wind_components", """
WITH w AS (SELECT event_id, value AS s, radians((json_extract_string(props, '$.k')::INT * 4) - CASE event_id % 3 WHEN 0 THEN 250 WHEN 1 THEN 110 ELSE 350 END) AS a FROM events)
SELECT event_id, round(abs(s * sin(a)), 6) + 0.0 AS crosswind, round(s * cos(a), 6) + 0.0 AS headwind, round(greatest(0, -s * cos(a)), 6) + 0.0 AS tailwind FROM w""")
def wind_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    airport = F.element_at(F.array(*map(F.lit, rules.HEADINGS)), (F.col("event_id") % 3 + 1).cast("int"))
    parts = rules.wind_components(F.col("value"), F.get_json_object("props", "$.k").cast("int") * 4, rules.lookup(airport, rules.HEADINGS))
    return events(spark, sf_dir).select("event_id", *((F.round(c, 6) + 0.0).alias(n) for n, c in parts.items()))


@register("risk_scores", """
WITH k AS (SELECT event_id, value AS v, json_extract_string(props, '$.k')::INT AS k, hour(ts) AS h FROM events),
w AS (SELECT event_id, (k % 9) AS p, v / 5 AS wind, k * 100.0 AS vis, 80 + k % 20 AS hum, k % 30 AS temp, k % 30 - (k % 4) AS dew, k AS cloud, k AS low, k * 30 AS cape, -(k % 7) AS li, CASE WHEN k % 50 = 45 THEN 45 WHEN k % 50 = 0 THEN 95 ELSE 1 END AS code, k % 8 AS tail, k % 25 AS across, h FROM k),
f AS (SELECT *, (p > 0)::INT AS rain, (p >= 5)::INT AS heavy, (wind >= 30)::INT AS strong, (wind >= 50)::INT AS gale, (vis < 5000)::INT AS lowv,
      greatest((vis < 1000 AND hum > 90)::INT, (temp - dew <= 1.5 AND hum >= 90 AND wind < 10 AND h BETWEEN 0 AND 8)::INT, (code IN (45, 48))::INT) AS fog,
      greatest((cloud > 80 AND p > 0)::INT, (cape >= 1500 AND li <= -3)::INT, (code IN (95, 96, 99))::INT) AS storm FROM w),
r AS (SELECT *, (low >= 80)::INT AS ceiling, CASE WHEN heavy = 1 THEN 2 WHEN rain = 1 THEN 1 ELSE 0 END * (temp > 5)::INT AS wet, CASE WHEN heavy = 1 THEN 2 WHEN rain = 1 THEN 1 ELSE 0 END * (temp <= 5)::INT AS ice, lowv + (vis < 4828.032)::INT + 2 * (vis < 1609.344)::INT AS severity FROM f),
s AS (SELECT *, CASE WHEN tail >= 5 THEN CASE WHEN wet > 0 THEN 2 ELSE 1 END ELSE 0 END AS swap FROM r)
SELECT event_id, rain AS is_rain, fog AS is_fog, storm AS is_thunderstorm, ceiling AS is_low_ceiling, wet AS runway_wet, ice AS runway_ice_risk, severity AS visibility_severity, (across >= 10)::INT AS is_crosswind_10kt, (across >= 15)::INT AS is_crosswind_15kt, (across >= 20)::INT AS is_crosswind_20kt,
       (cape >= 1000)::INT + (cape >= 1500)::INT + (li <= -3)::INT + (li <= -5)::INT AS convection_score, swap AS forced_swap_risk,
       least(5, heavy + strong + 2 * gale + lowv + 2 * fog + ice + storm + ceiling) AS delay_risk,
       least(8, severity + (across >= 10)::INT + (across >= 15)::INT + (across >= 20)::INT + heavy + wet + swap + storm + ceiling) AS operational_risk FROM s""")
def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    seen = {"precipitation": k % 9, "wind": F.col("value") / 5, "visibility": k * 100.0, "humidity": 80 + k % 20, "temperature": k % 30, "dew_point": k % 30 - k % 4, "cloud": k, "low_cloud": k, "cape": k * 30, "lifted": -(k % 7), "code": F.when(k % 50 == 45, 45).when(k % 50 == 0, 95).otherwise(1), "tailwind_kt": k % 8, "crosswind_kt": k % 25, "hour": F.hour("ts")}
    found = rules.weather_features(seen)
    return events(spark, sf_dir).select("event_id", *(found[n].alias(n) for n in ("is_rain", "is_fog", "is_thunderstorm", "is_low_ceiling", "runway_wet", "runway_ice_risk", "visibility_severity", "is_crosswind_10kt", "is_crosswind_15kt", "is_crosswind_20kt", "convection_score", "forced_swap_risk", "delay_risk", "operational_risk")))


@register("bins_profile", """
WITH b AS (SELECT unnest(['0-10', '10-50', '50-100', '100+', 'beyond']) AS bin), v AS (SELECT CASE WHEN value <= 10 THEN '0-10' WHEN value <= 50 THEN '10-50' WHEN value <= 100 THEN '50-100' WHEN value <= 1000 THEN '100+' ELSE 'beyond' END AS bin, value FROM events)
SELECT bin, count(value) AS n, round(avg(value), 6) AS mean FROM b LEFT JOIN v USING (bin) GROUP BY 1""")
def bins_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    bins = F.when(v <= 10, "0-10").when(v <= 50, "10-50").when(v <= 100, "50-100").when(v <= 1000, "100+").otherwise("beyond")
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, ("0-10", "10-50", "50-100", "100+", "beyond")))).alias("bin"))
    found = events(spark, sf_dir).groupBy(bins.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return every.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean")


@register("combo_profile", """
WITH c AS (SELECT coalesce(nullif(concat_ws('+', CASE WHEN value > 45 THEN 'late' END, CASE WHEN hour(ts) < 6 THEN 'night' END, CASE WHEN event_type = 'error' THEN 'error' END), ''), 'none') AS combo, value FROM events)
SELECT combo, count(*) AS n, round(avg(value), 6) AS mean, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM c GROUP BY 1""")
def combo_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.concat_ws("+", F.when(F.col("value") > 45, "late"), F.when(F.hour("ts") < 6, "night"), F.when(F.col("event_type") == "error", "error"))
    out = events(spark, sf_dir).groupBy(F.coalesce(F.nullif(parts, F.lit("")), F.lit("none")).alias("combo")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return out.join(F.broadcast(out.agg(F.sum("n").alias("_all"))), F.lit(True)).select("combo", "n", "mean", F.round(F.col("n") / F.col("_all"), 9).alias("share"))


@register("wmo_like", """
WITH c AS (SELECT json_extract_string(props, '$.k')::INT AS k FROM events)
SELECT CASE WHEN k = 0 THEN 'clear' WHEN k <= 3 THEN 'cloudy' WHEN k IN (45, 48) THEN 'fog' WHEN k BETWEEN 51 AND 57 THEN 'drizzle' WHEN k BETWEEN 61 AND 67 THEN 'rain' WHEN k BETWEEN 71 AND 77 THEN 'snow' WHEN k BETWEEN 80 AND 82 THEN 'showers' WHEN k IN (95, 96, 99) THEN 'thunderstorm' ELSE 'other' END AS "group", count(*) AS n FROM c GROUP BY 1""")
def wmo_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(rules.weather_group(F.get_json_object("props", "$.k").cast("int")).alias("group")).agg(F.count("*").alias("n"))


@register("json_extract_gate", """
WITH e AS (SELECT event_id, event_type, value, json_extract_string(props, '$.k')::INT AS k FROM events)
SELECT event_id, CASE WHEN event_type = 'signup' THEN NULL WHEN value < 15 THEN '-1' WHEN k >= 90 THEN 'CODE_71' WHEN k >= 80 THEN 'CODE_72' WHEN value > 100 THEN 'CODE_93' WHEN k % 2 = 0 THEN 'CODE_89' ELSE 'CODE_99' END AS code FROM e""")
def json_extract_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    reasons = {"CODE_71": k >= 90, "CODE_72": k >= 80, "CODE_93": F.col("value") > 100, "CODE_89": k % 2 == 0}
    return events(spark, sf_dir).select("event_id", rules.delay_code(F.col("value"), F.lit(True), F.col("event_type") == "signup", reasons).alias("code"))


@register("html_extract", r"""
SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, len(regexp_extract_all(html, '<p>'))::INTEGER AS n_paragraphs,
       array_to_string(regexp_extract_all(html, '<li><a href="([^"]*)"', 1), ' ') AS links FROM pages""")
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", *(c.alias(n) for n, c in board_fields(F.col("html"), F.col("url")).items()))


@register("patch_where_null", """
WITH b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders), s AS (SELECT l_orderkey, arg_min(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_returnflag)) AS f FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(p, f) AS priority, p IS NULL AND f IS NOT NULL AS patched FROM b LEFT JOIN s ON l_orderkey = o_orderkey""")
def patch_where_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("p"))
    first = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_returnflag", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")).alias("f"))
    return base.join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("p", "f").alias("priority"), (F.col("p").isNull() & F.col("f").isNotNull()).alias("patched"))


@register("match_priority", """
SELECT o_orderkey, l_linenumber FROM (SELECT o_orderkey, l_linenumber, row_number() OVER (PARTITION BY o_orderkey ORDER BY CASE WHEN l_shipdate::DATE = o_orderdate::DATE + 30 THEN 0 WHEN l_shipdate::DATE <= o_orderdate::DATE + 31 THEN 1 ELSE 2 END, l_linenumber, l_partkey, l_suppkey) AS r
FROM orders JOIN lineitem ON l_orderkey = o_orderkey) WHERE r = 1""")
def match_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.date_diff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    rank = F.when(days == 30, 0).when(days <= 31, 1).otherwise(2)
    rows = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("rank", rank)
    return profile.top_per_group(rows, ["o_orderkey"], [F.col(c).asc() for c in ("rank", "l_linenumber", "l_partkey", "l_suppkey")], 1).select("o_orderkey", "l_linenumber")


@register("left_join_keep_last", """
WITH l AS (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_status FROM orders GROUP BY 1) SELECT c_custkey, last_status FROM customer LEFT JOIN l ON o_custkey = c_custkey""")
def left_join_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    last = _table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(newest)).filter("r = 1").select("o_custkey", F.col("o_orderstatus").alias("last_status"))
    return _table(spark, sf_dir, "customer").join(last, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "last_status")


@register("missing_link_flags", """
SELECT d.event_id, EXISTS (SELECT 1 FROM events a WHERE a.event_type = 'error' AND a.user_id = d.user_id AND date_trunc('hour', a.ts) = date_trunc('hour', d.ts)) AS linked FROM events d WHERE event_type = 'purchase'""")
def missing_link_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = events(spark, sf_dir, "error").select("user_id", F.date_trunc("hour", "ts").alias("hour")).distinct().withColumn("linked", F.lit(True))
    return events(spark, sf_dir, "purchase").withColumn("hour", F.date_trunc("hour", "ts")).join(keys, ["user_id", "hour"], "left").select("event_id", F.coalesce("linked", F.lit(False)).alias("linked"))


@register("resume_anti_join", """
SELECT event_id FROM events e WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events d WHERE d.event_type = 'click' AND d.user_id = e.user_id AND d.ts::DATE = e.ts::DATE)""")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = events(spark, sf_dir, "click").select("user_id", F.to_date("ts").alias("day"))
    return events(spark, sf_dir, "view").withColumn("day", F.to_date("ts")).join(done, ["user_id", "day"], "left_anti").select("event_id")


@register("annotator_join", """
SELECT l.doc_id, 'Q' || l.quality AS a, 'T' || l.toxic AS b, coalesce(d.lang, '?') AS c FROM labels l JOIN documents d USING (doc_id) JOIN (SELECT doc_id FROM documents WHERE n_chars > 200) USING (doc_id)""")
def annotator_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    rows = _table(spark, sf_dir, "labels").join(docs.drop("n_chars"), "doc_id").join(docs.filter("n_chars > 200").select("doc_id"), "doc_id")
    return rows.select("doc_id", F.concat(F.lit("Q"), "quality").alias("a"), F.concat(F.lit("T"), "toxic").alias("b"), F.coalesce("lang", F.lit("?")).alias("c"))


@register("what_if_buffer", """
SELECT event_id, round(value - 20, 6) AS buffer, CASE WHEN value - 20 < 0 THEN 'late' ELSE 'fine' END AS category, CASE WHEN value <= 15 THEN 'on_time' WHEN value <= 45 THEN 'minor' ELSE 'major' END AS tier, round(least(1, value / 15 + 12 / 60.0), 6) AS live_risk FROM events""")
def what_if_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return events(spark, sf_dir).select("event_id", F.round(v - 20, 6).alias("buffer"), F.when(v - 20 < 0, "late").otherwise("fine").alias("category"), rules.alert_tier(v).alias("tier"), F.round(F.least(F.lit(1.0), v / 15 + 12 / 60.0), 6).alias("live_risk"))


@register("flag_coercion", """
SELECT event_id, CASE WHEN event_type IN ('click') THEN true WHEN event_type = 'view' THEN false ELSE true END AS flag, CASE WHEN event_id % 2 = 0 THEN 'VN' || event_id ELSE 'VJ' || event_id END AS flight FROM events""")
def flag_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.when(F.col("event_type") == "click", " Yes").when(F.col("event_type") == "view", "0").otherwise("?")
    number = F.concat(F.when(F.col("event_id") % 2 == 0, " bl").otherwise("VJ"), F.col("event_id").cast("string"))
    return events(spark, sf_dir).select("event_id", clean.as_flag(word, True).alias("flag"), clean.flight_number(number).alias("flight"))


@register("wind_sectors", """
WITH d AS (SELECT (json_extract_string(props, '$.k')::INT * 22.5) % 360 AS a FROM events)
SELECT CASE WHEN a > 22.5 AND a <= 67.5 THEN 'NE' WHEN a > 67.5 AND a <= 112.5 THEN 'E' WHEN a > 112.5 AND a <= 157.5 THEN 'SE' WHEN a > 157.5 AND a <= 202.5 THEN 'S' WHEN a > 202.5 AND a <= 247.5 THEN 'SW' WHEN a > 247.5 AND a <= 292.5 THEN 'W' WHEN a > 292.5 AND a <= 337.5 THEN 'NW' ELSE 'N' END AS sector, count(*) AS n FROM d GROUP BY 1""")
def wind_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(rules.sector(F.get_json_object("props", "$.k").cast("int") * 22.5).alias("sector")).agg(F.count("*").alias("n"))


@register("seeded_sample", "SELECT event_id, event_type, value FROM events ORDER BY md5('42|' || event_id), event_id LIMIT 200")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: its limit is the feature."""
    return profile.sampled(events(spark, sf_dir).select("event_id", "event_type", "value"), "event_id", 200)
