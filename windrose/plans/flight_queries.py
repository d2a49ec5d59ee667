"""Repair and features of flights. The event table stands for flights, its month pressed into two and a half days so that
flights meet; ``FLIGHTS`` and ``flights`` derive the same records from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrose.functions import rules
from windrose.functions.times import minutes_between
from windrose.operators import flights as repair
from windrose.operators import turnaround
from windrose.plans.temporal_queries import events
from windrose.registry import register

START = 1704067200000000

FLIGHTS = f"""
WITH raw AS (SELECT event_id AS row_id, user_id AS u, event_type, floor(value)::BIGINT AS v, {START} + (epoch_us(ts) - {START}) // 12 AS t FROM events),
f AS (SELECT row_id, CASE WHEN event_type IN ('purchase', 'signup', 'click') THEN 'departure' ELSE 'arrival' END AS mode,
  (['SGN', 'HAN', 'DAD'])[u % 3 + 1] AS airport, (['SGN', 'HAN', 'DAD'])[(u + row_id) % 3 + 1] AS iata,
  CASE WHEN row_id % 29 > 0 THEN 'VN' || (u % 10) END AS flight_no, CASE WHEN row_id % 13 > 0 THEN (CASE WHEN row_id % 4 = 0 THEN ' a' ELSE 'A' END) || (row_id % 7) END AS tail,
  CASE WHEN row_id % 31 > 0 THEN make_timestamp(t) END AS actual, CASE WHEN row_id % 37 > 0 THEN make_timestamp(t - (v % 150 - 40) * 60000000) END AS scheduled,
  (['passenger', 'Cargo', 'private', 'unknown', 'passenger'])[row_id % 5 + 1] AS category, (['A321', 'A359', 'AT76', 'b789', 'A346'])[u % 5 + 1] AS aircraft,
  CASE WHEN row_id % 19 = 0 THEN 'Diverted' WHEN row_id % 23 = 0 THEN 'Returned' ELSE 'Landed' END AS status, (['VietJet Air', 'Vietnam Airlines', 'Bamboo'])[u % 3 + 1] AS airline, row_id % 17 = 0 AS is_imputed FROM raw),
r AS (SELECT * FROM (VALUES ('SGN', 'arrival', '25R', '07L'), ('SGN', 'departure', '25L', '07R'), ('HAN', 'arrival', '11L', '29R'), ('HAN', 'departure', '11R', '29L'), ('DAD', 'arrival', '35L', '17R'), ('DAD', 'departure', '35R', '17L')) AS x(airport, mode, usual, reverse)),
flights AS (SELECT f.*, usual, reverse, coalesce(actual, scheduled) AS event,
  CASE WHEN row_id // 97 % 3 = 0 AND row_id % 5 < 3 THEN reverse WHEN row_id % 5 = 3 THEN ' Unknown' WHEN row_id % 5 = 4 THEN NULL ELSE usual END AS runway FROM f JOIN r USING (airport, mode))
"""


def _pick(index: Column, *values: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, u = F.col("row_id"), F.col("u")
    epoch = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    raw = events(spark, sf_dir).select(F.col("event_id").alias("row_id"), F.col("user_id").alias("u"), "event_type", F.floor("value").alias("v"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div 12").alias("t"))
    at = F.timestamp_add("MICROSECOND", F.col("t"), epoch)
    planned = F.timestamp_add("MICROSECOND", F.col("t") - (F.col("v") % 150 - 40) * 60_000_000, epoch)
    out = raw.select(
        "row_id", F.when(F.col("event_type").isin("purchase", "signup", "click"), "departure").otherwise("arrival").alias("mode"), _pick(u % 3, "SGN", "HAN", "DAD").alias("airport"), _pick((u + i) % 3, "SGN", "HAN", "DAD").alias("iata"),
        F.when(i % 29 > 0, F.concat(F.lit("VN"), (u % 10).cast("string"))).alias("flight_no"), F.when(i % 13 > 0, F.concat(F.when(i % 4 == 0, " a").otherwise("A"), (i % 7).cast("string"))).alias("tail"),
        F.when(i % 31 > 0, at).alias("actual"), F.when(i % 37 > 0, planned).alias("scheduled"), _pick(i % 5, "passenger", "Cargo", "private", "unknown", "passenger").alias("category"), _pick(u % 5, "A321", "A359", "AT76", "b789", "A346").alias("aircraft"),
        F.when(i % 19 == 0, "Diverted").when(i % 23 == 0, "Returned").otherwise("Landed").alias("status"), _pick(u % 3, "VietJet Air", "Vietnam Airlines", "Bamboo").alias("airline"), (i % 17 == 0).alias("is_imputed"),
    )
    usual, reverse = repair.usual_runway(0), repair.usual_runway(1)
    turned = F.expr("row_id div 97") % 3 == 0
    return out.withColumn("runway", F.when(turned & (i % 5 < 3), reverse).when(i % 5 == 3, " Unknown").when(i % 5 == 4, None).otherwise(usual))


RETURNS = """ret AS (SELECT row_id, gap, coalesce(gap <= 150, FALSE) AS is_return FROM (
  SELECT a.row_id, (epoch_us(a.event) - max(epoch_us(d.event))) / 60000000.0 AS gap FROM flights a LEFT JOIN flights d ON d.mode = 'departure' AND d.airport = a.airport AND d.flight_no = a.flight_no AND d.event <= a.event
  WHERE a.mode = 'arrival' AND a.iata = a.airport GROUP BY a.row_id, a.event)),
linked AS (SELECT DISTINCT d.row_id FROM flights d JOIN flights a ON a.mode = 'arrival' AND a.iata = a.airport AND d.mode = 'departure' AND d.airport = a.airport AND d.flight_no = a.flight_no AND a.event BETWEEN d.event AND d.event + INTERVAL 150 MINUTE)"""


@register("flight_dedup", FLIGHTS + "," + RETURNS + """,
k AS (SELECT row_id, mode, airport, iata, flight_no, event, scheduled::DATE AS service, event::DATE AS day FROM flights WHERE flight_no IS NOT NULL AND event IS NOT NULL),
g AS (SELECT *, epoch_us(event) - lag(epoch_us(event)) OVER (PARTITION BY airport, mode, service, flight_no, iata, day ORDER BY event, row_id) AS gap FROM k),
c AS (SELECT *, sum(CASE WHEN gap > 9000000000 THEN 1 ELSE 0 END) OVER (PARTITION BY airport, mode, service, flight_no, iata, day ORDER BY event, row_id) AS cluster FROM g),
s AS (SELECT airport, mode, service, flight_no, iata, day, cluster, min(CASE WHEN gap <= 9000000000 THEN gap END) AS near, arg_max(row_id, (event, -row_id)) AS latest,
        bool_or(row_id IN (SELECT row_id FROM ret WHERE is_return)) AS any_return, bool_or(row_id IN (SELECT row_id FROM linked)) AS any_linked FROM c GROUP BY ALL),
j AS (SELECT c.row_id, CASE WHEN (c.mode = 'departure' AND any_linked) OR (c.mode = 'arrival' AND any_return AND coalesce(near <= 600000000, FALSE)) THEN c.row_id ELSE latest END AS kept_row
      FROM c JOIN s ON c.airport = s.airport AND c.mode = s.mode AND c.service IS NOT DISTINCT FROM s.service AND c.flight_no = s.flight_no AND c.iata = s.iata AND c.day = s.day AND c.cluster = s.cluster)
SELECT f.row_id, coalesce(j.kept_row, f.row_id) AS kept_row, coalesce(j.kept_row, f.row_id) <> f.row_id AS is_dropped FROM flights f LEFT JOIN j USING (row_id)""")
def flight_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.deduplicated(flights(spark, sf_dir)).select("row_id", "kept_row", "is_dropped")


ORIENTED = """o AS (SELECT *, CASE WHEN airport = 'DAD' THEN scheduled ELSE actual END AS at, upper(trim(runway)) AS rw FROM flights),
n AS (SELECT a.row_id, sum((b.rw = b.usual)::INT) AS d, sum((b.rw = b.reverse)::INT) AS v FROM o a JOIN o b ON a.airport = b.airport AND a.mode = b.mode AND b.rw IS NOT NULL AND b.at BETWEEN a.at - INTERVAL 30 MINUTE AND a.at + INTERVAL 30 MINUTE GROUP BY 1),
w AS (SELECT o.*, CASE WHEN greatest(d, v) > 0 AND greatest(d, v) >= 0.6 * (d + v) THEN CASE WHEN d >= v THEN 'default' ELSE 'reverse' END END AS orientation FROM o LEFT JOIN n USING (row_id))"""


@register("runway_fill", FLIGHTS + "," + ORIENTED + """,
p AS (SELECT a.row_id, b.runway AS rw, abs(epoch_us(a.at) - epoch_us(b.at)) AS gap, row_number() OVER (PARTITION BY a.row_id ORDER BY abs(epoch_us(a.at) - epoch_us(b.at)), b.at, b.row_id) AS k_near,
        row_number() OVER (PARTITION BY a.row_id ORDER BY abs(epoch_us(a.at) - epoch_us(b.at)), b.at DESC, b.row_id) AS k_any
      FROM w a JOIN w b ON a.airport = b.airport AND a.mode = b.mode AND a.at IS NOT NULL AND b.at IS NOT NULL AND (a.rw IS NULL OR a.rw = 'UNKNOWN') AND b.rw <> 'UNKNOWN'),
x AS (SELECT row_id, max(CASE WHEN k_near = 1 AND gap <= 1800000000 THEN rw END) AS near, max(CASE WHEN k_any = 1 THEN rw END) AS anyone FROM p GROUP BY 1)
SELECT w.row_id, orientation, CASE WHEN w.rw IS NOT NULL AND w.rw <> 'UNKNOWN' THEN runway ELSE coalesce(near, CASE WHEN airport = 'DAD' THEN anyone END, CASE WHEN orientation = 'reverse' THEN reverse ELSE usual END) END AS runway,
       CASE WHEN w.rw IS NOT NULL AND w.rw <> 'UNKNOWN' THEN NULL WHEN near IS NOT NULL THEN 'near' WHEN airport = 'DAD' AND anyone IS NOT NULL THEN 'any' ELSE 'usual' END AS filled_by FROM w LEFT JOIN x USING (row_id)""")
def runway_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.filled_runways(flights(spark, sf_dir)).select("row_id", "orientation", "runway", "filled_by")


@register("same_origin_actions", FLIGHTS + "," + RETURNS + "," + ORIENTED + """,
a AS (SELECT w.row_id, runway, usual, reverse, orientation, iata, flight_no, coalesce(is_return, FALSE) AS is_return, gap,
        CASE WHEN is_return IS NULL THEN NULL WHEN is_return THEN 'keep_return_emergency' WHEN lower(trim(category)) IN ('passenger', 'unknown', 'cargo') THEN 'drop_unmatched_same_origin' ELSE 'keep_noncommercial_same_origin' END AS action
      FROM w LEFT JOIN ret USING (row_id) WHERE mode = 'arrival'),
b AS (SELECT *, upper(trim(coalesce(runway, CASE WHEN orientation = 'reverse' THEN reverse ELSE usual END))) AS now FROM a)
SELECT row_id, action, is_return, round(gap, 9) AS return_gap,
       CASE action WHEN 'keep_return_emergency' THEN CASE now WHEN '25R' THEN '25L' WHEN '07L' THEN '07R' WHEN '11L' THEN '11R' WHEN '29R' THEN '29L' WHEN '35L' THEN '35R' WHEN '17R' THEN '17L' ELSE now END
         WHEN 'keep_noncommercial_same_origin' THEN CASE WHEN orientation = 'reverse' THEN reverse ELSE usual END ELSE runway END AS runway,
       CASE WHEN action = 'keep_noncommercial_same_origin' THEN NULL ELSE iata END AS iata, CASE WHEN action = 'keep_noncommercial_same_origin' THEN NULL ELSE flight_no END AS flight_no FROM b""")
def same_origin_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.same_origin(repair.oriented(flights(spark, sf_dir))).select("row_id", "action", "is_return", F.round("return_gap", 9).alias("return_gap"), "runway", "iata", "flight_no")


SWAPS = """pairs AS (SELECT d.row_id, a.row_id AS arr_row, a.tail AS arr_tail, (epoch_us(a.event) - epoch_us(d.event)) / 60000000.0 AS gap, row_number() OVER (PARTITION BY d.row_id ORDER BY a.event, a.row_id) AS k,
  row_number() OVER (PARTITION BY d.row_id ORDER BY (a.tail IS NULL)::INT, a.event, a.row_id) AS k_tail FROM flights d JOIN flights a ON d.mode = 'departure' AND a.mode = 'arrival' AND d.iata <> d.airport AND a.iata = d.airport AND a.airport = d.iata AND a.flight_no = d.flight_no AND a.event > d.event AND a.event <= d.event + INTERVAL 6 HOUR),
best AS (SELECT row_id, max(CASE WHEN k = 1 THEN arr_row END) AS arr_row, max(CASE WHEN k = 1 THEN gap END) AS gap, max(CASE WHEN k_tail = 1 THEN arr_tail END) AS matched_tail FROM pairs GROUP BY 1),
sw AS (SELECT d.*, arr_row, gap, matched_tail, coalesce(upper(trim(d.tail)) <> upper(trim(matched_tail)), FALSE) AS is_swapped FROM flights d LEFT JOIN best USING (row_id) WHERE d.mode = 'departure' AND d.iata <> d.airport)"""


@register("swap_flags", FLIGHTS + "," + SWAPS + """
SELECT row_id, arr_row, round(gap, 2) AS match_gap, matched_tail, is_swapped FROM sw""")
def swap_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.swaps(flights(spark, sf_dir)).select("row_id", "arr_row", F.round("match_gap", 2).alias("match_gap"), "matched_tail", "is_swapped")


@register("swap_tail_overrides", FLIGHTS + "," + SWAPS + """,
new AS (SELECT row_id, upper(trim(matched_tail)) AS t FROM sw WHERE is_swapped AND airport = 'DAD'
        UNION ALL SELECT arr_row, arg_max(upper(trim(tail)), (event, row_id)) FROM sw WHERE is_swapped AND iata = 'DAD' GROUP BY 1)
SELECT row_id, coalesce(t, tail) AS tail FROM flights LEFT JOIN new USING (row_id)""")
def swap_tail_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.with_tails_of_swaps(flights(spark, sf_dir)).select("row_id", "tail")


NEW_TAILS = """new AS (SELECT row_id, upper(trim(matched_tail)) AS t FROM sw WHERE is_swapped AND airport = 'DAD'
        UNION ALL SELECT arr_row, arg_max(upper(trim(tail)), (event, row_id)) FROM sw WHERE is_swapped AND iata = 'DAD' GROUP BY 1),
settled AS (SELECT flights.* REPLACE (coalesce(t, tail) AS tail) FROM flights LEFT JOIN new USING (row_id))"""


def _again(sql: str) -> str:
    """The SQL of the swaps over the settled flights, under other names."""
    for old, new in (("FROM flights", "FROM settled"), ("JOIN flights", "JOIN settled"), ("pairs", "pairs2"), ("best", "best2"), ("sw AS", "sw2 AS")):
        sql = sql.replace(old, new)
    return sql


@register("swap_flags_settled", ",".join((FLIGHTS, SWAPS, NEW_TAILS, _again(SWAPS))) + """
SELECT row_id, arr_row, matched_tail, is_swapped FROM sw2""")
def swap_flags_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.settled_swaps(flights(spark, sf_dir)).select("row_id", "arr_row", "matched_tail", "is_swapped")


@register("swap_summary", FLIGHTS + "," + SWAPS + """
SELECT airport || '->' || iata AS route, count(arr_row) AS matched, sum(is_swapped::INT)::BIGINT AS swapped, round(avg(gap), 6) AS mean_gap FROM sw GROUP BY 1""")
def swap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair.swaps(flights(spark, sf_dir))
    return found.groupBy(F.concat_ws("->", "airport", "iata").alias("route")).agg(F.count("arr_row").alias("matched"), F.count_if("is_swapped").alias("swapped"), F.round(F.avg("match_gap"), 6).alias("mean_gap"))


@register("match_quality", FLIGHTS + """,
u AS (SELECT x.row_id, x.mode FROM flights x WHERE lower(trim(x.category)) = 'passenger' AND x.iata <> x.airport AND x.flight_no IS NOT NULL AND x.event IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM flights y WHERE y.mode <> x.mode AND y.flight_no = x.flight_no AND y.airport = x.iata AND y.iata = x.airport AND CASE WHEN x.mode = 'departure' THEN y.event BETWEEN x.event AND x.event + INTERVAL 6 HOUR ELSE y.event BETWEEN x.event - INTERVAL 6 HOUR AND x.event END))
SELECT f.row_id, coalesce(u.mode <> 'arrival', TRUE) AS has_matched_departure, coalesce(u.mode <> 'departure', TRUE) AS has_matched_arrival, CASE u.mode WHEN 'departure' THEN 'dep_without_arrival' WHEN 'arrival' THEN 'arrival_without_departure' ELSE 'matched' END AS match_status,
       CASE u.mode WHEN 'departure' THEN 'unmatched_departure' WHEN 'arrival' THEN 'unmatched_arrival' ELSE 'complete' END AS data_completeness, u.row_id IS NOT NULL AS exclude_from_training FROM flights f LEFT JOIN u USING (row_id)""")
def match_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.match_quality(flights(spark, sf_dir)).select("row_id", "has_matched_departure", "has_matched_arrival", "match_status", "data_completeness", "exclude_from_training")


@register("arrival_day_shift", FLIGHTS + """,
s AS (SELECT a.row_id, a.actual, a.event, CASE WHEN bool_or(epoch_us(a.event) - epoch_us(d.event) BETWEEN 1 AND 21600000000) THEN 0 WHEN bool_or(epoch_us(a.event) + 86400000000 - epoch_us(d.event) BETWEEN 1 AND 21600000000) THEN 1
        WHEN bool_or(epoch_us(a.event) - 86400000000 - epoch_us(d.event) BETWEEN 1 AND 21600000000) THEN -1 ELSE 0 END AS shift
      FROM flights a LEFT JOIN flights d ON d.mode = 'departure' AND d.airport = a.iata AND d.iata = a.airport AND d.flight_no = a.flight_no WHERE a.mode = 'arrival' GROUP BY 1, 2, 3)
SELECT row_id, shift, CASE WHEN shift = 0 THEN actual ELSE event + shift * INTERVAL 1 DAY END AS actual FROM s""")
def arrival_day_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.right_arrival_days(flights(spark, sf_dir)).select("row_id", "shift", "actual")


INCOMING = """arr AS (SELECT row_id, tail, actual, status, is_imputed, airport, CASE WHEN is_imputed THEN 0 ELSE coalesce((epoch_us(actual) - epoch_us(scheduled)) / 60000000.0, 0) END AS delay,
  CASE WHEN upper(trim(aircraft)) IN ('A359', 'B789', 'B747', 'A330', 'B77X', 'B78X', 'A333', 'B77W', 'B788') THEN 90 WHEN upper(trim(aircraft)) LIKE 'AT%' THEN 35 ELSE 60 END AS std FROM flights WHERE mode = 'arrival'),
j AS (SELECT d.row_id, d.scheduled, d.actual, d.is_imputed, a.row_id AS prev_row, a.actual AS arrived, a.status AS prev_status, coalesce(a.delay, 0) AS arrival_delay, coalesce(a.std, 60) AS std, coalesce(a.is_imputed, FALSE) AS prev_imputed,
        row_number() OVER (PARTITION BY d.row_id ORDER BY a.actual DESC NULLS LAST, a.row_id DESC) AS k FROM flights d LEFT JOIN arr a ON a.tail = d.tail AND a.actual < d.scheduled WHERE d.mode = 'departure'),
inc AS (SELECT *, CASE WHEN prev_imputed THEN scheduled - std * INTERVAL 1 MINUTE ELSE arrived END AS prev_arrival FROM j WHERE k = 1),
dep AS (SELECT * REPLACE (coalesce(actual, CASE WHEN is_imputed AND prev_arrival IS NOT NULL THEN prev_arrival + std * INTERVAL 1 MINUTE END) AS actual), (epoch_us(scheduled) - epoch_us(prev_arrival)) / 60000000.0 AS raw FROM inc),
del AS (SELECT *, coalesce((epoch_us(actual) - epoch_us(scheduled)) / 60000000.0, 0) AS dd, coalesce(raw >= 5760, FALSE) AS long, CASE WHEN raw >= 4320 THEN 4320 WHEN raw >= 0 THEN raw WHEN raw < -120 THEN 0 END AS buffer, least(4320, coalesce(greatest(0, raw - std), 0)) AS stag FROM dep)"""


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flights(spark, sf_dir)
    return turnaround.incoming(rows.filter("mode = 'departure'"), rows.filter("mode = 'arrival'"))


@register("turnaround_features", FLIGHTS + "," + INCOMING + """
SELECT row_id, prev_row, prev_arrival, prev_imputed, regexp_matches(lower(coalesce(prev_status, '')), 'divert|return|emergency')::INT AS is_diverted_prev, std AS standard_turnaround, round(arrival_delay, 9) AS arrival_delay, round_even(dd, 0)::BIGINT AS departure_delay,
       round_even(least(720, greatest(-60, dd)), 0)::BIGINT AS target, long::INT AS is_long_ground, round_even(coalesce(buffer, 0), 0)::BIGINT AS turnaround_buffer, round(CASE WHEN NOT long THEN buffer END, 9) AS turnaround_buffer_model,
       round_even(coalesce(greatest(0, std - raw), 0), 0)::BIGINT AS turnaround_deficit, round_even(coalesce(greatest(0, raw - std), 0), 0)::BIGINT AS turnaround_slack, round_even(stag, 0)::BIGINT AS stagnation, round(CASE WHEN NOT long THEN stag END, 9) AS stagnation_model,
       round(coalesce(greatest(0, std - raw), 0), 9) AS tobt_deficit FROM del""")
def turnaround_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = turnaround.ground_times(_incoming(spark, sf_dir))
    exact = [F.round(c, 9).alias(c) for c in ("arrival_delay", "turnaround_buffer_model", "stagnation_model", "tobt_deficit")]
    return found.select("row_id", "prev_row", "prev_arrival", "prev_imputed", "is_diverted_prev", "standard_turnaround", *exact, "departure_delay", "target", "is_long_ground", "turnaround_buffer", "turnaround_deficit", "turnaround_slack", "stagnation")


@register("leakage_check", FLIGHTS + "," + INCOMING + """
SELECT 'departure_scheduled_after_previous_arrival' AS check_name, count(*) FILTER (scheduled <= prev_arrival) AS violation_count, count(*) AS rows_checked, CASE WHEN count(*) FILTER (scheduled <= prev_arrival) = 0 THEN 'pass' ELSE 'review' END AS status FROM del""")
def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turnaround.leakage(_incoming(spark, sf_dir))


CAPACITY = "CASE {} WHEN 'SGN' THEN 44 WHEN 'HAN' THEN 37 WHEN 'DAD' THEN 24 ELSE 30 END"


@register("network_pressure", FLIGHTS + f"""
SELECT d.row_id, (SELECT count(*) FROM flights a WHERE a.mode = 'arrival' AND a.airport = d.airport AND a.airline = d.airline AND a.actual BETWEEN d.scheduled - INTERVAL 45 MINUTE AND d.scheduled) AS handling_pressure,
       ((SELECT count(*) FROM flights a WHERE a.airport = d.iata AND a.scheduled >= d.scheduled - INTERVAL 60 MINUTE AND a.scheduled < d.scheduled) >= 0.85 * {CAPACITY.format('d.iata')})::INT AS destination_congestion,
       (SELECT count(*) FROM flights a WHERE a.mode = 'departure' AND a.airport = d.airport AND a.scheduled >= d.scheduled - INTERVAL 15 MINUTE AND a.scheduled < d.scheduled) AS taxi_out FROM flights d WHERE d.mode = 'departure'""")
def network_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flights(spark, sf_dir)
    return turnaround.network_pressure(rows.filter("mode = 'departure'"), rows).select("row_id", "handling_pressure", "destination_congestion", "taxi_out")


@register("diverted_before", FLIGHTS + "," + INCOMING + """
SELECT row_id, (regexp_matches(lower(coalesce(prev_status, '')), 'divert|return|emergency') OR row_id % 41 = 0)::INT AS is_diverted_prev FROM inc""")
def diverted_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flights(spark, sf_dir)
    flagged = rows.filter("mode = 'departure'").withColumn("is_return_emergency", F.when(F.col("row_id") % 5 > 0, F.col("row_id") % 41 == 0).otherwise(F.when(F.col("row_id") % 41 == 0, True)))
    return turnaround.incoming(flagged, rows.filter("mode = 'arrival'")).select("row_id", "is_diverted_prev")


@register("departure_load", FLIGHTS + "," + INCOMING + f""",
e AS (SELECT *, (coalesce((epoch_us(actual) - epoch_us(scheduled)) / 60000000.0 > 45, FALSE) OR regexp_matches(lower(status), 'divert|return|emergency'))::INT AS late FROM flights WHERE mode = 'arrival' AND scheduled IS NOT NULL),
d AS (SELECT inc.row_id, inc.scheduled, inc.prev_arrival, f.airport, p.iata AS station FROM inc JOIN flights f USING (row_id) LEFT JOIN flights p ON p.row_id = inc.prev_row),
c AS (SELECT d.*, (SELECT count(*) FROM e WHERE e.airport = d.airport AND e.scheduled >= d.scheduled - INTERVAL 60 MINUTE AND e.scheduled < d.scheduled) AS hour_before,
  (SELECT count(*) FROM e WHERE e.airport = d.airport AND e.scheduled BETWEEN d.scheduled - INTERVAL 30 MINUTE AND d.scheduled + INTERVAL 30 MINUTE) AS around,
  (SELECT count(*) FROM e WHERE e.airport = d.airport AND e.scheduled BETWEEN d.scheduled - INTERVAL 60 MINUTE AND d.scheduled) AS n, (SELECT count(*) FROM e WHERE late = 1 AND e.airport = d.airport AND e.scheduled BETWEEN d.scheduled - INTERVAL 60 MINUTE AND d.scheduled) AS bad,
  (SELECT count(*) FROM e WHERE e.airport = d.station AND e.scheduled BETWEEN d.prev_arrival - INTERVAL 60 MINUTE AND d.prev_arrival) AS pn, (SELECT count(*) FROM e WHERE late = 1 AND e.airport = d.station AND e.scheduled BETWEEN d.prev_arrival - INTERVAL 60 MINUTE AND d.prev_arrival) AS pbad FROM d)
SELECT row_id, hour_before AS flights_last_hour, round(around / {CAPACITY.format('airport')}, 9) AS load, (hour_before >= 0.85 * {CAPACITY.format('airport')})::INT AS is_congested, (around / {CAPACITY.format('airport')} >= 0.85)::INT AS is_parallel,
       round(CASE WHEN n > 0 THEN bad / n ELSE 0 END, 9) AS density_disruption, round(CASE WHEN pn > 0 THEN pbad / pn ELSE 0 END, 9) AS previous_station_disruption FROM c""")
def departure_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = turnaround.departure_load(_incoming(spark, sf_dir), flights(spark, sf_dir).filter("mode = 'arrival'"))
    return found.select("row_id", "flights_last_hour", "is_congested", "is_parallel", *(F.round(c, 9).alias(c) for c in ("load", "density_disruption", "previous_station_disruption")))


@register("delay_lags", FLIGHTS + "," + INCOMING + """,
x AS (SELECT del.row_id, f.tail, f.airport, f.runway, del.scheduled, del.actual, round_even(dd, 0)::BIGINT AS delay, CASE WHEN NOT long THEN buffer END AS b FROM del JOIN flights f USING (row_id)),
l AS (SELECT row_id, CASE WHEN lag(actual, 1) OVER t <= scheduled THEN lag(delay, 1) OVER t END AS t1, CASE WHEN lag(actual, 2) OVER t <= scheduled THEN lag(delay, 2) OVER t END AS t2, CASE WHEN lag(actual, 3) OVER t <= scheduled THEN lag(delay, 3) OVER t END AS t3,
  lag(b, 1) OVER t AS b1, lag(b, 2) OVER t AS b2, avg(b) OVER (PARTITION BY tail ORDER BY scheduled NULLS FIRST, row_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b3,
  CASE WHEN lag(actual, 1) OVER a <= scheduled THEN lag(delay, 1) OVER a END AS a1, CASE WHEN lag(actual, 2) OVER a <= scheduled THEN lag(delay, 2) OVER a END AS a2, CASE WHEN lag(actual, 3) OVER a <= scheduled THEN lag(delay, 3) OVER a END AS a3,
  coalesce(lag(runway) OVER a <> runway AND epoch_us(scheduled) - epoch_us(lag(scheduled) OVER a) <= 3600000000, FALSE)::INT AS swap
  FROM x WINDOW t AS (PARTITION BY tail ORDER BY scheduled NULLS FIRST, row_id), a AS (PARTITION BY airport ORDER BY scheduled NULLS FIRST, row_id))
SELECT row_id, t1 AS prev_departure_delay_tail_1, t2 AS prev_departure_delay_tail_2, round(list_avg(list_filter([t1, t2, t3], lambda v: v IS NOT NULL)), 9) AS rolling_departure_delay_tail_3, round(b1, 9) AS prev_turnaround_buffer_tail_1, round(b2, 9) AS prev_turnaround_buffer_tail_2,
       round(b3, 9) AS rolling_turnaround_buffer_tail_3, a1 AS prev_departure_delay_airport_1, round(list_avg(list_filter([a1, a2, a3], lambda v: v IS NOT NULL)), 9) AS rolling_departure_delay_airport_3, swap AS runway_swap FROM l""")
def delay_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = turnaround.delay_lags(turnaround.ground_times(_incoming(spark, sf_dir)))
    exact = ["row_id", "prev_departure_delay_tail_1", "prev_departure_delay_tail_2", "prev_departure_delay_airport_1", "runway_swap"]
    rounded = ["rolling_departure_delay_tail_3", "prev_turnaround_buffer_tail_1", "prev_turnaround_buffer_tail_2", "rolling_turnaround_buffer_tail_3", "rolling_departure_delay_airport_3"]
    return found.select(*exact, *(F.round(c, 9).alias(c) for c in rounded))


@register("flight_profile", FLIGHTS + """,
x AS (SELECT *, CASE WHEN mode = 'arrival' THEN actual ELSE scheduled END AS moment FROM flights)
SELECT row_id, (upper(trim(aircraft)) IN ('A359', 'B789', 'B747', 'A330', 'B77X', 'B78X', 'A333', 'B77W', 'B788'))::INT AS is_wide_body, CASE airline WHEN 'Vietnam Airlines' THEN 'FSC' ELSE 'LCC' END AS airline_type,
       CASE WHEN moment IS NULL THEN 'Unknown' WHEN hour(moment) < 6 THEN 'Early_Morning' WHEN hour(moment) < 12 THEN 'Morning' WHEN hour(moment) < 18 THEN 'Afternoon' ELSE 'Night' END AS time_of_day,
       coalesce(hour(moment) * 60 + minute(moment) BETWEEN 420 AND 540 OR hour(moment) * 60 + minute(moment) BETWEEN 990 AND 1170, FALSE)::INT AS is_peak_hour FROM x""")
def flight_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turnaround.flight_profile(flights(spark, sf_dir)).select("row_id", "is_wide_body", "airline_type", "time_of_day", "is_peak_hour")


@register("arrival_side", FLIGHTS + f""",
a AS (SELECT *, CASE WHEN is_imputed THEN 0 ELSE coalesce((epoch_us(actual) - epoch_us(scheduled)) / 60000000.0, 0) END AS delay FROM flights WHERE mode = 'arrival'),
e AS (SELECT *, (coalesce(mode = 'arrival' AND (epoch_us(actual) - epoch_us(scheduled)) / 60000000.0 > 45, FALSE) OR regexp_matches(lower(status), 'divert|return|emergency'))::INT AS late FROM flights),
l AS (SELECT row_id, row_number() OVER w AS leg, greatest(0, coalesce(sum(delay) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS acc FROM a WHERE tail IS NOT NULL AND actual IS NOT NULL WINDOW w AS (PARTITION BY tail, actual::DATE ORDER BY actual, row_id)),
c AS (SELECT a.row_id, a.airport, a.delay, leg, acc, (SELECT count(*) FROM e WHERE e.airport = a.airport AND e.scheduled BETWEEN a.actual - INTERVAL 30 MINUTE AND a.actual + INTERVAL 30 MINUTE) AS around,
  (SELECT count(*) FROM e WHERE e.airport = a.airport AND e.actual >= a.actual - INTERVAL 60 MINUTE AND e.actual < a.actual) AS hour_before, (SELECT count(*) FROM e WHERE e.airport = a.airport AND e.scheduled >= a.actual - INTERVAL 60 MINUTE AND e.scheduled < a.actual) AS planned,
  (SELECT count(*) FROM e WHERE e.late = 1 AND e.airport = a.airport AND e.scheduled >= a.actual - INTERVAL 60 MINUTE AND e.scheduled < a.actual) AS bad FROM a LEFT JOIN l USING (row_id))
SELECT row_id, round(delay, 6) AS arrival_delay, leg, (leg = 1)::INT AS is_first, round(acc, 6) AS accumulated_delay, round(around / {CAPACITY.format('airport')}, 9) AS load, (around / {CAPACITY.format('airport')} >= 0.85)::INT AS is_parallel, hour_before AS flights_last_hour,
       round(CASE WHEN planned > 0 THEN bad / planned ELSE 0 END, 9) AS density_disruption FROM c""")
def arrival_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flights(spark, sf_dir)
    found = turnaround.arrival_side(rows.filter("mode = 'arrival'"), rows)
    rounded = [F.round(c, k).alias(c) for c, k in (("arrival_delay", 6), ("accumulated_delay", 6), ("load", 9), ("density_disruption", 9))]
    return found.select("row_id", "leg", "is_first", "is_parallel", "flights_last_hour", *rounded)


@register("flight_eligibility", FLIGHTS + """
SELECT row_id, mode, mode = 'departure' AND category = 'passenger' AND target IS NOT NULL AND NOT is_imputed AS for_training, scheduled < TIMESTAMP '2024-01-02 06:00:00' AS is_train FROM (
  SELECT *, (epoch_us(actual) - epoch_us(scheduled)) AS target FROM flights) WHERE tail IS NOT NULL AND CASE mode WHEN 'arrival' THEN actual ELSE scheduled END IS NOT NULL""")
def flight_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flights(spark, sf_dir).filter(F.col("tail").isNotNull() & F.when(F.col("mode") == "arrival", F.col("actual")).otherwise(F.col("scheduled")).isNotNull())
    target = minutes_between(F.col("actual"), F.col("scheduled"))
    chosen = (F.col("mode") == "departure") & (F.col("category") == "passenger") & target.isNotNull() & ~F.col("is_imputed")
    return rows.select("row_id", "mode", chosen.alias("for_training"), (F.col("scheduled") < F.lit("2024-01-02 06:00:00").cast("timestamp_ntz")).alias("is_train"))


@register("live_state", """
SELECT event_id, round(least(1.0, CASE WHEN event_id % 6 = 0 THEN 0.0 ELSE value / 40 END / 15 + CASE WHEN event_id % 7 = 0 THEN 12.0 ELSE value / 10 END / 60), 9) AS live_risk, round(l, 6) AS load, round(12 + 0.4 * greatest(0, l - 50), 6) AS taxi
FROM (SELECT *, least(98.0, CASE WHEN hour(ts) * 60 + minute(ts) BETWEEN 420 AND 540 OR hour(ts) * 60 + minute(ts) BETWEEN 990 AND 1170 THEN 80.0 ELSE 55.0 END + 0.8 * value) AS l FROM events)""")
def live_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    from windrose.functions.times import is_peak

    i, v = F.col("event_id"), F.col("value")
    load = rules.expected_load(is_peak(F.col("ts")), v)
    risk = rules.live_risk(F.when(i % 6 > 0, v / 40), F.when(i % 7 > 0, v / 10))
    return events(spark, sf_dir).select("event_id", F.round(risk, 9).alias("live_risk"), F.round(load, 6).alias("load"), F.round(rules.taxi_minutes(load), 6).alias("taxi"))
