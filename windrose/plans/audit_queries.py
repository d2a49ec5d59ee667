"""Profiles, summaries, patches and page rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windrose.functions import clean, rules, times
from windrose.operators import flights as repair
from windrose.operators import profile
from windrose.plans.flight_queries import FLIGHTS, flights
from windrose.plans.temporal_queries import events
from windrose.registry import register
from windrose.sources import html_tables
from windrose.sources.pages import aircraft_and_tail, term_value
from windrose.sources.pages import board_rows as html_rows
from windrose.sources.pages import detail_fields as panel_fields
from windrose.sources.pages import history_rows as table_rows

COLUMNS = ["flight_no", "tail", "actual", "scheduled", "runway"]
PAGES = ("SGN", "HAN", "DAD")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("missing_by_file", FLIGHTS + "," + f"""m AS (SELECT airport || '_' || mode AS file, unnest({COLUMNS}) AS "column", unnest([{', '.join(f'({c} IS NULL)::INT' for c in COLUMNS)}]) AS gone FROM flights)
SELECT file, "column", count(*) AS n, sum(gone)::BIGINT AS missing, round(100 * avg(gone), 6) AS percent FROM m GROUP BY 1, 2""")
def missing_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flights(spark, sf_dir).select(F.concat_ws("_", "airport", "mode").alias("file"), *(F.col(c).isNull().cast("int").alias(c) for c in COLUMNS))
    return rows.unpivot("file", COLUMNS, "column", "gone").groupBy("file", "column").agg(F.count("*").alias("n"), F.sum("gone").alias("missing"), F.round(100 * F.avg("gone"), 6).alias("percent"))


@register("top_rates", FLIGHTS + ",v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value FROM flights" for c in ("flight_no", "tail", "runway", "status")) + """),
c AS (SELECT "column", value, count(*) AS n FROM v GROUP BY 1, 2)
SELECT "column", sum(n)::BIGINT AS n, count(value) AS n_distinct, round(max(CASE WHEN value IS NOT NULL THEN n END) / sum(CASE WHEN value IS NOT NULL THEN n END), 9) AS top_rate, round(coalesce(sum(CASE WHEN value IS NULL THEN n END), 0) / sum(n), 9) AS missing_rate FROM c GROUP BY 1""")
def top_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by column and value come first, so no task holds a column's values."""
    names = ["flight_no", "tail", "runway", "status"]
    counts = flights(spark, sf_dir).select(*names).unpivot([], names, "column", "value").groupBy("column", "value").agg(F.count("*").alias("n"))
    known = F.when(F.col("value").isNotNull(), F.col("n"))
    out = counts.groupBy("column").agg(F.sum("n").alias("n"), F.count("value").alias("n_distinct"), F.max(known).alias("most"), F.sum(known).alias("known"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("gone"))
    return out.select("column", "n", "n_distinct", F.round(F.try_divide(F.col("most"), F.col("known")), 9).alias("top_rate"), F.round(F.col("gone") / F.col("n"), 9).alias("missing_rate"))


@register("high_correlations", """
WITH c AS (SELECT l_quantity AS a, l_extendedprice AS b, l_quantity * l_extendedprice AS c, l_discount AS d, l_discount * 3 + 1 AS e FROM lineitem),
p AS (SELECT 'a' AS one, 'b' AS two, corr(a, b) AS r FROM c UNION ALL SELECT 'a', 'c', corr(a, c) FROM c UNION ALL SELECT 'a', 'd', corr(a, d) FROM c UNION ALL SELECT 'a', 'e', corr(a, e) FROM c UNION ALL SELECT 'b', 'c', corr(b, c) FROM c
  UNION ALL SELECT 'b', 'd', corr(b, d) FROM c UNION ALL SELECT 'b', 'e', corr(b, e) FROM c UNION ALL SELECT 'c', 'd', corr(c, d) FROM c UNION ALL SELECT 'c', 'e', corr(c, e) FROM c UNION ALL SELECT 'd', 'e', corr(d, e) FROM c)
SELECT one, two, round(r, 6) AS r FROM p WHERE abs(r) >= 0.9""")
def high_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of columns in one pass, then those of 0.90 and more."""
    q, x, d = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount")
    rows = _table(spark, sf_dir, "lineitem").select(q.alias("a"), x.alias("b"), (q * x).alias("c"), d.alias("d"), (d * 3 + 1).alias("e"))
    pairs = [(m, n) for i, m in enumerate(rows.columns) for n in rows.columns[i + 1 :]]
    one = rows.agg(F.array(*(F.struct(F.lit(m).alias("one"), F.lit(n).alias("two"), profile.correlation(F.col(m), F.col(n)).alias("r")) for m, n in pairs)).alias("p"))
    return one.select(F.inline("p")).filter("abs(r) >= 0.9").withColumn("r", F.round("r", 6))


@register("imputation_by_group", FLIGHTS + """
SELECT tail, count(*) AS n, sum((runway = usual)::INT)::BIGINT AS right, round(avg((runway = usual)::INT), 9) AS accuracy FROM flights WHERE runway IS NOT NULL GROUP BY 1""")
def imputation_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the usual runway is the right one, by aircraft; the null aircraft is a group too."""
    hit = (F.col("runway") == repair.usual_runway(0)).cast("int")
    return flights(spark, sf_dir).filter("runway IS NOT NULL").groupBy("tail").agg(F.count("*").alias("n"), F.sum(hit).alias("right"), F.round(F.avg(hit), 9).alias("accuracy"))


@register("dedup_summary", """
WITH k AS (SELECT event_type, user_id, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, sum(n)::BIGINT AS n_rows, sum(n - 1)::BIGINT AS n_dropped, max(n) AS largest FROM k GROUP BY 1""")
def dedup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = events(spark, sf_dir).groupBy("event_type", "user_id", F.date_trunc("hour", "ts")).agg(F.count("*").alias("n"))
    return groups.groupBy("event_type").agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("n_dropped"), F.max("n").alias("largest"))


@register("label_accuracy", """
SELECT count(*) AS n, round(avg((quality = (length(text) > 1500)::INT)::INT), 9) AS accuracy FROM labels JOIN documents USING (doc_id)""")
def label_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents"), "doc_id")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg((F.col("quality") == (F.length("text") > 1500).cast("int")).cast("int")), 9).alias("accuracy"))


@register("human_and_model_labels", """
WITH h AS (SELECT event_id, user_id, floor(value)::DOUBLE AS delay FROM events WHERE event_type = 'error'), m AS (SELECT user_id, floor(value)::DOUBLE AS delay, min(event_id) AS code FROM events WHERE event_type <> 'error' GROUP BY 1, 2)
SELECT event_id, 'Flight: VN' || user_id AS said, coalesce(code::VARCHAR, 'MISSING') AS code FROM h LEFT JOIN m USING (user_id, delay)""")
def human_and_model_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flight and delay are read back from what annotators saw, joined with the model's codes, first one kept by id."""
    shown = F.format_string("Flight: VN%d | Delay: %.1f minutes.", F.col("user_id"), F.floor("value").cast("double"))
    human = events(spark, sf_dir, "error").select("event_id", shown.alias("text"))
    flight, delay = (F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in (r"Flight: (\w+)", r"Delay: ([\d.]+) minutes"))
    human = human.select("event_id", flight.alias("flight"), delay.cast("double").alias("delay"))
    model = events(spark, sf_dir).filter("event_type <> 'error'").select(F.concat(F.lit("VN"), F.col("user_id").cast("string")).alias("flight"), F.floor("value").cast("double").alias("delay"), F.col("event_id").alias("code"))
    first = Window.partitionBy("event_id").orderBy(F.asc_nulls_last("code"))
    both = human.join(model, ["flight", "delay"], "left").withColumn("place", F.row_number().over(first)).filter("place = 1")
    return both.select("event_id", F.concat(F.lit("Flight: "), "flight").alias("said"), F.coalesce(F.col("code").cast("string"), F.lit("MISSING")).alias("code"))


@register("tail_patch", """
WITH seen AS (SELECT user_id, ts::DATE AS day, hour(ts) AS std, min_by('A' || (event_id % 30), event_id) AS tail FROM events WHERE event_type = 'view' GROUP BY ALL), kinds AS (SELECT 'A' || k AS tail, 'type' || (k % 4) AS kind FROM range(30) r(k)),
d AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN 'A' || (event_id % 30) END AS tail FROM events WHERE event_type = 'purchase')
SELECT event_id, coalesce(d.tail, seen.tail) AS tail, kind FROM d LEFT JOIN seen ON seen.user_id = d.user_id AND seen.day = d.ts::DATE AND seen.std = hour(d.ts) LEFT JOIN kinds ON kinds.tail = coalesce(d.tail, seen.tail)""")
def tail_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tails by flight, day and hour of the first record seen, only where there is none; then the type by tail."""
    tail = F.concat(F.lit("A"), (F.col("event_id") % 30).cast("string"))
    keys = ["user_id", F.to_date("ts").alias("day"), F.hour("ts").alias("std")]
    seen = events(spark, sf_dir, "view").groupBy(*keys).agg(F.min_by(tail, "event_id").alias("seen_tail"))
    rows = events(spark, sf_dir, "purchase").select("event_id", *keys, F.when(F.col("event_id") % 3 == 0, tail).alias("tail"))
    rows = rows.join(seen, ["user_id", "day", "std"], "left").select("event_id", F.coalesce("tail", "seen_tail").alias("tail"))
    #: 30 aircraft.
    kinds = spark.range(30).select(F.concat(F.lit("A"), F.col("id").cast("string")).alias("tail"), F.concat(F.lit("type"), (F.col("id") % 4).cast("string")).alias("kind"))
    return rows.join(F.broadcast(kinds), "tail", "left").select("event_id", "tail", "kind")


@register("estimated_departure_patch", """
WITH mean AS (SELECT user_id, floor(avg(floor(value))) AS mins FROM events WHERE event_type = 'view' AND user_id % 4 > 0 GROUP BY 1), seen AS (SELECT user_id, ts::DATE AS day, min(event_id) AS tail FROM events WHERE event_type = 'signup' GROUP BY 1, 2)
SELECT e.event_id, (e.ts - coalesce(mins, 90)::BIGINT * INTERVAL 1 MINUTE)::DATE AS day, seen.tail FROM events e LEFT JOIN mean USING (user_id) LEFT JOIN seen ON seen.user_id = e.user_id AND seen.day = (e.ts - coalesce(mins, 90)::BIGINT * INTERVAL 1 MINUTE)::DATE WHERE e.event_type = 'error'""")
def estimated_departure_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day of departure is that of the arrival less the flight's mean duration (90 minutes if unknown)."""
    mean = events(spark, sf_dir, "view").filter("user_id % 4 > 0").groupBy("user_id").agg(F.floor(F.avg(F.floor("value"))).alias("mins"))
    seen = events(spark, sf_dir, "signup").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("event_id").alias("tail"))
    rows = events(spark, sf_dir, "error").join(mean, "user_id", "left")
    left = F.col("ts") - F.make_dt_interval(mins=F.coalesce("mins", F.lit(90)).cast("int"))
    return rows.select("event_id", "user_id", F.to_date(left).alias("day")).join(seen, ["user_id", "day"], "left").select("event_id", "day", "tail")


@register("canonical_times", """
WITH r AS (SELECT event_id, ts::DATE AS d, (['SGN', 'HAN', 'DAD'])[event_id % 3 + 1] AS airport, CASE WHEN event_id % 2 = 0 THEN 'arrival' ELSE 'departure' END AS mode, CASE WHEN event_id % 11 > 0 THEN strptime(strftime(ts, '%Y-%m-%d ') || strftime(ts - INTERVAL 95 MINUTE, '%H:%M'), '%Y-%m-%d %H:%M') END AS p, strptime(strftime(ts, '%Y-%m-%d %H:%M'), '%Y-%m-%d %H:%M') AS a FROM events),
n AS (SELECT *, CASE WHEN p - a > INTERVAL 12 HOUR THEN -1 WHEN a - p > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS k FROM r)
SELECT event_id, CASE WHEN airport = 'DAD' THEN p WHEN mode = 'arrival' THEN NULL ELSE p + k * INTERVAL 1 DAY END AS scheduled, CASE WHEN airport = 'DAD' THEN a - k * INTERVAL 1 DAY ELSE a END AS actual, coalesce(CASE WHEN airport = 'DAD' THEN p ELSE a END::DATE, d) AS day FROM n""")
def canonical_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    airport = F.element_at(F.array(*map(F.lit, PAGES)), (i % 3 + 1).cast("int"))
    clock = F.when(i % 11 > 0, F.date_format(F.col("ts") - F.expr("INTERVAL 95 MINUTE"), "HH:mm"))
    found = times.canonical_times(airport, F.when(i % 2 == 0, "arrival").otherwise("departure"), F.to_date("ts"), clock, F.date_format("ts", "HH:mm"))
    return events(spark, sf_dir).select("event_id", *(c.alias(n) for n, c in found.items()))


@register("clock_and_day_rules", """
WITH c AS (SELECT event_id, ts, ts - floor(value)::BIGINT * INTERVAL 7 MINUTE AS ref, (['SGN', 'HAN', 'DAD'])[event_id % 3 + 1] AS airport, CASE WHEN event_id % 9 = 0 THEN 'late' ELSE ltrim(strftime(ts, '%H:%M'), '0') END AS clock FROM events),
g AS (SELECT *, (epoch_us(ts) - epoch_us(ref)) / 3600000000.0 AS h FROM c)
SELECT event_id, CASE WHEN regexp_matches(clock, '^\\d{1,2}:\\d{2}$') THEN split_part(clock, ':', 1)::INT * 60 + split_part(clock, ':', 2)::INT ELSE -1 END AS minutes, round(CASE WHEN abs(h - 24) <= abs(h) AND abs(h - 24) <= abs(h + 24) THEN h - 24 WHEN abs(h) <= abs(h + 24) THEN h ELSE h + 24 END, 6) AS gap_hours,
       coalesce((CASE WHEN airport = 'DAD' THEN ref WHEN event_id % 4 > 0 THEN ts END)::DATE, (ts - INTERVAL 1 DAY)::DATE) AS day, round_even(h, 0)::BIGINT AS half_even, trunc(h)::BIGINT AS truncated FROM g""")
def clock_and_day_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, ts = F.col("event_id"), F.col("ts")
    ref = ts - F.make_dt_interval(mins=(F.floor("value") * 7).cast("int"))
    airport = F.element_at(F.array(*map(F.lit, PAGES)), (i % 3 + 1).cast("int"))
    clock = F.when(i % 9 == 0, "late").otherwise(F.ltrim(F.date_format("ts", "HH:mm"), F.lit("0")))
    hours = times.minutes_between(ts, ref) / 60
    day = times.crawl_day(airport, ref, F.when(i % 4 > 0, ts), ts - F.expr("INTERVAL 1 DAY"))
    return events(spark, sf_dir).select("event_id", times.clock_minutes(clock).alias("minutes"), F.round(times.nearest_day_gap(ts, ref), 6).alias("gap_hours"), day.alias("day"), F.bround(hours).cast("bigint").alias("half_even"), hours.cast("bigint").alias("truncated"))


@register("gate_and_terminal", """
WITH g AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '1.0' WHEN 1 THEN ' 2' WHEN 2 THEN '1' END AS hall, event_id % 13 AS n, (['SGN', 'HAN', 'DAD', 'VCA'])[event_id % 4 + 1] AS place, user_id % 3 > 0 AS domestic, CASE WHEN user_id % 5 = 0 THEN 'VJ' ELSE 'VN' END || user_id AS flight, CASE WHEN user_id % 7 = 0 THEN 'VietJet Air' ELSE 'Other' END AS airline, CASE WHEN event_id % 6 = 0 THEN 'Cargo' ELSE 'passenger' END AS category, CASE event_id % 5 WHEN 0 THEN '—' WHEN 1 THEN '4' WHEN 2 THEN 'Unknown' END AS shown FROM events),
j AS (SELECT *, CASE WHEN hall LIKE '1%' THEN CASE WHEN n IN (4, 5, 6, 7, 8) THEN 1 WHEN n IN (1, 2, 3, 9, 10, 11) THEN 0 END WHEN hall = ' 2' THEN CASE WHEN n IN (4, 5, 6, 7) THEN 1 WHEN n IN (1, 2, 3, 8, 9, 10) THEN 0 END END AS jet,
  CASE WHEN NOT domestic THEN '2' WHEN place IN ('DAD', 'HAN') THEN '1' WHEN place = 'SGN' THEN CASE WHEN flight LIKE 'VJ%' OR airline = 'VietJet Air' THEN '1' ELSE '3' END ELSE 'N/A' END AS ruled FROM g)
SELECT event_id, jet AS is_jet_bridge, 1 - jet AS is_remote, ruled, CASE WHEN category = 'Cargo' THEN '0' WHEN shown = '4' THEN '4' ELSE ruled END AS terminal FROM j""")
def gate_and_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id")
    hall = F.when(i % 4 == 0, "1.0").when(i % 4 == 1, " 2").when(i % 4 == 2, "1")
    jet = rules.has_jet_bridge(hall, F.concat(F.lit("G"), (i % 13).cast("string")))
    at = F.element_at(F.array(*map(F.lit, (*PAGES, "VCA"))), (i % 4 + 1).cast("int"))
    ruled = rules.terminal(at, u % 3 > 0, F.concat(F.when(u % 5 == 0, "VJ").otherwise("VN"), u.cast("string")), F.when(u % 7 == 0, "VietJet Air").otherwise("Other"))
    shown = F.when(i % 5 == 0, "—").when(i % 5 == 1, "4").when(i % 5 == 2, "Unknown")
    return events(spark, sf_dir).select("event_id", jet.alias("is_jet_bridge"), (1 - jet).alias("is_remote"), ruled.alias("ruled"), rules.shown_terminal(F.when(i % 6 == 0, "Cargo").otherwise("passenger"), shown, ruled).alias("terminal"))


@register("board_rows", """
SELECT event_id // 50 AS page_id, event_id, '10:0' || (event_id % 10) AS scheduled, '1' || (event_id % 3) || ':30' AS actual, 'Ha Noi' AS city, 'HAN' AS iata FROM events WHERE event_id % 2 = 0
UNION ALL SELECT event_id // 50, event_id, '1' || (event_id % 3) || ':30', '1' || (event_id % 3) || ':30', NULL, NULL FROM events WHERE event_id % 2 = 1""")
def board_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards of many rows: a struck-out time is the scheduled one, else both are the same."""
    i = F.col("event_id")
    struck = F.when(i % 2 == 0, F.format_string("<del> 10:0%d </del>", i % 10)).otherwise("")
    place = F.when(i % 2 == 0, "<b>Ha  Noi</b> (HAN)").otherwise("somewhere")
    row = F.concat(F.lit("<TR class='x'><td>"), struck, F.format_string("1%d:30</td><td>", i % 3), place, F.lit("</td><td>"), i.cast("string"), F.lit("</td></tr>"))
    pages = events(spark, sf_dir).groupBy(F.expr("event_id div 50").alias("page_id")).agg(F.concat(F.lit("<table><tr><th>Time</th></tr>"), F.array_join(F.collect_list(row), "\n"), F.lit("</table>")).alias("html"))
    return html_rows(pages).select("page_id", F.get("cells", F.lit(2)).cast("bigint").alias("event_id"), "scheduled", "actual", "city", "iata")


@register("history_rows", """
SELECT event_id // 50 AS page_id, event_id::VARCHAR AS flight, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'B78X' END AS aircraft, CASE WHEN event_id % 5 IN (0, 1) THEN NULL ELSE 'VN-A' || (event_id % 9) END AS tail, CASE WHEN event_id % 4 > 0 THEN '10:00' END AS std FROM events""")
def history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    plane = F.when(i % 5 == 0, "—").when(i % 5 == 1, "B78X").otherwise(F.format_string("B78X (<a>VN-A%d</a>)", i % 9))
    row = F.concat(F.lit('<tr class=" data-row x"><td>'), i.cast("string"), F.lit("</td><td>"), plane, F.lit("</td><td>"), F.when(i % 4 == 0, "—").otherwise("10:00"), F.lit("</td></tr><tr class='note'><td>no row</td></tr>"))
    pages = events(spark, sf_dir).groupBy(F.expr("event_id div 50").alias("page_id")).agg(F.array_join(F.collect_list(row), "").alias("html"))
    found = table_rows(pages, {"flight": 0, "plane": 1, "std": 2})
    aircraft, tail = aircraft_and_tail(F.col("plane"))
    return found.select("page_id", "flight", aircraft.alias("aircraft"), tail.alias("tail"), "std")


@register("board_tables", """
WITH e AS (SELECT event_id AS i, event_id - event_id % 2 AS j FROM events)
SELECT i // 50 AS page_id, i AS event_id, '10:0' || (j % 10) AS scheduled, '1' || (j % 3) || ':30' AS actual, CASE WHEN i % 2 = 0 THEN 'Ha Noi' ELSE 'somewhere' END AS city, CASE WHEN i % 2 = 0 THEN 'HAN' END AS iata FROM e""")
def board_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards whose rows are not closed, share a time cell over two rows and hold tables of their own."""
    i = F.col("event_id")
    even = F.concat(F.format_string('<tr class="x datarows"><td rowspan=2><div class="del">10:0%d</div><div class="d-none">9:99</div><div>1%d:30</div><td>Ha <b>Noi</b> (HAN)<table><tr class=datarows-not><td>inner</table></td><td>', i % 10, i % 3), i.cast("string"))
    odd = F.concat(F.lit("<tr class='datarows'><td>somewhere<td> "), i.cast("string"), F.lit(" </tr>"))
    row = F.struct(i.alias("i"), F.when(i % 2 == 0, even).otherwise(odd).alias("row"))
    pages = events(spark, sf_dir).groupBy(F.expr("event_id div 50").alias("page_id")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    pages = pages.select("page_id", F.concat(F.lit("<table><tr><th>Time<th>From"), F.array_join(F.col("rows.row"), "\n"), F.lit("</table>")).alias("html"))
    return html_tables.board(pages).select("page_id", F.get("cells", F.lit(2)).cast("bigint").alias("event_id"), "scheduled", "actual", "city", "iata")


@register("detail_fields", """
SELECT event_id, event_type AS category, 'VN' || user_id AS flight, CASE WHEN event_id % 3 > 0 THEN 'VN-A' || user_id END AS tail, CASE WHEN event_id % 2 = 0 THEN '3' END AS terminal FROM events""")
def detail_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels of a tracking site: values of terms, texts of elements, the terminal after its term."""
    i = F.col("event_id")
    body = F.concat(
        F.lit('<div><dl data-testid="item__category"><dt>Category</dt><dd> '), F.col("event_type"), F.lit('</dd></dl><dl class="a" data-testid="item__flight"><dt>Flight</dt><dd>VN'), F.col("user_id").cast("string"), F.lit("</dd></dl>"),
        F.when(i % 3 > 0, F.concat(F.lit('<a href="#" data-testid="item__registration">VN-A'), F.col("user_id").cast("string"), F.lit("</a>"))).otherwise(""), F.when(i % 2 == 0, "<dl><dt>Terminal (T)</dt> <dd>3</dd></dl>").otherwise(""), F.lit("</div>"),
    )
    rows = events(spark, sf_dir).select("event_id", body.alias("html"))
    found = panel_fields(F.col("html"), {"category": "item__category", "flight": "item__flight", "tail": "item__registration"})
    return rows.select("event_id", *(c.alias(n) for n, c in found.items()), term_value(F.col("html"), "Terminal").alias("terminal"))


@register("schema_completion", """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '25R' END AS runway, strftime(ts, '%H:%M') AS scheduled_time, CAST(NULL AS VARCHAR) AS gate FROM events""")
def schema_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older name is taken over, missing columns come as null, invalid runways too, unwanted columns go."""
    rows = events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 4 == 0, " 25r").otherwise("99X").alias("runway"), F.date_format("ts", "HH:mm").alias("flight_time"), "value")
    rows = clean.completed(rows, ["scheduled_time", "gate"], {"flight_time": "scheduled_time"})
    rows, gone = clean.dropped(rows, ["value", "Runway"])
    return rows.withColumn("runway", clean.valid_or_null(F.col("runway"), clean.RUNWAY)) if gone == ["value"] else rows


@register("audit_removals", FLIGHTS + """,
bad AS (SELECT airport, row_id FROM flights WHERE row_id % 11 = 0)
SELECT f.row_id, f.airport, CASE f.airport WHEN 'SGN' THEN 'south' WHEN 'HAN' THEN 'north' END AS region, coalesce(f.tail, 'A' || (f.row_id % 5)) AS tail FROM flights f WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.airport = f.airport AND bad.row_id = f.row_id) AND f.airport IN ('SGN', 'DAD') AND f.mode = 'arrival'""")
def audit_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that an audit names go, a choice of airports and mode stays, a lookup names regions, an imputed table fills gaps."""
    rows = flights(spark, sf_dir)
    gone = rows.filter("row_id % 11 = 0").select("airport", "row_id")
    imputed = rows.select("row_id", F.concat(F.lit("A"), (F.col("row_id") % 5).cast("string")).alias("imputed_tail"))
    kept = rows.join(gone, ["airport", "row_id"], "left_anti").filter(F.col("airport").isin("SGN", "DAD") & (F.col("mode") == "arrival"))
    return kept.join(imputed, "row_id", "left").select("row_id", "airport", rules.lookup(F.col("airport"), {"SGN": "south", "HAN": "north"}).alias("region"), F.coalesce("tail", "imputed_tail").alias("tail"))


@register("column_lookup", """SELECT user_id, max(event_id) AS last_id, round(sum(value), 6) AS total, CAST(NULL AS VARCHAR) AS gate FROM events GROUP BY 1""")
def column_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures over columns by names that people write: the same but for case and signs, else the first that holds the name."""
    rows = events(spark, sf_dir)
    by, last, total, none = (clean.found_column(rows.columns, wanted) for wanted in (["User-ID"], ["Event ID"], ["minutes", "VAL"], ["gate"]))
    gate = F.lit(None).cast("string") if none is None else F.max(none)
    return rows.groupBy(F.col(by).alias("user_id")).agg(F.max(last).alias("last_id"), F.round(F.sum(total), 6).alias("total"), gate.alias("gate"))


@register("master_with_defaults", """SELECT event_id, coalesce(CASE WHEN event_id % 3 > 0 THEN value END, 0.0) AS value, 'CODE_99' AS code, user_id FROM events""")
def master_with_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A master table read with what it may lack: absent columns and nulls take their defaults."""
    rows = events(spark, sf_dir).select("event_id", "user_id", F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("value"))
    return clean.with_defaults(rows, {"value": 0.0, "code": "CODE_99"}).select("event_id", "value", "code", "user_id")
