"""Tables written and read back by every reader and writer; each query's folder lies in spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from windrose.functions import times
from windrose.operators import matching
from windrose.plans.temporal_queries import events
from windrose.registry import register
from windrose.sources import tables


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; one of our own only where everything runs here."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(base or tempfile.mkdtemp(prefix='windrose-')).rstrip('/')}/tables-{uuid.uuid4().hex}"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    shown = F.when(k % 7 == 0, None).when(k % 7 == 1, 'says "hi", twice').otherwise(F.col("c_name"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", shown.alias("name"), "c_nationkey", "c_acctbal", F.when(k % 5 == 0, "nan").otherwise(F.col("c_mktsegment")).alias("segment"))


@register("csv_round_trip", """
SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'says "hi", twice' ELSE c_name END AS name, c_nationkey, c_acctbal, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS segment FROM customer""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    df = _customers(spark, sf_dir)
    tables.write_csv(tables.for_export(df), path, mark=True)
    return tables.read_csv(spark, path, StructType.fromDDL("c_custkey bigint, name string, c_nationkey int, c_acctbal double, segment string"), tables.REPORT_WORDS)


@register("csv_as_text", """
SELECT c_custkey::VARCHAR AS c_custkey, coalesce(CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'says "hi", twice' ELSE c_name END, 'N/A') AS name, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment ELSE 'nan' END AS segment FROM customer""")
def csv_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    tables.write_csv(tables.for_export(_customers(spark, sf_dir), drop=["c_nationkey", "c_acctbal"]), path)
    return tables.read_csv(spark, path, ["c_custkey", "name", "segment"])


@register("files_with_origin", """
SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN value END AS value, 'part-' AS source FROM events WHERE event_type IN ('error', 'signup')""")
def files_with_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for kind, columns in (("error", ["event_id", "event_type", "value"]), ("signup", ["event_id", "event_type"])):
        path = f"{folder(spark)}/{kind}.parquet"
        events(spark, sf_dir, kind).select(*columns).write.parquet(path)
        parts.append(tables.with_origin(tables.read_any(spark, tables.present(spark, [path])[0])))
    return tables.together(parts).select("event_id", "event_type", "value", F.substring("source_file", 1, 5).alias("source"))


@register("hourly_json", """
SELECT user_id, strftime(ts, '%Y-%m-%dT%H:%M') AS time, event_id::DOUBLE AS id, value FROM events""")
def hourly_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("time"), F.col("event_id").cast("double").alias("id"), "value")
    #: One answer for each user and day, as a service sends them.
    bodies = events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_list(item).alias("x"))
    bodies = bodies.select("user_id", F.to_json(F.struct(F.struct(*(F.col(f"x.{c}").alias(c) for c in ("time", "id", "value"))).alias("hourly"))).alias("body"))
    path = folder(spark) + ".json"
    bodies.write.json(path)
    read = tables.read_any(spark, path, StructType.fromDDL("user_id bigint, body string"))
    return read.select("user_id", F.explode(tables.hourly_rows(F.col("body"), ["id", "value"])).alias("r")).select("user_id", "r.time", "r.id", "r.value")


@register("schedule_cache", """
SELECT 'VN' || user_id AS flight, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M') AS std, count(*) AS n FROM events GROUP BY ALL""")
def schedule_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    flight = F.concat(F.lit("VN"), F.col("user_id").cast("string"))
    leg = F.struct(F.date_format("ts", "HH:mm").alias("std"), F.lit(None).cast("string").alias("atd"))
    days = events(spark, sf_dir).groupBy(flight.alias("flight"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.collect_list(leg).alias("legs"))
    cache = days.groupBy("flight").agg(F.map_from_entries(F.collect_list(F.struct("day", "legs"))).alias("schedule")).select(F.to_json(F.create_map("flight", F.struct("schedule"))).alias("body"))
    path = folder(spark)
    cache.write.text(path)
    cache = spark.read.text(path).withColumnRenamed("value", "body")
    flights = cache.select(F.explode(tables.cached_schedule(F.col("body"))).alias("flight", "x")).select("flight", F.explode("x.schedule").alias("day", "legs"))
    return flights.select("flight", "day", F.explode("legs.std").alias("std")).groupBy("flight", "day", "std").agg(F.count("*").alias("n"))


@register("layer_by_partition", """
SELECT event_id, event_type, user_id % 3 AS airport, value + CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS value FROM events""")
def layer_by_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = folder(spark), events(spark, sf_dir).select("event_id", "event_type", (F.col("user_id") % 3).alias("airport"), "value")
    tables.write_layer(rows, path, ["event_type", "airport"])
    tables.write_layer(rows.filter("event_type = 'view'").withColumn("value", F.col("value") + 1), path, ["event_type", "airport"])
    return spark.read.schema(rows.schema).parquet(path)


@register("resumed_sink", """
SELECT event_id, value * 2 AS twice, CASE WHEN event_id % 3 = 0 THEN 'first' ELSE 'second' END AS run FROM events""")
def resumed_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = folder(spark), events(spark, sf_dir).select("event_id", "value")
    work = lambda run: lambda df: df.select("event_id", (F.col("value") * 2).alias("twice"), F.lit(run).alias("run"))
    tables.resumed(rows.filter("event_id % 3 = 0"), path, ["event_id"], work("first"), None)
    return tables.resumed(rows, path, ["event_id"], work("second"), spark.read.parquet(path))


@register("drop_audit", """
SELECT * FROM (VALUES (0, 'o_clerk', TRUE, (SELECT count(*) FROM orders)), (1, 'O_CLERK', FALSE, 0), (2, 'gone', FALSE, 0), (3, 'late', TRUE, (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0))) AS x(place, "column", was_there, n_values)""")
def drop_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("late", F.when(F.col("o_orderkey") % 3 == 0, 1))
    rest, audit = tables.dropped(rows.select("o_orderkey", F.coalesce("o_orderpriority", F.lit("?")).alias("o_clerk"), "late"), ["o_clerk", "O_CLERK", "gone", "late"])
    if rest.columns != ["o_orderkey"]:
        raise AssertionError(f"left over: {rest.columns}")
    return audit


@register("first_files_with_rows", """
SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type, event_id // 1000 ORDER BY event_id) - 1 AS source_row FROM events WHERE event_type IN ('error', 'signup')""")
def first_files_with_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each kind the first folder that a pattern finds, with each row's number in its file."""
    base, parts = folder(spark), []
    for kind in ("error", "signup"):
        rows = events(spark, sf_dir, kind).select("event_id", "event_type", F.expr("event_id div 1000").alias("part"))
        for version in ("a", "b"):
            #: A file for each thousand ids, in order; the second folder is one that must not be read.
            kept = rows if version == "a" else rows.filter("event_id < 0")
            #: The writer sorts by folder unless the rows already are, and an order within that would be lost.
            kept.repartition("part").sortWithinPartitions("part", "event_id").write.partitionBy("part").parquet(f"{base}/{kind}_{version}.parquet")
    for path in tables.first_match(spark, [f"{base}/{kind}_*.parquet" for kind in ("error", "signup")]):
        parts.append(tables.with_rows(spark.read.parquet(path)))
    return tables.together(parts).select("event_id", "event_type", "source_row")


@register("export_in_order", """
SELECT event_id, row_number() OVER (ORDER BY event_type, user_id % 5 DESC, value NULLS LAST, event_id) - 1 AS place FROM events""")
def export_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "event_type", "user_id", "value")
    order = [F.col("event_type").asc(), (F.col("user_id") % 5).desc(), F.col("value").asc_nulls_last(), F.col("event_id").asc()]
    return tables.write_in_order(rows, folder(spark), order).select("event_id", "place")


@register("leg_durations", """
WITH e AS (SELECT event_id, ts, event_id % 24 || ':' || lpad((event_id % 60)::VARCHAR, 2, '0') AS long, (event_id * 7) % 1440 AS m FROM events)
SELECT event_id, CASE WHEN event_id % 11 > 0 THEN (event_id % 24) * 60 + event_id % 60 END AS minutes, ts::DATE + to_minutes(m) + CASE WHEN ts::DATE + to_minutes(m) < ts THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS landed FROM e""")
def leg_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations of H:MM, and landing clocks that belong to the next day where they are before the departure."""
    i = F.col("event_id")
    text = F.when(i % 11 > 0, F.format_string(" %d:%02d", i % 24, i % 60)).otherwise("1h30")
    clock = F.format_string("%02d:%02d", ((i * 7) % 1440 / 60).cast("int"), (i * 7) % 60)
    landed = times.after_anchor(times.parse_on_date(F.to_date("ts"), clock), F.col("ts"))
    return events(spark, sf_dir).select("event_id", times.duration_minutes(text).alias("minutes"), landed.alias("landed"))


@register("previous_day_match", """
WITH r AS (SELECT event_id, user_id % 40 AS k, ts::DATE AS day, strftime(ts, '%H:%M') AS atd, CASE WHEN event_id % 3 > 0 THEN lpad((event_id % 24)::VARCHAR, 2, '0') || ':00' END AS std FROM events WHERE event_type = 'purchase'),
l AS (SELECT event_id AS leg, user_id % 40 AS k, ts::DATE AS day, strftime(ts, '%H:%M') AS atd, lpad((event_id % 24)::VARCHAR, 2, '0') || ':00' AS std FROM events WHERE event_type = 'error' AND day(ts) % 3 > 0),
j AS (SELECT r.event_id, l.leg, l.day, l.day < r.day AS before, CASE WHEN l.std = r.std THEN 0 WHEN l.atd = r.atd THEN 1 ELSE 2 END AS rank, l.std > r.atd AS past, row_number() OVER (PARTITION BY r.event_id ORDER BY l.day < r.day, CASE WHEN l.std = r.std THEN 0 WHEN l.atd = r.atd THEN 1 ELSE 2 END, l.leg) AS n
      FROM r JOIN l ON l.k = r.k AND l.day IN (r.day, r.day - 1))
SELECT r.event_id, j.leg, j.day AS leg_day FROM r LEFT JOIN j ON j.event_id = r.event_id AND n = 1 AND (NOT before OR rank < 2 OR past)""")
def previous_day_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock = F.concat(F.lpad((F.col("event_id") % 24).cast("string"), 2, "0"), F.lit(":00"))
    side = lambda kind: events(spark, sf_dir, kind).select("event_id", (F.col("user_id") % 40).alias("k"), F.to_date("ts").alias("day"), F.date_format("ts", "HH:mm").alias("atd"), clock.alias("std"))
    records = side("purchase").withColumn("std", F.when(F.col("event_id") % 3 > 0, F.col("std")))
    legs = side("error").filter(F.dayofmonth("day") % 3 > 0).withColumnRenamed("event_id", "leg")
    return matching.best_leg(records, legs, ["k"], "event_id", "day", "std", "atd", "leg", ["leg"]).select("event_id", "leg", "leg_day")


@register("empty_audit", """
SELECT 0::BIGINT AS n_rows, 'row_id,reason' AS columns""")
def empty_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    tables.write_csv(events(spark, sf_dir).filter("value < 0").select(F.col("event_id").alias("row_id"), F.lit("none").alias("reason")), path)
    read = spark.read.option("header", True).csv(path)
    return read.agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(",".join(read.columns)).alias("columns"))


@register("export_order", """
SELECT event_id, row_number() OVER (PARTITION BY ts::DATE ORDER BY event_type, user_id % 5 DESC, abs(value - 50), value NULLS LAST, event_id)::BIGINT AS place FROM events""")
def export_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as an export orders them, numbered within the file of their day."""
    order = Window.partitionBy(F.to_date("ts")).orderBy("event_type", F.desc(F.col("user_id") % 5), F.abs(F.col("value") - 50), F.asc_nulls_last("value"), "event_id")
    return events(spark, sf_dir).select("event_id", F.row_number().over(order).cast("bigint").alias("place"))
