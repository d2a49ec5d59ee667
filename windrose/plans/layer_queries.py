"""Layers that change and grow: copied on write, appended by streams, read by a source of their own, labelled by an annotator."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from windrose.operators import annotate
from windrose.plans.source_queries import folder
from windrose.plans.temporal_queries import events
from windrose.registry import register
from windrose.sources import weather
from windrose.sources.versioned import VersionedTable
from windrose.streaming import append


@register("upserted_orders", """
WITH s AS (SELECT l_orderkey, max((l_returnflag, l_linestatus)) AS x FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 3 = 0 GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority ELSE s.x[1] END AS priority, coalesce(s.x[2], o_orderstatus) AS status, 3 AS version FROM orders LEFT JOIN s ON l_orderkey = o_orderkey
UNION ALL SELECT -1 - l_orderkey, x[1], x[2], 3 FROM s WHERE l_orderkey % 50 = 0""")
def upserted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing priorities from the first item, then the status of it, and rows for keys that were not there; the third
    update changes nothing."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderpriority")).alias("priority"), F.col("o_orderstatus").alias("status"))
    table = VersionedTable(spark, folder(spark), StructType.fromDDL("o_orderkey bigint, priority string, status string"))
    table.append(orders.repartitionByRange(6, "o_orderkey"))
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_linenumber = 1 AND l_orderkey % 3 = 0")
    first = items.groupBy("l_orderkey").agg(F.max(F.struct("l_returnflag", "l_linestatus")).alias("x")).select(F.col("l_orderkey").alias("o_orderkey"), F.col("x.l_returnflag").alias("priority"), F.col("x.l_linestatus").alias("status"))
    table.upsert(first.drop("status"), ["o_orderkey"], only_missing=True, insert=False)
    both = first.drop("priority").unionByName(first.filter("o_orderkey % 50 = 0").withColumn("o_orderkey", -1 - F.col("o_orderkey")), allowMissingColumns=True)
    table.upsert(both, ["o_orderkey"])
    version, _ = table.upsert(both, ["o_orderkey"])
    return table.read().withColumn("version", F.lit(version))


@register("streamed_append", """
SELECT event_id, value * 2 AS twice, event_id % 4 IN (0, 1) AS in_first FROM events""")
def streamed_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over files that come in two lots, stopped in between and started again; the second lot repeats the first."""
    source, path, checkpoint = (folder(spark) for _ in range(3))
    rows = events(spark, sf_dir).select("event_id", "value")
    kind = StructType.fromDDL("event_id bigint, value double")
    for lot in ("event_id % 4 IN (0, 1)", "event_id % 4 > 0"):
        rows.filter(lot).repartition(3, "event_id").write.mode("append").parquet(source)
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 2).parquet(source)
        work = lambda df, lot=lot: df.select("event_id", (F.col("value") * 2).alias("twice"), F.lit(lot == "event_id % 4 IN (0, 1)").alias("in_first"))
        append.append_stream(stream, path, checkpoint, ["event_id"], work).awaitTermination()
    return append.stored(spark, path).drop(append.BATCH)


@register("weather_joined", """
WITH h AS (SELECT event_type AS airport, date_trunc('hour', ts) AS time, round(avg(value), 6) AS temperature, count(*)::DOUBLE AS visibility FROM events GROUP BY 1, 2)
SELECT airport, time, temperature, visibility FROM h WHERE airport IN ('click', 'view') AND hour(time) % 5 > 0 AND time >= TIMESTAMP '2024-01-03 06:00:00'""")
def weather_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of two kinds by place and month, as a service sends them; the forecast lacks every fifth hour."""
    path = folder(spark)
    hours = events(spark, sf_dir).groupBy(F.col("event_type").alias("place"), F.date_trunc("hour", "ts").alias("hour")).agg(F.round(F.avg("value"), 6).alias("temperature"), F.count("*").cast("double").alias("visibility"))
    for kind, measure, rows in (("archive", "temperature", hours), ("forecast", "visibility", hours.filter(F.hour("hour") % 5 > 0))):
        item = F.struct(F.date_format("hour", "yyyy-MM-dd'T'HH:mm").alias("time"), measure)
        months = rows.groupBy("place", F.date_format("hour", "yyyy-MM").alias("month")).agg(F.sort_array(F.collect_list(item)).alias("x"))
        body = F.to_json(F.struct(F.struct(F.col("x.time").alias("time"), F.col(f"x.{measure}").alias(measure)).alias("hourly")))
        months.select("place", "month", body.alias("value")).write.partitionBy("place", "month").text(f"{path}/{kind}")
    places = ["click", "error", "purchase", "signup", "view"]
    archive, forecast = (weather.hourly(spark, path, kind, places, [m], "2024-01-01", "2024-02-29") for kind, m in (("archive", "temperature"), ("forecast", "visibility")))
    joined = weather.archive_with_forecast(archive, forecast)
    return joined.filter(F.col("airport").isin("click", "view") & (F.col("time") >= F.lit("2024-01-03 06:00:00").cast("timestamp_ntz")))


def by_rule(questions: list[str]) -> list[str]:
    """Answers as a model gives them, by a rule: fenced, with words around them, or not to the point."""
    out = []
    for question in questions:
        k = json.loads(question)["k"]
        code = "CODE_71" if k >= 90 else "CODE_93" if k >= 40 else "CODE_89"
        body = json.dumps({"Delay_Code": code, "Reason": f"k is {k} {{so it is}}"})
        out.append((f"```json\n{body}\n```", f"Here: {body} as asked", body, "I do not know")[k % 4])
    return out


@register("annotated_delays", """
WITH e AS (SELECT event_id, value, json_extract_string(props, '$.k')::INT AS k FROM events),
c AS (SELECT *, CASE WHEN k % 4 = 3 THEN 'CODE_99' WHEN k >= 90 THEN 'CODE_71' WHEN k >= 40 THEN 'CODE_93' ELSE 'CODE_89' END AS code FROM e)
SELECT event_id, CASE WHEN value >= 15 THEN code ELSE '-1' END AS code, CASE WHEN value >= 15 AND k % 4 < 3 THEN 'k is ' || k || ' {so it is}' END AS reason FROM c""")
def annotated_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delays from 15 minutes are asked about, once for each question, in two runs over a growing table."""
    path = folder(spark)
    rows = events(spark, sf_dir).select("event_id", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    question = F.when(F.col("value") >= 15, F.to_json(F.struct("k")))
    annotate.annotated(rows.filter("k < 50"), question, by_rule, "rule", path)
    return annotate.annotated(rows, question, by_rule, "rule", path).select("event_id", F.coalesce("code", F.lit("-1")).alias("code"), "reason")
