"""Report tables of the weather over the event table, which stands for hours of three stations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrose.operators import tables
from windrose.plans.temporal_queries import events
from windrose.registry import register

WEATHER = """
WITH w AS (SELECT event_id, event_id % 3 AS airport, ts, CASE WHEN event_id % 7 > 0 THEN value END AS rain, round(value) AS wind, 12000 - value * 90 AS visibility, CAST(3 AS DOUBLE) AS flat, CASE WHEN value > 90 THEN 2 WHEN value > 50 THEN 1 ELSE 0 END AS risk FROM events)
"""
MEASURES = ["rain", "wind", "visibility", "flat"]


def _weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, v = F.col("event_id"), F.col("value")
    return events(spark, sf_dir).select("event_id", (i % 3).alias("airport"), "ts", F.when(i % 7 > 0, v).alias("rain"), F.round(v).alias("wind"), (12000 - v * 90).alias("visibility"), F.lit(3.0).alias("flat"), F.when(v > 90, 2).when(v > 50, 1).otherwise(0).alias("risk"))


def _of_each(select: str) -> str:
    return WEATHER + " UNION ALL ".join(select.replace("{c}", c) for c in MEASURES)


@register("threshold_candidates", _of_each("SELECT airport, '{c}' AS \"column\", " + ", ".join(f"round(quantile_cont({{c}}, {q}), 6) AS p{round(100 * q)}" for q in (0.5, 0.75, 0.9, 0.95, 0.99)) + ", max({c})::DOUBLE AS highest FROM w GROUP BY airport"))
def threshold_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables.threshold_candidates(_weather(spark, sf_dir), ["airport"], MEASURES)
    return out.select("airport", "column", "highest", *(F.round(c, 6).alias(c) for c in ("p50", "p75", "p90", "p95", "p99")))


@register("visibility_rates", WEATHER + "SELECT airport, count(*) AS n, " + ", ".join(f"count(*) FILTER (visibility < {t}) AS below_{t}, round(100.0 * count(*) FILTER (visibility < {t}) / count(*), 6) AS below_{t}_percent" for t in (10000, 5000, 3000)) + " FROM w GROUP BY 1")
def visibility_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables.below_rates(_weather(spark, sf_dir), ["airport"], "visibility", [10000, 5000, 3000])
    return out.select(*(F.round(c, 6).alias(c) if c.endswith("percent") else F.col(c) for c in out.columns))


@register("visibility_by_hour", WEATHER + "SELECT airport, " + ", ".join(f"round(coalesce(100.0 * count(*) FILTER (visibility < 10000 AND hour(ts) = {h}) / nullif(count(*) FILTER (hour(ts) = {h}), 0), 0), 6) AS h{h:02d}" for h in range(24)) + " FROM w GROUP BY 1")
def visibility_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables.hour_matrix(_weather(spark, sf_dir), "airport", "ts", "visibility", 10000)
    return out.select("airport", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@register("predictive_ranking", _of_each("SELECT '{c}' AS \"column\", round(100.0 * (count(*) - count({c})) / count(*), 6) AS missing_percent, count(DISTINCT {c}) AS n_distinct, CASE WHEN min({c}) < max({c}) THEN round(corr({c}, risk), 6) END AS correlation, round(avg({c}) FILTER (risk = 0), 6) AS mean_at_0, round(avg({c}) FILTER (risk >= 1), 6) AS mean_from_1, round(avg({c}) FILTER (risk >= 2), 6) AS mean_from_2 FROM w"))
def predictive_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables.predictive_ranking(_weather(spark, sf_dir), MEASURES, "risk")
    return out.select("column", "n_distinct", *(F.round(c, 6).alias(c) for c in out.columns if c not in ("column", "n_distinct")))


@register("feature_audit", _of_each("SELECT '{c}' AS \"column\", (count(*) - count({c}))::BIGINT AS missing, round(100.0 * (count(*) - count({c})) / count(*), 6) AS missing_percent, (count(DISTINCT {c}) + (count(*) > count({c}))::INT)::BIGINT AS n_distinct, (SELECT round(100.0 * max(n) / sum(n), 6) FROM (SELECT count(*) AS n FROM w GROUP BY {c})) AS top_percent, min({c})::DOUBLE AS lowest, max({c})::DOUBLE AS highest, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS deviation FROM w"))
def feature_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables.feature_audit(_weather(spark, sf_dir), MEASURES)
    return out.select("column", "missing", "n_distinct", "lowest", "highest", *(F.round(c, 6).alias(c) for c in ("missing_percent", "top_percent", "mean", "deviation")))


@register("flag_mismatches", WEATHER + "SELECT airport, count(*) AS n, count(*) FILTER (coalesce(rain > 40, FALSE) = (wind > 45)) AS same, count(*) FILTER (coalesce(rain > 40, FALSE) AND NOT wind > 45) AS first_only, count(*) FILTER (NOT coalesce(rain > 40, FALSE) AND wind > 45) AS second_only, round(100.0 * count(*) FILTER (coalesce(rain > 40, FALSE) <> (wind > 45)) / count(*), 6) AS mismatch_percent FROM w GROUP BY 1")
def flag_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _weather(spark, sf_dir).withColumns({"a": F.col("rain") > 40, "b": F.col("wind") > 45})
    return tables.mismatches(rows, ["airport"], "a", "b").withColumn("mismatch_percent", F.round("mismatch_percent", 6))
