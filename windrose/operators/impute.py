"""Filling of gaps in ordered series, and clipping to what is physically possible or usual."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrose.functions.clean import clipped
from windrose.operators.profile import joined_by, quantiles_of
from windrose.operators.stretches import numbered_with_known


def filled_both_ways(df: DataFrame, on: Sequence[str], order_by: Sequence[str], column: str, name: str, bucket: int | None = None) -> DataFrame:
    """The last known value, else the next known one, else the most frequent of all (of several the smallest).

    With ``bucket`` (microseconds of the first of ``order_by``) a key's rows go to stretches of time.
    """
    mode = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_mode")).agg(F.count("*").alias("_m")).agg(F.min_by("_mode", F.struct((-F.col("_m")).alias("n"), "_mode")).alias("_mode"))
    out = numbered_with_known(df, on, order_by, bucket, column).withColumn(name, F.coalesce("_p.v", "_n.v")).drop("_i", "_p", "_n")
    return out.join(F.broadcast(mode), F.lit(True), "left").withColumn(name, F.coalesce(name, "_mode")).drop("_mode")


def interpolated(df: DataFrame, on: Sequence[str], order_by: Sequence[str], column: str, name: str, bucket: int | None = None) -> DataFrame:
    """Linear by row number between known neighbours; at the ends the nearest known value; else the median of all.

    A key with any known value has no gap left for its own median to fill, so that step has nothing to do. With ``bucket``
    (microseconds of the first of ``order_by``) a key's rows go to stretches of time.
    """
    found = numbered_with_known(df, on, order_by, bucket, column)
    share = F.try_divide((F.col("_i") - F.col("_p.i")).cast("double"), (F.col("_n.i") - F.col("_p.i")).cast("double"))
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * share
    filled = F.coalesce(F.col(column), line, F.col("_p.v"), F.col("_n.v"))
    #: Asked first, as it takes a count by key: a median takes an exchange of all values.
    if df.groupBy(*on).agg(F.count(column).alias("_known")).filter("_known = 0").isEmpty():
        return found.withColumn(name, filled).drop("_i", "_p", "_n")
    median = quantiles_of(df, [], column, [0.5]).withColumnRenamed("p50", "_median")
    out = found.withColumn(name, filled).join(F.broadcast(median), F.lit(True), "left")
    return out.withColumn(name, F.coalesce(name, "_median")).drop("_i", "_p", "_n", "_median")


def quartile_bounds(df: DataFrame, on: Sequence[str], column: str, factor: float = 3.0, least: int = 8) -> DataFrame:
    """Per key the bounds ``factor`` interquartile ranges beyond the quartiles; null for few rows or no spread."""
    q = quantiles_of(df, on, column, [0.25, 0.75]).withColumnsRenamed({"p25": "q1", "p75": "q3"})
    q = joined_by(df.groupBy(*on).agg(F.count(column).alias("n")), q, on)
    usable, spread = (F.col("n") >= least) & (F.col("q3") > F.col("q1")), F.col("q3") - F.col("q1")
    return q.select(*on, F.when(usable, F.col("q1") - factor * spread).alias("low"), F.when(usable, F.col("q3") + factor * spread).alias("high"))


def clipped_to_usual(df: DataFrame, on: Sequence[str], column: str, name: str, physical: tuple[float, float], factor: float = 3.0) -> DataFrame:
    """Clipped to the physical bounds, then to the quartile bounds of the key where it has any."""
    df = df.withColumn(name, clipped(F.col(column), *physical))
    bounds = quartile_bounds(df, on, name, factor)
    out = df.join(bounds, [*on], "left")
    return out.withColumn(name, F.when(F.col(name) < F.col("low"), F.col("low")).when(F.col(name) > F.col("high"), F.col("high")).otherwise(F.col(name))).drop("low", "high")


def outliers(df: DataFrame, on: Sequence[str], column: str, keep: Sequence[str], physical: tuple[float, float], factor: float = 3.0) -> DataFrame:
    """Rows beyond the physical or the quartile bounds, with the reason."""
    beyond_physical = (F.col(column) < physical[0]) | (F.col(column) > physical[1])
    beyond_usual = (F.col(column) < F.col("low")) | (F.col(column) > F.col("high"))
    out = df.join(quartile_bounds(df, on, column, factor), [*on], "left")
    reason = F.when(beyond_physical, "physical").when(beyond_usual, "quartile")
    return out.withColumn("reason", reason).filter("reason IS NOT NULL").select(*keep, "reason")
