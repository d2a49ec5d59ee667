"""Report tables over many measures at once: each measure is unpivoted, so one pass and one exchange serve all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrose.operators.profile import correlation, joined_by, quantiles_of, unpivoted


def threshold_candidates(df: DataFrame, on: Sequence[str], columns: Sequence[str], levels: Sequence[float] = (0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """By key and measure its exact quantiles and its largest value: candidates for thresholds."""
    cells, keys = unpivoted(df, columns, on), [*on, "column"]
    return joined_by(cells.groupBy(*keys).agg(F.max("value").alias("highest")), quantiles_of(cells, keys, "value", levels), keys)


def below_rates(df: DataFrame, on: Sequence[str], column: str, limits: Sequence[int]) -> DataFrame:
    """By key the rows, and for each limit how many lie below it, with their percentage; unknown values lie below none."""
    below = {t: F.count_if(F.col(column) < t) for t in limits}
    return df.groupBy(*on).agg(F.count("*").alias("n"), *(x.alias(f"below_{t}") for t, x in below.items()), *((x * 100.0 / F.count("*")).alias(f"below_{t}_percent") for t, x in below.items()))


def hour_matrix(df: DataFrame, on: str, ts: str, column: str, limit: float) -> DataFrame:
    """By key a column for each hour of the day with the percentage of rows below the limit; 0 where there are none."""
    rows = df.select(on, F.hour(ts).alias("_hour"), F.when(F.col(column) < limit, 100.0).otherwise(0.0).alias("_p"))
    return rows.groupBy(on).pivot("_hour", list(range(24))).agg(F.avg("_p")).na.fill(0.0).withColumnsRenamed({str(h): f"h{h:02d}" for h in range(24)})


def _distinct(cells: DataFrame) -> DataFrame:
    """By column the number of distinct known values, and the rows of the most frequent value, null being one."""
    counts = cells.groupBy("column", "value").agg(F.count("*").alias("n"))
    return counts.groupBy("column").agg(F.count("value").alias("n_distinct"), F.max("n").alias("top"))


def predictive_ranking(df: DataFrame, columns: Sequence[str], score: str) -> DataFrame:
    """By measure how it goes with a score of risk: missing share, distinct values, correlation (none for a constant), and the
    means where the score is 0, at least 1 and at least 2."""
    cells = unpivoted(df, columns, [score])
    s, v = F.col(score).cast("double"), F.col("value")
    both = v.isNotNull() & s.isNotNull()
    sums = cells.groupBy("column").agg(
        (F.count_if(v.isNull()) * 100.0 / F.count("*")).alias("missing_percent"), F.when(F.count_if(both) > 2, correlation(v, s)).alias("correlation"),
        F.avg(F.when(s == 0, v)).alias("mean_at_0"), F.avg(F.when(s >= 1, v)).alias("mean_from_1"), F.avg(F.when(s >= 2, v)).alias("mean_from_2"))
    return joined_by(sums, _distinct(cells.select("column", "value")), ["column"]).drop("top")


def feature_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """By measure: missing rows and share, distinct values (null being one), the share of the most frequent one, extremes,
    mean and deviation."""
    cells = unpivoted(df, columns)
    v = F.col("value")
    sums = cells.groupBy("column").agg(F.count_if(v.isNull()).alias("missing"), F.count("*").alias("n"), F.min(v).alias("lowest"), F.max(v).alias("highest"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("deviation"))
    out = joined_by(sums, _distinct(cells), ["column"])
    return out.select("column", "missing", (F.col("missing") * 100.0 / F.col("n")).alias("missing_percent"), (F.col("n_distinct") + (F.col("missing") > 0).cast("int")).alias("n_distinct"), (F.col("top") * 100.0 / F.col("n")).alias("top_percent"), "lowest", "highest", "mean", "deviation")


def mismatches(df: DataFrame, on: Sequence[str], a: str, b: str) -> DataFrame:
    """By key how often two flags say the same, and either says yes alone; unknown counts as no."""
    x, y = (F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in (a, b))
    return df.groupBy(*on).agg(F.count("*").alias("n"), F.count_if(x == y).alias("same"), F.count_if(x & ~y).alias("first_only"), F.count_if(~x & y).alias("second_only"), F.avg(F.when(x != y, 100.0).otherwise(0.0)).alias("mismatch_percent"))
