"""Profiles of columns, distributions, shares, grids and transitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrose.operators.stretches import HALO, STRETCH, with_halo


def unpivoted(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., column, value): one row per numeric cell."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns))
    return df.select(*keep, F.explode(cells).alias("x")).select(*keep, "x.*")


def _same(on: Sequence[str]) -> Column:
    """The keys equal those that go by the names _k0, _k1, ...; nulls are equal."""
    out = F.lit(True)
    for i, c in enumerate(on):
        out &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return out


def in_parts(counts: DataFrame, on: Sequence[str], value: str, n: str, parts: int = 64) -> tuple[DataFrame, DataFrame]:
    """(on..., _part, _v, _m): the known values dealt over parts in order, by edges from a sketch; and each part's size with
    what lies ``_before`` it and the size of ``_all``. So no task has to hold or order all values of a key."""
    known = counts.filter(F.col(value).isNotNull())
    edges = known.groupBy(*on).agg(F.percentile_approx(value, F.array(*(F.lit(k / parts) for k in range(1, parts))), 1000).alias("_edges"))
    for i, c in enumerate(on):
        edges = edges.withColumnRenamed(c, f"_k{i}")
    dealt = known.join(edges, _same(on)).withColumn("_part", F.size(F.filter("_edges", lambda e: e < F.col(value)))).drop("_edges", *(f"_k{i}" for i in range(len(on)))).withColumnRenamed(value, "_v").withColumnRenamed(n, "_m")
    whole = Window.partitionBy(*on)
    before = F.coalesce(F.sum("_size").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = dealt.groupBy(*on, "_part").agg(F.sum("_m").alias("_size")).withColumn("_before", before).withColumn("_all", F.sum("_size").over(whole))
    return dealt, sums


def with_below(counts: DataFrame, on: Sequence[str], value: str, n: str) -> DataFrame:
    """``counts`` of known values with ``below``: how many rows of the key have a smaller value."""
    dealt, sums = in_parts(counts, on, value, n)
    for i, c in enumerate(on):
        sums = sums.withColumnRenamed(c, f"_k{i}")
    sums = sums.select(*(f"_k{i}" for i in range(len(on))), F.col("_part").alias("_p"), "_before")
    inside = Window.partitionBy(*on, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("_inside", F.coalesce(F.sum("_m").over(inside), F.lit(0))).join(sums, _same(on) & (F.col("_part") == F.col("_p")))
    rest = [c for c in counts.columns if c not in (*on, value, n)]
    return out.select(*on, F.col("_v").alias(value), F.col("_m").alias(n), *rest, (F.col("_before") + F.col("_inside")).alias("below"))


def quantiles(counts: DataFrame, on: Sequence[str], value: str, n: str, levels: Sequence[float]) -> DataFrame:
    """(on..., name of each level): exact quantiles, interpolated between ranks, of the values that ``counts`` holds n times each.

    Only the parts in which a wanted rank falls are put in order, each in a task of its own.
    """
    dealt, sums = in_parts(counts, on, value, n)
    same = _same(on)
    at = F.explode(F.array(*(F.struct(F.lit(i).alias("level"), (F.lit(float(q)) * (F.col("_all") - 1)).alias("place")) for i, q in enumerate(levels))))
    wanted = sums.select("*", at.alias("_x")).withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_x.place"), F.ceil("_x.place")))))
    wanted = wanted.filter("_rank >= _before AND _rank < _before + _size").select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(on)), F.col("_part").alias("_p"), F.col("_rank").cast("bigint").alias("_rank"), (F.col("_rank") - F.col("_before")).alias("_inside"), "_x.level", "_x.place")
    needed = wanted.select(*(f"_k{i}" for i in range(len(on))), "_p").distinct()
    here = F.col("_part") == F.col("_p")
    ordered = dealt.join(needed, same & here, "left_semi").withColumn("_upto", F.sum("_m").over(Window.partitionBy(*on, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    found = ordered.join(wanted, same & here & (F.col("_inside") < F.col("_upto")) & (F.col("_inside") >= F.col("_upto") - F.col("_m")))
    both = found.groupBy(*on, "level", "place").agg(F.min_by("_v", "_rank").alias("_low"), F.max_by("_v", "_rank").alias("_high"))
    line = F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("place") - F.floor("place"))
    return both.groupBy(*on).agg(*(F.max(F.when(F.col("level") == i, line)).alias(f"p{round(100 * q):02d}") for i, q in enumerate(levels)))


def quantiles_of(df: DataFrame, on: Sequence[str], value: str, levels: Sequence[float]) -> DataFrame:
    """``quantiles`` of a column's known values by key, as p25 and so on; null keys are keys."""
    counts = df.groupBy(*on, F.col(value).cast("double").alias("_value")).agg(F.count("*").alias("_n"))
    return quantiles(counts, on, "_value", "_n", levels)


def joined_by(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """``left`` with the columns of ``right``, which has one row for each key; null keys are equal."""
    for i, c in enumerate(on):
        right = right.withColumnRenamed(c, f"_k{i}")
    return left.join(right, _same(on), "left").drop(*(f"_k{i}" for i in range(len(on))))


def described(df: DataFrame, columns: Sequence[str], levels: Sequence[float] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """Per column: rows, missing, distinct, extremes, mean, deviation and exact quantiles, from one pass and counts by value."""
    one = {"n_rows": lambda c: F.count("*"), "n_missing": lambda c: F.count_if(c.isNull()), "lowest": F.min, "highest": F.max, "mean": F.avg, "deviation": F.stddev_samp}
    row = df.agg(F.array(*(F.struct(F.lit(c).alias("column"), *(f(F.col(c).cast("double")).alias(n) for n, f in one.items())) for c in columns)).alias("x"))
    counts = unpivoted(df, columns).filter("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    distinct = counts.groupBy("column").agg(F.count("*").alias("n_distinct"))
    out = row.select(F.inline("x")).join(F.broadcast(distinct), "column", "left").join(F.broadcast(quantiles(counts, ["column"], "value", "n", levels)), "column", "left")
    return out.withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and share of every combination of values, null being one."""
    counts = df.groupBy(*columns).agg(F.count("*").alias("n"))
    #: The counts are few; their total is one row.
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("_all"))), F.lit(True)).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def seasonal_index(df: DataFrame, on: Sequence[str], column: str) -> DataFrame:
    """By key the mean of ``column``, and its ratio to the mean of all rows; null where that is 0."""
    means = df.groupBy(*on).agg(F.count("*").alias("n"), F.avg(column).alias("mean"))
    whole = df.agg(F.avg(column).alias("_whole"))
    return means.join(F.broadcast(whole), F.lit(True)).withColumn("index", F.try_divide("mean", F.nullif("_whole", F.lit(0.0)))).drop("_whole")


def near_constant(df: DataFrame, columns: Sequence[str], least: float = 0.995) -> DataFrame:
    """Per column the share of its most frequent value, and whether it is at least ``least``."""
    counts = unpivoted(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))
    top = counts.groupBy("column").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return top.select("column", (F.col("top") / F.col("n")).alias("top_share"), (F.col("top") / F.col("n") >= least).alias("near_constant"))


def rate(condition: Column) -> Column:
    """Percentage of rows for which the condition holds; unknown counts as not."""
    return F.avg(F.when(F.coalesce(condition, F.lit(False)), 100.0).otherwise(0.0))


def top_per_group(df: DataFrame, on: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*on).orderBy(*order))).filter(F.col("place") <= k)


def share_of_group(df: DataFrame, on: Sequence[str], column: str, name: str = "share") -> DataFrame:
    return df.withColumn(name, F.try_divide(F.col(column), F.sum(column).over(Window.partitionBy(*on))))


def min_max_scaled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column from 0 to 1 over all rows; 0 where it does not vary."""
    bounds = df.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    out = df.join(F.broadcast(bounds), F.lit(True))
    scaled = [F.coalesce(F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")), F.lit(0.0)).alias(c) for c in columns]
    return out.select(*(c for c in df.columns if c not in columns), *scaled)


def transitions(df: DataFrame, on: Sequence[str], order: Sequence[str], state: str) -> DataFrame:
    """(state, next, n, share): how often which state follows which in a key's sequence."""
    following = F.lead(state).over(Window.partitionBy(*on).orderBy(*order))
    counts = df.withColumn("next", following).filter("next IS NOT NULL").groupBy(F.col(state).alias("state"), "next").agg(F.count("*").alias("n"))
    return share_of_group(counts, ["state"], "n")


def correlation(a: Column, b: Column) -> Column:
    """Over the rows that know both; null where either does not vary, where Spark's own measure divides by zero."""
    x, y = F.when(b.isNotNull(), a.cast("double")), F.when(a.isNotNull(), b.cast("double"))
    return F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, correlation) of every two columns, over the rows that have both."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*(correlation(F.col(a), F.col(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")


def autocorrelations(df: DataFrame, order: Sequence[str], column: str, lags: int, on: Sequence[str] = (), bucket: int | None = None) -> DataFrame:
    """(lag, acf) of a regular series: lagged products about the mean over the variance, the usual biased estimate.

    With ``bucket`` (microseconds of the first of ``order``) a series goes to stretches of time.
    """
    rows, keys = with_halo(df, on, order, bucket, lags, [column]) if bucket else df.withColumn(HALO, F.lit(False)), [*on, *([STRETCH] if bucket else [])]
    means = df.groupBy(*on).agg(F.avg(column).alias("_mean"))
    centred = (joined_by(rows, means, on) if on else rows.join(F.broadcast(means), F.lit(True))).withColumn("d", F.col(column) - F.col("_mean"))
    w = Window.partitionBy(*keys).orderBy(*order)
    shifted = centred.select(*on, HALO, "d", *(F.lag("d", k).over(w).alias(f"d{k}") for k in range(lags + 1))).filter(~F.col(HALO))
    sums = shifted.groupBy(*on).agg(*(F.sum(F.col("d") * F.col(f"d{k}")).alias(f"s{k}") for k in range(lags + 1)))
    return sums.select(*on, F.posexplode(F.array(*(F.try_divide(F.col(f"s{k}"), F.col("s0")) for k in range(lags + 1)))).alias("lag", "acf"))


def sampled(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows with the smallest keyed hash."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)
