"""Features from what was known at the time: lags, running sums, histories of completed events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from windrose.functions.times import micros
from windrose.operators.stretches import HALO, STRETCH, with_halo


def day_sequence(df: DataFrame, on: Sequence[str], ts: str, tie: str, value: str) -> DataFrame:
    """Number of the event in its key's day, whether it is the first, and the sum of ``value`` before it, at least 0."""
    day = Window.partitionBy(*on, F.to_date(ts)).orderBy(ts, tie)
    before = F.coalesce(F.sum(value).over(day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    number = F.row_number().over(day)
    return df.select("*", number.alias("sequence"), (number == 1).alias("is_first"), F.greatest(before, F.lit(0.0)).alias("accumulated"))


def _in_stretches(df: DataFrame, on: Sequence[str], order_by: Sequence[str], bucket: int | None, rows_before: int, columns: Sequence[str]) -> tuple[DataFrame, WindowSpec]:
    """``df`` and the window of its key; with ``bucket`` its stretches, their halos, and the window of a key's stretch."""
    if bucket is None:
        return df.withColumn(HALO, F.lit(False)), Window.partitionBy(*on).orderBy(*order_by)
    return with_halo(df, on, order_by, bucket, rows_before, columns), Window.partitionBy(*on, STRETCH).orderBy(*order_by)


def safe_lags(df: DataFrame, on: Sequence[str], ts: str, known_at: str, tie: str, value: str, n: int = 3, bucket: int | None = None) -> DataFrame:
    """``value`` of the n events before, each only if it was known by ``ts``; the mean of those known; the plain mean.

    With ``bucket`` (microseconds) a key's rows go to stretches of time.
    """
    rows, order = _in_stretches(df, on, [ts, tie], bucket, n, [known_at, value])
    lags = [F.when(F.lag(known_at, k).over(order) <= F.col(ts), F.lag(value, k).over(order)) for k in range(1, n + 1)]
    out = rows.select("*", *(lag.alias(f"lag_{k}") for k, lag in enumerate(lags, 1)), F.avg(value).over(order.rowsBetween(-n, -1)).alias("rolling_mean")).filter(~F.col(HALO))
    names = [f"lag_{k}" for k in range(1, n + 1)]
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in names), F.lit(0.0))
    known = sum((F.col(c).isNotNull().cast("int") for c in names), F.lit(0))
    return out.withColumn("known_mean", F.try_divide(total, known)).select(*df.columns, *names, "rolling_mean", "known_mean")


def completed_history(df: DataFrame, on: Sequence[str], ts: str, done: str, tie: str, value: str, k: int = 10, least: int = 3) -> DataFrame:
    """Mean of all and deviation of the last ``k`` events of the key that were complete before ``ts``, without the event itself.

    Histories are running states in order of completion, carried to each event by time, so no pair of rows is made.
    """
    state = Window.partitionBy(*on).orderBy("_t", "_side", "_start", tie)
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    own = F.struct(F.col(tie).alias("id"), F.col(value).alias("v"))
    ask = df.select(*on, micros(ts).alias("_t"), F.lit(0).alias("_side"), micros(ts).alias("_start"), F.col(tie), row.alias("_row"))
    told = df.filter(F.col(done).isNotNull() & F.col(value).isNotNull()).select(*on, micros(done).alias("_t"), F.lit(1).alias("_side"), micros(ts).alias("_start"), F.col(tie), own.alias("_own"))
    both = ask.unionByName(told, allowMissingColumns=True)
    upto = state.rowsBetween(Window.unboundedPreceding, 0)
    #: Running sums over completions; the last k + 1 of them by their number.
    both = both.select("*", F.sum(F.col("_own.v")).over(upto).alias("_sum"), F.count("_own.v").over(upto).alias("_n"))
    recent = both.filter("_own IS NOT NULL").withColumn("_last", F.collect_list("_own").over(Window.partitionBy(*on).orderBy("_t", "_side", "_start", tie).rowsBetween(-k, 0)))
    both = both.filter("_own IS NULL").unionByName(recent, allowMissingColumns=True).withColumn("_last", F.last("_last", ignorenulls=True).over(upto))
    seen = both.filter("_row IS NOT NULL").select("_row.*", "_sum", "_n", "_last")
    past = F.coalesce(F.col(done) < F.col(ts), F.lit(False)) & F.col(value).isNotNull()
    others = F.slice(F.reverse(F.filter("_last", lambda x: x["id"] != F.col(tie))), 1, k)
    values = F.transform(others, lambda x: x["v"])
    mean = F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), F.size(values))
    spread = F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - F.col("_mean")) * (v - F.col("_mean")))
    count = F.col("_n") - past.cast("int")
    total = F.col("_sum") - F.when(past, F.col(value)).otherwise(0.0)
    out = seen.withColumn("_mean", mean).withColumn("history_mean", F.when(count > 0, F.try_divide(total, count)))
    return out.withColumn("history_std", F.when(F.size(values) >= least, F.sqrt(F.try_divide(spread, F.size(values) - 1)))).drop("_sum", "_n", "_last", "_mean")


def changed_within(df: DataFrame, on: Sequence[str], ts: str, tie: str, column: str, gap_us: int, bucket: int | None = None) -> DataFrame:
    """``df`` with ``changed``: whether ``column`` differs from the event before, at most ``gap_us`` earlier."""
    rows, order = _in_stretches(df, on, [ts, tie], bucket, 1, [column])
    before, since = F.lag(column).over(order), micros(ts) - F.lag(micros(ts)).over(order)
    out = rows.withColumn("changed", F.coalesce((before != F.col(column)) & (since <= gap_us), F.lit(False)))
    return out.filter(~F.col(HALO)).select(*df.columns, "changed")


def rolling(df: DataFrame, on: Sequence[str], order_by: Sequence[str], frames: dict[str, tuple[str, str, int]], bucket: int | None = None) -> DataFrame:
    """By new name: (function, column, rows) over the last rows; diff is against the row that many before, lag is that row.

    With ``bucket`` (microseconds of the first of ``order_by``) a key's rows go to stretches of time.
    """
    rows, order = _in_stretches(df, on, order_by, bucket, max(n for _, _, n in frames.values()), [c for _, c, _ in frames.values()])
    made = {"sum": F.sum, "max": F.max, "mean": F.avg, "min": F.min}
    whole = {"diff": lambda c, n: F.col(c) - F.lag(c, n).over(order), "lag": lambda c, n: F.lag(c, n).over(order)}
    out = rows.select("*", *((whole[f](c, n) if f in whole else made[f](c).over(order.rowsBetween(1 - n, 0))).alias(name) for name, (f, c, n) in frames.items()))
    return out.filter(~F.col(HALO)).select(*df.columns, *frames)
