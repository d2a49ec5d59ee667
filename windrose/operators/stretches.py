"""Windows over keys of few values, such as airports: a key's rows go to stretches of time, and what a frame needs from outside
its stretch comes along as a halo, so no task has to hold all rows of a key.

A stretch is a key's rows of ``bucket`` microseconds. Rows without time come before all others, in a stretch of their own.
Per key and stretch one small row tells what the neighbouring stretches need: the last ``k`` rows for frames of a fixed
number of rows, the last and first known value for fills, the number of rows for ranks. Only these small rows are put in
order by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrose.functions.times import micros

STRETCH, HALO = "_stretch", "_halo"
#: The stretch of rows without time.
_TIMELESS = -(1 << 62)


def dealt(df: DataFrame, ts: str, bucket: int) -> DataFrame:
    """``df`` with the number of each row's stretch."""
    return df.withColumn(STRETCH, F.coalesce(F.floor(micros(ts) / bucket), F.lit(_TIMELESS)).cast("bigint"))


def same(on: Sequence[str], prefix: str) -> Column:
    """The keys and the stretch equal those of a table whose columns were renamed by ``renamed``; nulls are equal."""
    out = F.col(STRETCH) == F.col(f"{prefix}{STRETCH}")
    for c in on:
        out &= F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return out


def renamed(df: DataFrame, on: Sequence[str], prefix: str) -> DataFrame:
    for c in (*on, STRETCH):
        df = df.withColumnRenamed(c, f"{prefix}{c}")
    return df


def with_halo(df: DataFrame, on: Sequence[str], order_by: Sequence[str], bucket: int, rows_before: int, columns: Sequence[str] = ()) -> DataFrame:
    """``df`` dealt to stretches; before the rows of each stretch stand the last ``rows_before`` ones of the key's earlier rows.

    These have ``_halo`` true and only the keys, the order's columns and ``columns``; the rest is null. ``order_by`` begins
    with the time. Windows over the key and the stretch, of frames of so many rows, see what they would see over the key.
    """
    rows = dealt(df, order_by[0], bucket)
    carried = list(dict.fromkeys([*order_by, *columns]))
    ends = Window.partitionBy(*on, STRETCH).orderBy(*(F.desc(c) for c in order_by))
    row = F.struct(F.col("_place"), *(F.col(c) for c in carried if c not in on))
    tails = rows.withColumn("_place", -F.row_number().over(ends)).filter(F.col("_place") >= -rows_before).groupBy(*on, STRETCH).agg(F.sort_array(F.collect_list(row)).alias("_tail"))
    #: Each of the last stretches has a row at least.
    earlier = F.flatten(F.collect_list("_tail").over(Window.partitionBy(*on).orderBy(STRETCH).rowsBetween(-rows_before, -1)))
    halo = tails.withColumn("_earlier", earlier).select(*on, STRETCH, F.explode(F.slice("_earlier", F.greatest(F.lit(1), F.size("_earlier") - rows_before + 1), F.lit(rows_before))).alias("_x"))
    halo = halo.select(*on, STRETCH, *(F.col(f"_x.{c}").alias(c) for c in carried if c not in on), F.lit(True).alias(HALO))
    return rows.withColumn(HALO, F.lit(False)).unionByName(halo, allowMissingColumns=True)


def numbered_with_known(df: DataFrame, on: Sequence[str], order_by: Sequence[str], bucket: int | None, column: str) -> DataFrame:
    """``df`` with ``_i``, the row's number in its key, and with ``_p`` and ``_n``, the last known value at or before the row
    and the first one at or after it, each with its row's number as (i, v); a row whose own value is known has it in both."""
    keys = [*on, STRETCH] if bucket else [*on]
    rows = dealt(df, order_by[0], bucket) if bucket else df
    forward, backward = Window.partitionBy(*keys).orderBy(*order_by), Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order_by))
    #: The second window runs from the other end, as a frame to the end is read again for every row.
    rows = rows.withColumn("_i", F.row_number().over(forward).cast("bigint"))
    at = F.when(F.col(column).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(column).alias("v")))
    upto = (Window.unboundedPreceding, 0)
    rows = rows.withColumn("_at", at).withColumn("_p", F.last("_at", ignorenulls=True).over(forward.rowsBetween(*upto))).withColumn("_n", F.last("_at", ignorenulls=True).over(backward.rowsBetween(*upto)))
    if not bucket:
        return rows.drop("_at")
    each = rows.groupBy(*keys).agg(F.count("*").alias("_rows"), F.max_by("_at", F.when(F.col("_at").isNotNull(), F.col("_i"))).alias("_last"), F.min_by("_at", F.when(F.col("_at").isNotNull(), F.col("_i"))).alias("_first"))
    by_key = Window.partitionBy(*on).orderBy(STRETCH)
    shifted = lambda x: F.when(x.isNotNull(), F.struct((x["i"] + F.col("_before")).alias("i"), x["v"].alias("v")))
    each = each.withColumn("_before", F.coalesce(F.sum("_rows").over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    each = each.withColumn("_last", shifted(F.col("_last"))).withColumn("_first", shifted(F.col("_first")))
    backward_key = Window.partitionBy(*on).orderBy(F.desc(STRETCH))
    each = each.select(*keys, "_before", F.last("_last", ignorenulls=True).over(by_key.rowsBetween(Window.unboundedPreceding, -1)).alias("_from"), F.last("_first", ignorenulls=True).over(backward_key.rowsBetween(Window.unboundedPreceding, -1)).alias("_to"))
    out = rows.join(renamed(each, on, "_k"), same(on, "_k"), "left")
    out = out.withColumn("_p", F.coalesce(shifted(F.col("_p")), "_from")).withColumn("_n", F.coalesce(shifted(F.col("_n")), "_to")).withColumn("_i", F.col("_i") + F.col("_before"))
    return out.select(*df.columns, "_i", "_p", "_n")
