"""Which leg of a flight's schedule a record is of."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrose.functions.times import clock_minutes


def best_leg(records: DataFrame, legs: DataFrame, on: Sequence[str], row_id: str, day: str, planned: str, actual: str, order: str, take: Sequence[str]) -> DataFrame:
    """``records`` with the columns ``take`` of their leg, and ``leg_day``; null where there is none.

    Of the flight's legs of the record's day the one of the same planned clock, else of the same actual one, else the first
    by ``order``. Without any leg that day, the best one of the day before counts by the same order, if a clock is the same
    or it was planned later in the day than the record says it left, so past midnight. Clocks are texts like 9:05. Records
    have distinct ``row_id``; null keys have no leg. A record asks six questions, whatever the number of its day's legs.
    """
    text = lambda c: F.col(c).cast("string")
    legs = legs.select(*on, F.col(day).alias("_day"), text(planned).alias("_p"), text(actual).alias("_a"), F.col(order).alias("_order"), F.struct(F.col(day).alias("leg_day"), *take).alias("_leg"))
    #: Of the legs of a day with one planned clock, with one actual clock, and of all, only the first by order can be the best.
    parts = [legs.select(*on, "_day", F.lit(rank).alias("_rank"), clock.alias("_clock"), "_p", "_order", "_leg") for rank, clock in enumerate((F.col("_p"), F.col("_a"), F.lit("")))]
    due = clock_minutes(F.coalesce("_p", F.lit("")))
    first = reduce(DataFrame.unionByName, parts).filter("_clock IS NOT NULL").groupBy(*on, "_day", "_rank", "_clock").agg(F.min(F.struct("_order", "_leg")).alias("_first"), F.min(F.struct(F.col("_order"), due.alias("due")))["due"].alias("_due"))
    questions = F.array(*(F.struct(F.date_sub(day, before).alias("_day"), F.lit(before).alias("_before"), F.lit(rank).alias("_rank"), clock.alias("_clock")) for before in (0, 1) for rank, clock in enumerate((text(planned), text(actual), F.lit("")))))
    left = clock_minutes(F.coalesce(text(actual), F.lit("")))
    asked = records.select(row_id, *on, left.alias("_left"), F.explode(questions).alias("_x")).select(row_id, *on, "_left", "_x.*").filter("_clock IS NOT NULL")
    past_midnight = (F.col("_due") != -1) & (F.col("_left") != -1) & (F.col("_due") > F.col("_left"))
    fits = (F.col("_before") == 0) | (F.col("_rank") < 2) | past_midnight
    found = asked.join(first, [*on, "_day", "_rank", "_clock"])
    best = found.groupBy(row_id).agg(F.min(F.struct("_before", "_rank", F.col("_first._order").alias("order"), fits.alias("fits"), F.col("_first._leg").alias("_leg"))).alias("_x"))
    out = records.join(best, row_id, "left")
    return out.select(*records.columns, *(F.when(F.col("_x.fits"), F.col(f"_x._leg.{c}")).alias(c) for c in ("leg_day", *take)))
