"""Naive-time helpers: microseconds, clock parsing, day repair, calendar grids. No function depends on the session's zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MINUTE = 60_000_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a naive timestamp."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, F.col(ts) if isinstance(ts, str) else ts)


def minutes_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(float(MINUTE))


def parse_on_date(day: Column, clock: Column) -> Column:
    """A clock such as 9:05 on a day, or a full timestamp where the text has a date; null if neither."""
    full = F.try_to_timestamp(clock).cast("timestamp_ntz")
    short = F.regexp_extract(clock, r"(\d{1,2}:\d{2})", 1)
    on_day = F.try_to_timestamp(F.concat(day.cast("string"), F.lit(" "), F.lpad(short, 5, "0")), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")
    return F.when(clock.rlike(r"\d{4}-\d{2}-\d{2}"), full).otherwise(on_day)


def duration_minutes(text: Column) -> Column:
    """Minutes of H:MM; null otherwise."""
    hours, minutes = (F.regexp_extract(text, r"^\s*(\d{1,2}):(\d{2})\s*$", k).try_cast("int") for k in (1, 2))
    return hours * 60 + minutes


def near_reference(moment: Column, reference: Column, hours: float = 12.0) -> Column:
    """``moment`` moved by a day towards the reference where they lie more than ``hours`` apart."""
    gap = micros(moment) - micros(reference)
    limit = int(hours * HOUR)
    return F.when(gap > limit, moment - F.expr("INTERVAL 1 DAY")).when(gap < -limit, moment + F.expr("INTERVAL 1 DAY")).otherwise(moment)


def after_anchor(moment: Column, anchor: Column) -> Column:
    """A clock read on the anchor's day that is earlier than the anchor belongs to the next day."""
    return F.when(moment < anchor, moment + F.expr("INTERVAL 1 DAY")).otherwise(moment)


def clock_minutes(clock: Column) -> Column:
    """Minutes of the day of H:MM, -1 where it is none."""
    parts = [F.regexp_extract(F.trim(clock), r"^(\d{1,2}):(\d{2})$", k).try_cast("int") for k in (1, 2)]
    return F.coalesce(parts[0] * 60 + parts[1], F.lit(-1))


def nearest_day_gap(moment: Column, reference: Column) -> Column:
    """Hours between the two on the nearest of the day before, the day itself and the day after; of two as near the first."""
    gaps = [(micros(moment) - micros(reference)) / F.lit(float(HOUR)) + 24 * d for d in (-1, 0, 1)]
    least = F.least(*map(F.abs, gaps))
    return F.when(F.abs(gaps[0]) == least, gaps[0]).when(F.abs(gaps[1]) == least, gaps[1]).otherwise(gaps[2])


def crawl_day(airport: Column, planned: Column, actual: Column, departed: Column) -> Column:
    """The date that a record is filed under: DAD by plan, the others as it was, else by departure."""
    return F.coalesce(F.to_date(F.when(airport == "DAD", planned).otherwise(actual)), F.to_date(departed))


def canonical_times(airport: Column, mode: Column, day: Column, scheduled: Column, actual: Column) -> dict[str, Column]:
    """scheduled, actual and the day of a record from the clocks that its page shows.

    DAD files by the planned day, so the actual time moves towards the planned one; the others file by the actual day. Their
    arrivals show no plan, their departures' plan moves towards the actual time.
    """
    by_plan = airport == "DAD"
    planned, real = parse_on_date(day, scheduled), parse_on_date(day, actual)
    plan = F.when(by_plan, planned).when(mode == "arrival", None).otherwise(near_reference(planned, real))
    done = F.when(by_plan, near_reference(real, planned)).otherwise(real)
    return {"scheduled": plan, "actual": done, "day": F.coalesce(F.to_date(F.when(by_plan, planned).otherwise(real)), day)}


def daypart(hour: Column) -> Column:
    return F.when(hour < 6, "night").when(hour < 12, "morning").when(hour < 18, "afternoon").otherwise("evening")


def is_peak(ts: Column) -> Column:
    """07:00 to 09:00 and 16:30 to 19:30, ends included."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    return minute.between(420, 540) | minute.between(990, 1170)


def hour_grid(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Every hour between a key's first and last one."""
    spans = df.groupBy(key).agg(F.min(F.date_trunc("hour", ts)).cast("timestamp_ntz").alias("low"), F.max(F.date_trunc("hour", ts)).cast("timestamp_ntz").alias("high"))
    return spans.select(key, F.explode(F.sequence("low", "high", F.expr("INTERVAL 1 HOUR"))).alias("hour"))
