"""Joins and counts along time: as-of, nearest, within an interval, range counts, sessions, near-duplicate events.

All are unions with window frames, so no pair of rows is ever made. A key with few values, such as an airport, would put
all its rows into one task; with ``bucket`` (microseconds) windows run per key and stretch of time, and what an as-of
search needs from earlier stretches comes from one row per key and stretch.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrose.functions.times import micros

#: Points of a key that one stretch of range sums takes, and the most stretches of a key.
STRETCH_ROWS, STRETCHES = 1 << 18, 1024


def asof(left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str, right_ts: str, take: dict[str, str], strict: bool = False, forward: bool = False, bucket: int | None = None, tie: str | None = None) -> DataFrame:
    """``left`` with the columns ``take`` (name in right to name here) of the last row of right at or before left_ts.

    strict: before only. forward: the first one at or after. tie: of right rows at one time the one with the largest
    (forward: smallest) value. Rows of left whose key or time is null, or without a match, get nulls.
    """
    sign = -1 if forward else 1
    row = F.struct(*(F.col(f"`{c}`") for c in left.columns))
    found = F.struct(*(F.col(f"`{c}`").alias(name) for c, name in take.items()))
    rank = (F.col(tie).cast("bigint") if tie else F.lit(0).cast("bigint")) * sign
    l = left.select(*on, (micros(left_ts) * sign).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.lit(0).cast("bigint").alias("_tie"), row.alias("_row"))  # noqa: E741
    r = right.filter(F.col(right_ts).isNotNull()).select(*on, (micros(right_ts) * sign).alias("_t"), F.lit(1 if strict else 0).alias("_side"), rank.alias("_tie"), found.alias("_found"))
    both = l.unionByName(r, allowMissingColumns=True)
    stretch = F.expr(f"_t div {bucket}") if bucket else F.lit(0)
    both = both.withColumn("_stretch", stretch)
    keys = [*on, "_stretch"]
    before = Window.partitionBy(*keys).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_here", F.last("_found", ignorenulls=True).over(before))
    if bucket:
        #: The last row of a stretch serves the stretches up to the next one that has any; the last of all, those after it.
        last = r.withColumn("_stretch", stretch).groupBy(*keys).agg(F.max_by("_found", F.struct("_t", "_side", "_tie")).alias("_last"))
        spans = last.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(on)), F.col("_stretch").alias("_from"), F.lead("_stretch").over(Window.partitionBy(*on).orderBy("_stretch")).alias("_to"), "_last")
        between = spans.filter("_to IS NOT NULL").select(*(f"_k{i}" for i in range(len(on))), F.explode(F.sequence(F.col("_from") + 1, F.col("_to"))).alias("_at"), F.col("_last").alias("_carried"))
        after = spans.filter("_to IS NULL").select(*(F.col(f"_k{i}").alias(f"_j{i}") for i in range(len(on))), F.col("_from").alias("_end"), F.col("_last").alias("_final"))
        out = out.filter("_row IS NOT NULL").join(between, [*(F.col(k) == F.col(f"_k{i}") for i, k in enumerate(on)), F.col("_stretch") == F.col("_at")], "left")
        out = out.join(after, [*(F.col(k) == F.col(f"_j{i}") for i, k in enumerate(on)), F.col("_stretch") > F.col("_end")], "left").withColumn("_here", F.coalesce("_here", "_carried", "_final"))
    usable = F.col("_t").isNotNull()
    for k in on:
        usable &= F.col(k).isNotNull()
    return out.filter("_row IS NOT NULL").select("_row.*", *(F.when(usable, F.col("_here")[name]).alias(name) for name in take.values()))


def neighbours(left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str, right_ts: str, take: Sequence[str], bucket: int | None = None, tie: str | None = None) -> DataFrame:
    """``left`` with the last row of right at or before left_ts as ``_p`` and the first at or after it as ``_n``.

    Both are structs of ``take`` and ``gap``, the microseconds between.
    """
    rows = right.select(*on, right_ts, *([tie] if tie and tie not in on else []), F.struct(F.col(right_ts).alias("at"), *take).alias("_found"))
    back = asof(left, rows, on, left_ts, right_ts, {"_found": "_p"}, bucket=bucket, tie=tie)
    both = asof(back, rows, on, left_ts, right_ts, {"_found": "_n"}, forward=True, bucket=bucket, tie=tie)
    return both.withColumn("_p", F.col("_p").withField("gap", micros(left_ts) - micros(F.col("_p.at")))).withColumn("_n", F.col("_n").withField("gap", micros(F.col("_n.at")) - micros(left_ts)))


def nearer(tolerance: int | None = None, later_wins: bool = False) -> Column:
    """Of ``neighbours`` the nearer one, at most ``tolerance`` microseconds away; of two as near the earlier one."""
    closer = F.col("_n.gap") <= F.col("_p.gap") if later_wins else F.col("_n.gap") < F.col("_p.gap")
    best = F.when(F.col("_p").isNull() | F.coalesce(closer, F.lit(False)), F.col("_n")).otherwise(F.col("_p"))
    return best if tolerance is None else F.when(best["gap"] <= tolerance, best)


def nearest(left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str, right_ts: str, take: dict[str, str], tolerance: int | None = None, bucket: int | None = None, tie: str | None = None, later_wins: bool = False) -> DataFrame:
    """The row of right nearest in time, at most ``tolerance`` microseconds away; of two as near the earlier one."""
    both = neighbours(left, right, on, left_ts, right_ts, [*take], bucket, tie).withColumn("_best", nearer(tolerance, later_wins))
    return both.select(*left.columns, *(F.col("_best")[c].alias(n) for c, n in take.items()), F.col("_best")["gap"].alias("gap_us"))


def within_after(left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str, right_ts: str, span: int, strict: bool = False, bucket: int | None = None) -> Column:
    """``left`` with ``matched``: whether a row of right lies within ``span`` microseconds after (strict: not at) left_ts."""
    out = asof(left, right, on, left_ts, right_ts, {right_ts: "_at"}, strict=strict, forward=True, bucket=bucket)
    return out.withColumn("matched", F.coalesce(micros("_at") - micros(left_ts) <= span, F.lit(False))).drop("_at")


def first_known_after(left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str, right_ts: str, take: dict[str, str], span: int, bucket: int | None = None, tie: str | None = None) -> DataFrame:
    """Each column from the first row of right in (left_ts, left_ts + span] in which that column is known."""
    for column, name in take.items():
        known = right.filter(F.col(column).isNotNull())
        left = asof(left, known, on, left_ts, right_ts, {column: name, right_ts: "_at"}, strict=True, forward=True, bucket=bucket, tie=tie)
        left = left.withColumn(name, F.when(micros("_at") - micros(left_ts) <= span, F.col(name))).drop("_at")
    return left


class Range(NamedTuple):
    """Sums, by name, over the events whose time ``ts`` lies in [probe + low, probe + high] microseconds."""

    events: DataFrame
    ts: str
    low: int
    high: int
    sums: dict[str, Column]


def all_range_sums(probes: DataFrame, on: Sequence[str], probe_ts: str, ranges: Sequence[Range], asked: DataFrame | None = None, stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """``probes`` with the sums of all ranges, of whole numbers; 0 without any event, also where key or time is null.

    A range's sum is the running sum at its end less the one before its start. Events of one key and time count as one row,
    and each distinct key and time of the probes asks for the running sum at each bound once. A key of more than
    ``stretch_rows`` such points is cut at quantiles of time: sums run within a stretch, and one row for each key and
    stretch holds what lies before it. So the work grows with the rows, and no task has to hold a key or a dense hour.
    ``asked`` is a table with the same keys and times as ``probes`` where that takes less to make.
    """
    sources, uses = [], []
    for r in ranges:
        number = next((i for i, (e, ts, _) in enumerate(sources) if e is r.events and ts == r.ts), len(sources))
        if number == len(sources):
            sources.append((r.events, r.ts, []))
        values = sources[number][2]
        for name, v in r.sums.items():
            place = next((i for i, x in enumerate(values) if x is v), len(values))
            values.extend([v] if place == len(values) else [])
            uses.append((name, number, place, r.high, r.low - 1))
    width = max(len(values) for _, _, values in sources)
    bounds = list(dict.fromkeys((number, offset) for _, number, _, *offsets in uses for offset in offsets))
    known = lambda df, ts: df.filter(F.col(ts).isNotNull()).dropna(subset=[*on])
    events = None
    for number, (df, ts, values) in enumerate(sources):
        sums = [F.sum(values[i].cast("bigint") if i < len(values) else F.lit(None).cast("bigint")).alias(f"_v{i}") for i in range(width)]
        part = known(df, ts).groupBy(*on, micros(ts).alias("_m")).agg(*sums).withColumn("_source", F.lit(number))
        events = part if events is None else events.unionByName(part)
    times = known(probes if asked is None else asked, probe_ts).select(*on, micros(probe_ts).alias("_t")).distinct()
    bound = F.explode(F.array(*(F.struct(F.lit(number).alias("_source"), (F.col("_t") + offset).alias("_m"), F.lit(i).alias("_bound")) for i, (number, offset) in enumerate(bounds))))
    points = times.select(*on, "_t", bound.alias("_x")).select(*on, "_t", "_x.*").unionByName(events, allowMissingColumns=True)
    keys, inside = [*on, "_source"], [*on, "_source"]
    largest = points.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest > stretch_rows:
        n = min(STRETCHES, -(-largest // stretch_rows))
        edges = points.agg(F.percentile_approx("_m", [i / n for i in range(1, n)], 10_000)).first()[0]
        splits = [-math.inf, *map(float, sorted(set(edges))), math.inf]
        deal = lambda df: Bucketizer(splits=splits, inputCol="_moment", outputCol="_stretch").transform(df.withColumn("_moment", F.col("_m").cast("double"))).drop("_moment").withColumn("_stretch", F.col("_stretch").cast("int"))
        points, events, inside = deal(points), deal(events), [*keys, "_stretch"]
    running = Window.partitionBy(*inside).orderBy("_m", F.col("_bound").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    told = points.withColumns({f"_v{i}": F.coalesce(F.sum(f"_v{i}").over(running), F.lit(0)) for i in range(width)}).filter("_bound IS NOT NULL")
    if largest > stretch_rows:
        by_key = Window.partitionBy(*keys).orderBy("_stretch")
        totals = events.groupBy(*inside).agg(*(F.sum(f"_v{i}").alias(f"_v{i}") for i in range(width)))
        #: What lies up to a stretch with events serves the stretches up to the next one that has any.
        sums_to = [F.coalesce(F.sum(f"_v{i}").over(by_key.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias(f"_before{i}") for i in range(width)]
        reach = totals.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_stretch", *sums_to, F.coalesce(F.lead("_stretch").over(by_key), F.lit(len(splits))).alias("_next"))
        before = reach.withColumn("_at", F.explode(F.sequence(F.col("_stretch") + 1, "_next"))).drop("_stretch", "_next")
        told = told.join(before, [*(F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)), F.col("_stretch") == F.col("_at")], "left")
        told = told.withColumns({f"_v{i}": F.col(f"_v{i}") + F.coalesce(f"_before{i}", F.lit(0)) for i in range(width)})
    at = lambda number, offset, place: F.max(F.when(F.col("_bound") == bounds.index((number, offset)), F.col(f"_v{place}")))
    sums = told.groupBy(*on, "_t").agg(*((at(number, high, place) - at(number, low, place)).alias(f"_sum{i}") for i, (_, number, place, high, low) in enumerate(uses)))
    sums = sums.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(on)), F.col("_t").alias("_at"), *(f"_sum{i}" for i in range(len(uses))))
    out = probes.join(sums, [*(F.col(k) == F.col(f"_k{i}") for i, k in enumerate(on)), micros(probe_ts) == F.col("_at")], "left")
    return out.select(*(F.col(f"`{c}`") for c in probes.columns), *(F.coalesce(f"_sum{i}", F.lit(0)).alias(name) for i, (name, *_) in enumerate(uses)))


def range_sums(probes: DataFrame, events: DataFrame, on: Sequence[str], probe_ts: str, event_ts: str, low: int, high: int, sums: dict[str, Column], asked: DataFrame | None = None) -> DataFrame:
    """``all_range_sums`` of one range."""
    return all_range_sums(probes, on, probe_ts, [Range(events, event_ts, low, high, sums)], asked)


def gap_sessions(df: DataFrame, on: Sequence[str], ts: str, gap: int, tie: str, name: str = "session") -> DataFrame:
    """Sessions from 1: a new one begins after more than ``gap`` microseconds."""
    order = Window.partitionBy(*on).orderBy(ts, tie)
    fresh = F.coalesce((micros(ts) - F.lag(micros(ts)).over(order) > gap).cast("bigint"), F.lit(1))
    return df.withColumn("_fresh", fresh).withColumn(name, F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def latest_of_near(df: DataFrame, on: Sequence[str], ts: str, gap: int, tie: str) -> DataFrame:
    """Near-duplicate events: of every session of a key and calendar day the latest event stays, rows without time too."""
    known = df.filter(F.col(ts).isNotNull()).withColumn("_day", F.to_date(ts))
    marked = gap_sessions(known, [*on, "_day"], ts, gap, tie, "_session")
    last = Window.partitionBy(*on, "_day", "_session").orderBy(F.desc(ts), F.asc(tie))
    kept = marked.withColumn("_place", F.row_number().over(last)).filter("_place = 1").drop("_place", "_session", "_day")
    return kept.unionByName(df.filter(F.col(ts).isNull()))
