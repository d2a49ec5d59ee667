"""Repair of movement records: duplicates, runways, returns to the origin, swapped aircraft, missing counterparts, dates.

A movement has row_id, airport, mode (arrival or departure), iata (the other airport), flight_no, tail, scheduled, actual,
category and runway. Searches along time run per flight or, where the key is an airport alone, per airport and stretch of time, so no
airport's rows meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrose.functions.times import HOUR, MINUTE, micros, minutes_between
from windrose.operators.temporal import asof, first_known_after, nearer, neighbours, range_sums, within_after

# Runways by airport and mode (default, reverse), the emergency runway, and what emergencies turn a runway to.
RUNWAYS = {"SGN": {"arrival": ("25R", "07L"), "departure": ("25L", "07R")}, "HAN": {"arrival": ("11L", "29R"), "departure": ("11R", "29L")}, "DAD": {"arrival": ("35L", "17R"), "departure": ("35R", "17L")}}
EMERGENCY = {"SGN": "25L", "HAN": "11R", "DAD": "35R"}
EMERGENCY_OF = {"25R": "25L", "07L": "07R", "11L": "11R", "29R": "29L", "35L": "35R", "17R": "17L"}
DROPPED_CATEGORIES = ("passenger", "unknown", "cargo")
RETURN_SPAN, ROUTE_SPAN = 150 * MINUTE, 6 * HOUR
CLUSTER_GAP, NEAR_GAP = 150 * MINUTE, 10 * MINUTE
RUNWAY_SPAN, ORIENTED_SHARE = 30 * MINUTE, 0.6
IDENTITY = ("iata", "flight_no", "airline", "terminal", "origin")


def event_time() -> Column:
    return F.coalesce("actual", "scheduled")


def usual_runway(which: int) -> Column:
    """The default (0) or reverse (1) runway of a row's airport and mode."""
    out = F.lit(None).cast("string")
    for airport, modes in RUNWAYS.items():
        for mode, pair in modes.items():
            out = F.when((F.col("airport") == airport) & (F.col("mode") == mode), pair[which]).otherwise(out)
    return out


def _mode(df: DataFrame, mode: str) -> DataFrame:
    return df.filter(F.col("mode") == mode)


def returns(flights: DataFrame) -> DataFrame:
    """Arrivals from their own airport with ``return_gap`` (minutes since the flight last left) and ``is_return``."""
    left = _mode(flights, "arrival").filter(F.col("iata") == F.col("airport")).withColumn("_event", event_time())
    right = _mode(flights, "departure").select("airport", "flight_no", event_time().alias("_left"))
    out = asof(left, right, ["airport", "flight_no"], "_event", "_left", {"_left": "_last"}, bucket=RETURN_SPAN)
    gap = minutes_between(F.col("_event"), F.col("_last"))
    return out.withColumn("return_gap", gap).withColumn("is_return", F.coalesce(gap <= RETURN_SPAN / MINUTE, F.lit(False))).drop("_event", "_last")


def linked_departures(flights: DataFrame) -> DataFrame:
    """row_id of the departures after which the flight comes back to the airport within the span."""
    left = _mode(flights, "departure").select("row_id", "airport", "flight_no", event_time().alias("_event"))
    back = _mode(flights, "arrival").filter(F.col("iata") == F.col("airport")).select("airport", "flight_no", event_time().alias("_back"))
    return within_after(left, back, ["airport", "flight_no"], "_event", "_back", RETURN_SPAN).filter("matched").select("row_id")


def deduplicated(flights: DataFrame, crawl_date: str | None = None) -> DataFrame:
    """``flights`` with ``kept_row`` and ``is_dropped``: of each cluster of a flight's records the latest stays.

    Records of one service date, flight and other airport form a cluster while they follow one another within the gap on
    one calendar day. Exempt are departures of which one is followed by a return, and arrivals of which one is a return
    and two lie within ``NEAR_GAP``. Records without flight number or time are never dropped.
    """
    exempt = returns(flights).filter("is_return").select("row_id").unionByName(linked_departures(flights)).withColumn("_exempt", F.lit(1))
    service = F.coalesce(F.to_date("scheduled"), *([F.col(crawl_date)] if crawl_date else []))
    rows = flights.withColumn("_event", event_time())
    rows = rows.filter("flight_no IS NOT NULL AND _event IS NOT NULL").join(exempt, "row_id", "left").withColumn("_service", service).withColumn("_day", F.to_date("_event"))
    keys = ["airport", "mode", "_service", "flight_no", "iata", "_day"]
    order = Window.partitionBy(*keys).orderBy("_event", "row_id")
    rows = rows.withColumn("_gap", micros("_event") - F.lag(micros("_event")).over(order))
    rows = rows.withColumn("_cluster", F.sum(F.coalesce((F.col("_gap") > CLUSTER_GAP).cast("int"), F.lit(0))).over(order))
    whole = Window.partitionBy(*keys, "_cluster")
    inner = F.min(F.when(F.col("_gap") <= CLUSTER_GAP, F.col("_gap"))).over(whole)
    spared = F.coalesce(F.max("_exempt").over(whole), F.lit(0)) == 1
    spared &= (F.col("mode") == "departure") | F.coalesce(inner <= NEAR_GAP, F.lit(False))
    latest = F.max(F.struct(F.col("_event"), (-F.col("row_id")).alias("id"))).over(whole)
    rows = rows.withColumn("kept_row", F.when(spared, F.col("row_id")).otherwise(-latest["id"])).select("row_id", "kept_row")
    out = flights.join(rows, "row_id", "left").withColumn("kept_row", F.coalesce("kept_row", "row_id"))
    return out.withColumn("is_dropped", F.col("kept_row") != F.col("row_id"))


def oriented(flights: DataFrame) -> DataFrame:
    """``flights`` with ``orientation``: which way the airport's runway was used within half an hour of the record."""
    rows = flights.withColumn("_event", F.when(F.col("airport") == "DAD", F.col("scheduled")).otherwise(F.col("actual"))).withColumn("_rw", F.upper(F.trim("runway")))
    known = rows.select("airport", "mode", "_event", "_rw").filter("_rw IS NOT NULL")
    used = {"_default": (F.col("_rw") == usual_runway(0)).cast("bigint"), "_reverse": (F.col("_rw") == usual_runway(1)).cast("bigint")}
    out = range_sums(rows, known, ["airport", "mode"], "_event", "_event", -RUNWAY_SPAN, RUNWAY_SPAN, used)
    most = F.greatest("_default", "_reverse")
    enough = most >= ORIENTED_SHARE * (F.col("_default") + F.col("_reverse"))
    way = F.when(F.col("_event").isNotNull() & (most > 0) & enough, F.when(F.col("_default") >= F.col("_reverse"), "default").otherwise("reverse"))
    return out.withColumn("orientation", way).drop("_event", "_rw", "_default", "_reverse")


def filled_runways(flights: DataFrame) -> DataFrame:
    """``flights`` with ``orientation``, ``runway`` filled where it is missing or unknown, and ``filled_by``.

    The nearest known runway within half an hour, of two as near the earlier; at DAD else the nearest at all, of two as near
    the later; else the usual one of the orientation. DAD goes by scheduled, the others by actual times.
    """
    at = F.when(F.col("airport") == "DAD", F.col("scheduled")).otherwise(F.col("actual"))
    missing = F.col("runway").isNull() | (F.lower(F.trim("runway")) == "unknown")
    rows = oriented(flights).withColumn("_event", at)
    known = flights.filter(~missing).select("airport", "mode", "row_id", at.alias("_at_known"), F.col("runway").alias("_rw"))
    both = neighbours(rows, known, ["airport", "mode"], "_event", "_at_known", ["_rw"], bucket=RUNWAY_SPAN, tie="row_id")
    near, any_ = nearer(RUNWAY_SPAN)["_rw"], F.when(F.col("airport") == "DAD", nearer(later_wins=True)["_rw"])
    usual = F.when(F.col("orientation") == "reverse", usual_runway(1)).otherwise(usual_runway(0))
    by = F.when(~missing, None).when(near.isNotNull(), "near").when(any_.isNotNull(), "any").otherwise("usual")
    out = both.withColumn("filled_by", by).withColumn("_filled", F.when(missing, F.coalesce(near, any_, usual)).otherwise(F.col("runway")))
    return out.withColumn("runway", F.col("_filled")).drop("_filled", "_event", "_p", "_n")


def same_origin(flights: DataFrame) -> DataFrame:
    """Arrivals with ``action``: what becomes of those that come from their own airport, and the runway that they then have.

    A return within the span stays and gets the emergency runway; of the others commercial ones are to be dropped and the
    rest lose what identifies them and get the usual runway. ``flights`` has ``orientation``.
    """
    arrivals = _mode(flights, "arrival")
    found = returns(flights).select("row_id", "return_gap", "is_return")
    category = F.coalesce(F.lower(F.trim("category")), F.lit(""))
    out = arrivals.join(found, "row_id", "left")
    action = F.when(F.col("is_return").isNull(), None).when(F.col("is_return"), "keep_return_emergency").when(category.isin(*DROPPED_CATEGORIES), "drop_unmatched_same_origin").otherwise("keep_noncommercial_same_origin")
    usual = F.when(F.col("orientation") == "reverse", usual_runway(1)).otherwise(usual_runway(0))
    current = F.upper(F.trim(F.coalesce("runway", usual)))
    turned = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in EMERGENCY_OF.items() for x in pair)), current), current)
    out = out.withColumn("action", action)
    out = out.withColumn("runway", F.when(F.col("action") == "keep_return_emergency", turned).when(F.col("action") == "keep_noncommercial_same_origin", usual).otherwise(F.col("runway")))
    for c in IDENTITY:
        if c in out.columns:
            out = out.withColumn(c, F.when(F.coalesce(F.col("action") == "keep_noncommercial_same_origin", F.lit(False)), None).otherwise(F.col(c)))
    return out.withColumn("is_return", F.coalesce("is_return", F.lit(False)))


def swaps(flights: DataFrame) -> DataFrame:
    """Departures with the arrival that they match (``arr_row``), its gap in minutes, the first tail known, and whether it differs."""
    left = _mode(flights, "departure").filter(F.col("iata") != F.col("airport")).withColumn("_from", F.col("airport")).withColumn("_to", F.col("iata")).withColumn("_event", event_time())
    right = _mode(flights, "arrival").select(F.col("iata").alias("_from"), F.col("airport").alias("_to"), "flight_no", "row_id", F.col("tail").alias("_tail"), event_time().alias("_at_arr"))
    on = ["_from", "_to", "flight_no"]
    out = asof(left, right, on, "_event", "_at_arr", {"row_id": "arr_row", "_at_arr": "_landed"}, strict=True, forward=True, tie="row_id")
    gap = F.when(micros("_landed") - micros("_event") <= ROUTE_SPAN, minutes_between(F.col("_landed"), F.col("_event")))
    out = out.withColumn("match_gap", gap).withColumn("arr_row", F.when(F.col("match_gap").isNotNull(), F.col("arr_row")))
    out = first_known_after(out, right, on, "_event", "_at_arr", {"_tail": "matched_tail"}, ROUTE_SPAN, tie="row_id")
    differs = F.upper(F.trim("tail")) != F.upper(F.trim("matched_tail"))
    return out.withColumn("is_swapped", F.coalesce(differs, F.lit(False))).drop("_from", "_to", "_event", "_landed")


def with_tails_of_swaps(flights: DataFrame, airport: str = "DAD") -> DataFrame:
    """``flights`` with the tails at ``airport`` set right by the other end of swapped flights.

    Its departures take the tail that arrived, its arrivals the one that left; of several the latest departure's counts.
    """
    found = swaps(flights).filter("is_swapped").withColumn("_event", event_time())
    out = found.filter(F.col("airport") == airport).select("row_id", F.upper(F.trim("matched_tail")).alias("_new"))
    inward = found.filter(F.col("iata") == airport).groupBy(F.col("arr_row").alias("row_id")).agg(F.max_by(F.upper(F.trim("tail")), F.struct("_event", "row_id")).alias("_new"))
    new = out.unionByName(inward)
    return flights.join(new, "row_id", "left").withColumn("tail", F.coalesce("_new", "tail")).drop("_new")


def settled_swaps(flights: DataFrame, airport: str = "DAD") -> DataFrame:
    """``swaps`` once more, after the tails at ``airport`` were set right by the first ones."""
    return swaps(with_tails_of_swaps(flights, airport))


def match_quality(flights: DataFrame) -> DataFrame:
    """``flights`` with the match flags: passenger flights whose other end is missing are marked and left out of training."""
    rows = flights.filter(F.col("iata") != F.col("airport")).withColumn("_event", event_time()).filter("_event IS NOT NULL AND flight_no IS NOT NULL")
    passenger = F.lower(F.trim("category")) == "passenger"
    departures = _mode(rows, "departure").select("row_id", "category", "flight_no", F.col("airport").alias("_from"), F.col("iata").alias("_to"), "_event")
    arrivals = _mode(rows, "arrival").select("row_id", "category", "flight_no", F.col("iata").alias("_from"), F.col("airport").alias("_to"), "_event")
    on = ["_from", "_to", "flight_no"]
    landed = within_after(departures.filter(passenger), arrivals.select(*on, F.col("_event").alias("_other")), on, "_event", "_other", ROUTE_SPAN)
    left = asof(arrivals.filter(passenger), departures.select(*on, F.col("_event").alias("_other")), on, "_event", "_other", {"_other": "_last"})
    left = left.withColumn("matched", F.coalesce(micros("_event") - micros("_last") <= ROUTE_SPAN, F.lit(False)))
    lost = landed.unionByName(left.drop("_last")).filter("NOT matched").select("row_id", F.lit(True).alias("_lost"))
    out = flights.join(lost, "row_id", "left").withColumn("_lost", F.coalesce("_lost", F.lit(False)))
    departs = F.col("mode") == "departure"
    return out.select(
        *flights.columns,
        (~(F.col("_lost") & ~departs)).alias("has_matched_departure"),
        (~(F.col("_lost") & departs)).alias("has_matched_arrival"),
        F.when(~F.col("_lost"), "matched").when(departs, "dep_without_arrival").otherwise("arrival_without_departure").alias("match_status"),
        F.when(~F.col("_lost"), "complete").when(departs, "unmatched_departure").otherwise("unmatched_arrival").alias("data_completeness"),
        F.col("_lost").alias("exclude_from_training"),
    )


def right_arrival_days(flights: DataFrame) -> DataFrame:
    """Arrivals with ``shift`` (0, 1 or -1 days): the first by which the flight left its origin at most six hours before."""
    right = _mode(flights, "departure").select(F.col("airport").alias("iata"), F.col("iata").alias("airport"), "flight_no", event_time().alias("_left"))
    out = _mode(flights, "arrival")
    shift = F.lit(None).cast("int")
    for days in (0, 1, -1):
        name = f"_ok{days % 3}"
        out = out.withColumn("_moved", event_time() + F.make_dt_interval(F.lit(days)))
        out = asof(out, right, ["iata", "airport", "flight_no"], "_moved", "_left", {"_left": "_last"}, strict=True)
        out = out.withColumn(name, F.coalesce(micros("_moved") - micros("_last") <= ROUTE_SPAN, F.lit(False))).drop("_moved", "_last")
        shift = F.coalesce(shift, F.when(F.col(name), F.lit(days)))
    out = out.withColumn("shift", F.coalesce(shift, F.lit(0))).drop("_ok0", "_ok1", "_ok2")
    return out.withColumn("actual", F.when(F.col("shift") == 0, F.col("actual")).otherwise(event_time() + F.make_dt_interval(F.col("shift"))))
