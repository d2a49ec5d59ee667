"""Features of flights: the incoming aircraft, imputed links, time on the ground, and the state of the airports around."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrose.functions import rules
from windrose.functions.times import DAY, HOUR, MINUTE, is_peak, minutes_between
from windrose.operators.history import changed_within, safe_lags
from windrose.operators.temporal import Range, all_range_sums, asof, range_sums

# How full an airport is when it counts as congested; status words of a diverted flight.
CONGESTED, DIVERTED = 0.85, "divert|return|emergency"
#: Stretches in which incoming aircraft are looked for: many flights may share a few tails.
LEG_STRETCH = 3 * HOUR
#: Delay in minutes from which an arrival counts as disrupted.
DISRUPTED_DELAY = 45


def _plus_minutes(ts: Column, minutes: Column) -> Column:
    return ts + F.make_dt_interval(mins=minutes.cast("int"))


def incoming(departures: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Departures with the last arrival of their aircraft strictly before the scheduled time, links imputed.

    ``is_imputed`` marks records whose link is missing. An imputed arrival counts as the scheduled time less the standard
    turnaround, without delay; an imputed departure without actual time as the arrival plus the standard turnaround. A
    departure counts as diverted before by its previous arrival's status or its own flag ``is_return_emergency``, if it has one.
    """
    right = arrivals.select("tail", "row_id", F.col("actual").alias("arrived"), F.col("status").alias("prev_status"), F.when(F.col("is_imputed"), 0.0).otherwise(F.coalesce(minutes_between(F.col("actual"), F.col("scheduled")), F.lit(0.0))).alias("delay_of_leg"), rules.standard_turnaround(F.col("aircraft")).alias("standard"), F.col("is_imputed").alias("imputed"), F.col("airport").alias("prev_airport"), F.col("iata").alias("prev_station"))
    take = {"row_id": "prev_row", "arrived": "prev_arrival", "prev_status": "prev_status", "delay_of_leg": "arrival_delay", "standard": "standard_turnaround", "imputed": "prev_imputed", "prev_airport": "prev_airport", "prev_station": "prev_station"}
    out = asof(departures, right, ["tail"], "scheduled", "arrived", take, strict=True, bucket=LEG_STRETCH, tie="row_id")
    out = out.withColumn("standard_turnaround", F.coalesce("standard_turnaround", F.lit(rules.STANDARD_TURNAROUND))).withColumn("prev_imputed", F.coalesce("prev_imputed", F.lit(False)))
    out = out.withColumn("prev_arrival", F.when(F.col("prev_imputed"), _plus_minutes(F.col("scheduled"), -F.col("standard_turnaround"))).otherwise(F.col("prev_arrival")))
    assumed = F.when(F.col("is_imputed") & F.col("prev_arrival").isNotNull(), _plus_minutes(F.col("prev_arrival"), F.col("standard_turnaround")))
    out = out.withColumn("actual", F.coalesce("actual", assumed)).withColumn("arrival_delay", F.coalesce("arrival_delay", F.lit(0.0)))
    returned = F.coalesce(F.col("is_return_emergency"), F.lit(False)) if "is_return_emergency" in departures.columns else F.lit(False)
    return out.withColumn("is_diverted_prev", (F.coalesce(F.lower("prev_status").rlike(DIVERTED), F.lit(False)) | returned).cast("int"))


def ground_times(df: DataFrame) -> DataFrame:
    """The turnaround set of departures with their incoming leg; the ``_model`` columns are null where the stop was long."""
    raw = minutes_between(F.col("scheduled"), F.col("prev_arrival"))
    valid = F.when(raw >= 0, raw)
    long = F.coalesce(valid >= rules.LONG_GROUND, F.lit(False))
    buffer = F.when(valid > rules.MOST_BUFFER, float(rules.MOST_BUFFER)).when(raw < -120, 0.0).otherwise(valid)
    over = raw - F.col("standard_turnaround")
    slack = F.coalesce(F.greatest(F.lit(0.0), over), F.lit(0.0))
    stagnation = F.least(slack, F.lit(float(rules.MOST_BUFFER)))
    ready = minutes_between(_plus_minutes(F.col("prev_arrival"), F.col("standard_turnaround")), F.col("scheduled"))
    delay = F.coalesce(minutes_between(F.col("actual"), F.col("scheduled")), F.lit(0.0))
    whole = lambda c: F.bround(F.coalesce(c, F.lit(0.0))).cast("bigint")
    target = F.when(delay < rules.LOW_TARGET, float(rules.LOW_TARGET)).when(delay > rules.HIGH_TARGET, float(rules.HIGH_TARGET)).otherwise(delay)
    return df.select(
        "*", whole(delay).alias("departure_delay"), whole(target).alias("target"), long.cast("int").alias("is_long_ground"),
        whole(buffer).alias("turnaround_buffer"), F.when(~long, buffer).alias("turnaround_buffer_model"),
        whole(F.greatest(F.lit(0.0), -over)).alias("turnaround_deficit"), whole(slack).alias("turnaround_slack"),
        whole(stagnation).alias("stagnation"), F.when(~long, stagnation).alias("stagnation_model"),
        F.coalesce(F.greatest(F.lit(0.0), ready), F.lit(0.0)).alias("tobt_deficit"),
    )


def leakage(df: DataFrame) -> DataFrame:
    """One row: how many departures are scheduled at or before their previous arrival."""
    broken = F.count_if(F.col("scheduled") <= F.col("prev_arrival"))
    return df.agg(F.lit("departure_scheduled_after_previous_arrival").alias("check_name"), broken.alias("violation_count"), F.count("*").alias("rows_checked"), F.when(broken == 0, "pass").otherwise("review").alias("status"))


def network_pressure(departures: DataFrame, flights: DataFrame) -> DataFrame:
    """Departures with the arrivals of their airline in the 45 minutes before, whether the destination is congested, and the
    departures planned in the quarter of an hour before."""
    arrivals, planned = flights.filter(F.col("mode") == "arrival"), flights.filter("scheduled IS NOT NULL")
    one = F.lit(1).cast("bigint")
    out = range_sums(departures, arrivals, ["airport", "airline"], "scheduled", "actual", -45 * MINUTE, 0, {"handling_pressure": one})
    there = planned.select(F.col("airport").alias("iata"), "scheduled")
    out = range_sums(out, there, ["iata"], "scheduled", "scheduled", -60 * MINUTE, -1, {"_there": one}, asked=departures)
    capacity = rules.lookup(F.col("iata"), rules.CAPACITY, rules.OTHER_CAPACITY)
    out = out.withColumn("destination_congestion", (F.col("_there") >= CONGESTED * capacity).cast("int")).drop("_there")
    return range_sums(out, planned.filter(F.col("mode") == "departure"), ["airport"], "scheduled", "scheduled", -15 * MINUTE, -1, {"taxi_out": one}, asked=departures)


def arrival_side(arrivals: DataFrame, flights: DataFrame) -> DataFrame:
    """Arrivals with their place in the aircraft's day, the delay gathered before, and the airport's load around them."""
    delay = F.coalesce(minutes_between(F.col("actual"), F.col("scheduled")), F.lit(0.0))
    rows = arrivals.withColumn("arrival_delay", F.when(F.col("is_imputed"), 0.0).otherwise(delay))
    day = Window.partitionBy("tail", F.to_date("actual")).orderBy("actual", "row_id")
    before = F.sum("arrival_delay").over(day.rowsBetween(Window.unboundedPreceding, -1))
    known = rows.filter("tail IS NOT NULL AND actual IS NOT NULL").select("row_id", F.row_number().over(day).alias("leg"), F.greatest(F.lit(0.0), F.coalesce(before, F.lit(0.0))).alias("accumulated_delay"))
    rows = rows.join(known, "row_id", "left").withColumn("is_first", (F.col("leg") == 1).cast("int"))
    one = F.lit(1).cast("bigint")
    late = F.coalesce((F.col("mode") == "arrival") & (delay > DISRUPTED_DELAY), F.lit(False)) | F.coalesce(F.lower("status").rlike(DIVERTED), F.lit(False))
    events = flights.withColumn("_late", late.cast("bigint"))
    around = Range(events, "scheduled", -30 * MINUTE, 30 * MINUTE, {"_around": one})
    before = Range(events, "actual", -60 * MINUTE, -1, {"flights_last_hour": one})
    planned = Range(events, "scheduled", -60 * MINUTE, -1, {"_planned": one, "_bad": F.col("_late")})
    rows = all_range_sums(rows, ["airport"], "actual", [around, before, planned], asked=arrivals)
    load = F.col("_around") / rules.lookup(F.col("airport"), rules.CAPACITY, rules.OTHER_CAPACITY)
    rows = rows.withColumn("load", load).withColumn("is_parallel", (load >= CONGESTED).cast("int")).withColumn("density_disruption", F.when(F.col("_planned") > 0, F.col("_bad") / F.col("_planned")).otherwise(0.0))
    return rows.drop("_around", "_planned", "_bad")


def _disrupted(flights: DataFrame) -> Column:
    """Whether an arrival came more than ``DISRUPTED_DELAY`` minutes late or has a status of a diverted flight."""
    late = F.coalesce(minutes_between(F.col("actual"), F.col("scheduled")) > DISRUPTED_DELAY, F.lit(False))
    return (late | F.coalesce(F.lower("status").rlike(DIVERTED), F.lit(False))).cast("bigint")


def departure_load(departures: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Departures with their incoming leg, with the load of the airport by planned arrivals around, and disruptions here and
    at the previous station; all by plan, so nothing of the flight's own outcome is looked at.

    The share of disrupted arrivals here is that of the hour before the plan, at the previous station of the hour before the
    aircraft's arrival; 0 where none was planned or the station is not known.
    """
    planned = arrivals.filter("scheduled IS NOT NULL").withColumn("_late", _disrupted(arrivals))
    one = F.lit(1).cast("bigint")
    hour = Range(planned, "scheduled", -60 * MINUTE, -1, {"flights_last_hour": one})
    around = Range(planned, "scheduled", -30 * MINUTE, 30 * MINUTE, {"_around": one})
    before = Range(planned, "scheduled", -60 * MINUTE, 0, {"_planned": one, "_bad": F.col("_late")})
    rows = all_range_sums(departures, ["airport"], "scheduled", [hour, around, before])
    there = planned.select(F.col("airport").alias("prev_station"), "scheduled", "_late")
    rows = all_range_sums(rows, ["prev_station"], "prev_arrival", [Range(there, "scheduled", -60 * MINUTE, 0, {"_planned_there": one, "_bad_there": F.col("_late")})], asked=departures)
    capacity = rules.lookup(F.col("airport"), rules.CAPACITY, rules.OTHER_CAPACITY)
    share = lambda bad, n: F.when(F.col(n) > 0, F.col(bad) / F.col(n)).otherwise(0.0)
    rows = rows.withColumns({"load": F.col("_around") / capacity, "is_congested": (F.col("flights_last_hour") >= CONGESTED * capacity).cast("int"), "density_disruption": share("_bad", "_planned"), "previous_station_disruption": share("_bad_there", "_planned_there")})
    return rows.withColumn("is_parallel", (F.col("load") >= CONGESTED).cast("int")).drop("_around", "_planned", "_bad", "_planned_there", "_bad_there")


def delay_lags(departures: DataFrame, bucket: int = DAY) -> DataFrame:
    """Departures (with ``departure_delay`` and ``turnaround_buffer_model``) with what their aircraft and their airport went
    through before, as far as it was known at the planned time; an airport's rows go to stretches of ``bucket`` microseconds.

    By aircraft the delays of the last two flights and the mean of the last three, the buffers likewise; by airport the last
    delay and the mean of three; and whether the airport's runway is another one than an hour before at most.
    """
    by_tail = safe_lags(departures, ["tail"], "scheduled", "actual", "row_id", "departure_delay", 3)
    names = {"lag_1": "prev_departure_delay_tail_1", "lag_2": "prev_departure_delay_tail_2", "known_mean": "rolling_departure_delay_tail_3"}
    out = by_tail.withColumnsRenamed(names).drop("lag_3", "rolling_mean")
    tail = Window.partitionBy("tail").orderBy("scheduled", "row_id")
    buffer = "turnaround_buffer_model"
    out = out.withColumns({**{f"prev_turnaround_buffer_tail_{k}": F.lag(buffer, k).over(tail) for k in (1, 2)}, "rolling_turnaround_buffer_tail_3": F.avg(buffer).over(tail.rowsBetween(-3, -1))})
    out = safe_lags(out, ["airport"], "scheduled", "actual", "row_id", "departure_delay", 3, bucket=bucket)
    out = out.withColumnsRenamed({"lag_1": "prev_departure_delay_airport_1", "known_mean": "rolling_departure_delay_airport_3"}).drop("lag_2", "lag_3", "rolling_mean")
    out = changed_within(out, ["airport"], "scheduled", "row_id", "runway", 60 * MINUTE, bucket=bucket)
    return out.withColumn("runway_swap", F.col("changed").cast("int")).drop("changed")


def flight_profile(flights: DataFrame) -> DataFrame:
    """Flights with body, type of airline, time of day and peak hour; departures by plan, arrivals by what was."""
    at = F.when(F.col("mode") == "arrival", F.col("actual")).otherwise(F.col("scheduled"))
    return flights.withColumns({"is_wide_body": F.coalesce(rules.is_wide_body(F.col("aircraft")), F.lit(False)).cast("int"), "airline_type": rules.airline_type(F.col("airline")), "time_of_day": rules.time_of_day(F.hour(at)), "is_peak_hour": F.coalesce(is_peak(at), F.lit(False)).cast("int")})
