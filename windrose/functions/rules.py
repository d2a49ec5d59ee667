"""Rule tables of the domain as expressions: runways and wind, weather flags and scores, carriers, terminals, delay codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Runway headings, hourly capacities, terminals, thresholds.
HEADINGS = {"SGN": 250, "HAN": 110, "DAD": 350}
CAPACITY = {"SGN": 44, "HAN": 37, "DAD": 24}
OTHER_CAPACITY = 30
KMH_PER_KNOT = 1.852
STANDARD_TURNAROUND, WIDE_TURNAROUND, REGIONAL_TURNAROUND = 60, 90, 35
LONG_GROUND, MOST_BUFFER = 5760, 4320
LOW_TARGET, HIGH_TARGET = -60, 720
# Aircraft that count as wide bodies; how the codes of regional turboprops begin.
WIDE_BODIES = ("A359", "B789", "B747", "A330", "B77X", "B78X", "A333", "B77W", "B788")
REGIONAL = "AT"
# Loads of an airport in peak hours, at other times, and at most.
PEAK_LOAD, USUAL_LOAD, MOST_LOAD = 80.0, 55.0, 98.0


# What the names of low-cost and of full-service carriers contain; the former are tried first.
LOW_COST = ("vietjet", "bamboo", "vietravel", "sun phuquoc", "air asia", "airasia", "cebu pacific", "scoot", "lion air", "batik", "citilink", "flyone", "t'way", "eastar", "jeju air", "jin air", "air seoul", "air busan", "aero-k", "air premia", "peach", "tigerair", "express", "greater bay", "spring airlines", "indigo", "pegasus", "skyup", "transavia", "ruili")
FULL_SERVICE = ("vietnam airlines", "vasco", "pacific airlines", "singapore airlines", "malaysia airlines", "thai airways", "philippine airlines", "royal brunei", "myanmar", "lao airlines", "cambodia", "korean air", "asiana", "japan airlines", "all nippon", "china airlines", "eva air", "starlux", "cathay", "macau", "mandarin", "china southern", "china eastern", "air china", "hainan", "shenzhen", "xiamen", "sichuan", "shandong", "chongqing", "emirates", "qatar", "etihad", "saudi", "ethiopian", "air france", "lufthansa", "turkish", "iberia", "united airlines", "cubana", "mongolian", "bhutan", "drukair")


def airline_type(airline: Column) -> Column:
    """LCC, FSC or Other by what the airline's name contains."""
    name = F.coalesce(F.lower(airline), F.lit(""))
    low, full = (name.rlike("|".join(names)) for names in (LOW_COST, FULL_SERVICE))
    return F.when(low, "LCC").when(full, "FSC").otherwise("Other")


def time_of_day(hour: Column) -> Column:
    """Early_Morning to 5, Morning to 11, Afternoon to 17, then Night; Unknown without an hour."""
    return F.when(hour.isNull(), "Unknown").when(hour < 6, "Early_Morning").when(hour < 12, "Morning").when(hour < 18, "Afternoon").otherwise("Night")


def lookup(column: Column, table: dict[str, object], default: object = None) -> Column:
    out = F.lit(default)
    for key, value in table.items():
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def wind_components(speed: Column, direction: Column, heading: Column) -> dict[str, Column]:
    angle = F.radians(direction - heading)
    head = speed * F.cos(angle)
    return {"crosswind": F.abs(speed * F.sin(angle)), "headwind": head, "tailwind": F.greatest(F.lit(0.0), -head)}


def sector(direction: Column) -> Column:
    """Eight sectors; a bound belongs to the sector before it."""
    turned = F.pmod(direction, F.lit(360.0))
    out = F.lit("N")
    for i, name in reversed([*enumerate(("NE", "E", "SE", "S", "SW", "W", "NW"), 1)]):
        out = F.when((turned > 45 * i - 22.5) & (turned <= 45 * i + 22.5), name).otherwise(out)
    return out


def weather_group(code: Column) -> Column:
    """Group of a WMO present-weather code."""
    return F.when(code.isNull(), "unknown").when(code == 0, "clear").when(code <= 3, "cloudy").when(code.isin(45, 48), "fog").when(code.between(51, 57), "drizzle").when(code.between(61, 67), "rain").when(code.between(71, 77), "snow").when(code.between(80, 82), "showers").when(code.isin(95, 96, 99), "thunderstorm").otherwise("other")


def _int(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def weather_features(c: dict[str, Column]) -> dict[str, Column]:
    """Flags and scores from precipitation, wind, visibility, humidity, temperature, dew_point, cloud, low_cloud, cape,
    lifted, code, tailwind_kt, crosswind_kt and hour."""
    rain, heavy = _int(c["precipitation"] > 0), _int(c["precipitation"] >= 5)
    strong, gale = _int(c["wind"] >= 30), _int(c["wind"] >= 50)
    low, three, one = _int(c["visibility"] < 5000), _int(c["visibility"] < 4828.032), _int(c["visibility"] < 1609.344)
    radiation = (c["temperature"] - c["dew_point"] <= 1.5) & (c["humidity"] >= 90) & (c["wind"] < 10) & c["hour"].between(0, 8)
    fog = F.greatest(_int((c["visibility"] < 1000) & (c["humidity"] > 90)), _int(radiation), _int(c["code"].isin(45, 48)))
    ceiling = _int(c["low_cloud"] >= 80)
    severe = _int((c["cape"] >= 1500) & (c["lifted"] <= -3))
    storm = F.greatest(_int((c["cloud"] > 80) & (c["precipitation"] > 0)), severe, _int(c["code"].isin(95, 96, 99)))
    wet = F.when(heavy == 1, 2).when(rain == 1, 1).otherwise(0)
    cold = _int(c["temperature"] <= 5)
    wet_risk, ice_risk = wet * _int(c["temperature"] > 5), wet * cold
    swap = F.when(c["tailwind_kt"] >= 5, F.when(wet_risk > 0, 2).otherwise(1)).otherwise(0)
    cross = {knots: _int(c["crosswind_kt"] >= knots) for knots in (10, 15, 20)}
    convection = _int(c["cape"] >= 1000) + _int(c["cape"] >= 1500) + _int(c["lifted"] <= -3) + _int(c["lifted"] <= -5)
    severity = low + three + 2 * one
    delay = F.least(F.lit(5), heavy + strong + 2 * gale + low + 2 * fog + ice_risk + storm + ceiling)
    operational = F.least(F.lit(8), severity + cross[10] + cross[15] + cross[20] + heavy + wet_risk + swap + storm + ceiling)
    flags = {"is_rain": rain, "is_heavy_rain": heavy, "is_strong_wind": strong, "is_gale": gale, "is_low_visibility": low, "visibility_severity": severity, "is_fog": fog, "is_low_ceiling": ceiling, "is_severe_convection": severe, "convection_score": convection, "is_thunderstorm": storm, "runway_wet": wet_risk, "runway_ice_risk": ice_risk, "forced_swap_risk": swap, "delay_risk": delay, "operational_risk": operational}
    return flags | {f"is_crosswind_{k}kt": v for k, v in cross.items()}


def is_wide_body(aircraft: Column) -> Column:
    return F.coalesce(F.upper(F.trim(aircraft)).isin(*WIDE_BODIES), F.lit(False))


def standard_turnaround(aircraft: Column) -> Column:
    """Minutes: wide bodies, regional turboprops, others."""
    regional = F.coalesce(F.upper(F.trim(aircraft)).startswith(REGIONAL), F.lit(False))
    return F.when(is_wide_body(aircraft), WIDE_TURNAROUND).when(regional, REGIONAL_TURNAROUND).otherwise(STANDARD_TURNAROUND)


def alert_tier(minutes: Column) -> Column:
    return F.when(minutes <= 15, "on_time").when(minutes <= 45, "minor").otherwise("major")


def delay_code(delay: Column, scheduled_known: Column, cancelled: Column, reasons: dict[str, Column]) -> Column:
    """The gate, then the first reason that holds, in order; CODE_99 without one. Null: no schedule or cancelled."""
    out = F.lit("CODE_99")
    for code, holds in reversed(reasons.items()):
        out = F.when(F.coalesce(holds, F.lit(False)), code).otherwise(out)
    return F.when(~scheduled_known | cancelled, None).when(F.coalesce(delay, F.lit(0)) < 15, "-1").otherwise(out)


def live_risk(precipitation: Column, wind: Column) -> Column:
    """From the weather of the moment, 0 to 1; of missing values the usual ones count."""
    return F.least(F.lit(1.0), F.coalesce(precipitation, F.lit(0.0)) / 15 + F.coalesce(wind, F.lit(12.0)) / 60)


def expected_load(peak: Column, median_delay: Column) -> Column:
    base = F.when(peak, PEAK_LOAD).otherwise(USUAL_LOAD)
    return F.least(F.lit(MOST_LOAD), base + 0.8 * F.coalesce(median_delay, F.lit(0.0)))


def taxi_minutes(load: Column) -> Column:
    return 12 + 0.4 * F.greatest(F.lit(0.0), load - 50)


# Gates of DAD's terminals with a jet bridge, and those served by bus.
JET_GATES = {"1": (4, 5, 6, 7, 8), "2": (4, 5, 6, 7)}
BUS_GATES = {"1": (1, 2, 3, 9, 10, 11), "2": (1, 2, 3, 8, 9, 10)}


def has_jet_bridge(terminal: Column, gate: Column) -> Column:
    """1, 0, or null where terminal and gate do not tell."""
    hall = F.regexp_replace(F.trim(terminal), r"\.0$", "")
    number = F.regexp_extract(gate, r"(\d{1,2})", 1).try_cast("int")
    out = F.lit(None).cast("int")
    for value, gates in ((1, JET_GATES), (0, BUS_GATES)):
        for name, numbers in gates.items():
            out = F.when((hall == name) & number.isin(*numbers), value).otherwise(out)
    return out


def terminal(at: Column, other_is_domestic: Column, flight_no: Column, airline: Column) -> Column:
    """Terminal of a flight at an airport; N/A where no rule names one."""
    low_cost = F.upper(flight_no).startswith("VJ") | F.lower(airline).contains("vietjet")
    domestic = F.when(F.upper(at).isin("DAD", "HAN"), "1").when(F.upper(at) == "SGN", F.when(F.coalesce(low_cost, F.lit(False)), "1").otherwise("3")).otherwise("N/A")
    return F.when(other_is_domestic, domestic).otherwise("2")


def shown_terminal(category: Column, shown: Column, ruled: Column) -> Column:
    """Cargo has terminal 0; then what the page shows, then the rule's."""
    known = F.when(~F.lower(F.trim(shown)).isin("n/a", "—", "-", "unknown", ""), shown)
    return F.when(F.lower(category) == "cargo", "0").otherwise(F.coalesce(known, ruled))
