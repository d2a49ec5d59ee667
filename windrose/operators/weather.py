"""What hourly weather has come to: changes and sums of the hours before, gusts, and how far visibility falls short."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrose.functions.rules import KMH_PER_KNOT
from windrose.operators.history import rolling

# Fixed values in metres: low visibility, three statute miles, one.
LOW_VISIBILITY, THREE_MILES, MILE = 5000.0, 4828.032, 1609.344


def trends(df: DataFrame, on: Sequence[str], order_by: Sequence[str], bucket: int | None = None) -> DataFrame:
    """``df`` (temperature, pressure, precipitation, wind, crosswind, visibility, dew_point) with its temporal set.

    Rows are hours in order; the estimated gust is the strongest wind of three, its variation what that has over the present
    one. With ``bucket`` (microseconds of the first of ``order_by``) a key's rows go to stretches of time.
    """
    frames = {
        "temperature_change_1h": ("diff", "temperature", 1), "temperature_change_3h": ("diff", "temperature", 3), "pressure_change_3h": ("diff", "pressure", 3),
        "precipitation_1h": ("sum", "precipitation", 1), "precipitation_3h": ("sum", "precipitation", 3), "precipitation_6h": ("sum", "precipitation", 6),
        "gust": ("max", "wind", 3), "crosswind_max_3h": ("max", "crosswind", 3),
    }
    out = rolling(df, on, order_by, frames, bucket)
    least = lambda x: F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))
    out = out.withColumns({"gust_variation": least(F.col("gust") - F.col("wind")), "visibility_miles": F.col("visibility") / MILE, "visibility_deficit_low": least(LOW_VISIBILITY - F.col("visibility")), "visibility_deficit_3sm": least(THREE_MILES - F.col("visibility")), "dew_point_spread": F.col("temperature") - F.col("dew_point")})
    return out.withColumns({f"{c}_kt": F.col(c) / KMH_PER_KNOT for c in ("gust", "crosswind_max_3h", "gust_variation")})
