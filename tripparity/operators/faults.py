"""Serving faults injected per row, so one table may mix modes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripparity.functions.numeric import miles_to_kilometres
from tripparity.functions.time import calendar_fields, calendar_fields_sql
from tripparity.operators.vector import FEATURE_NAMES

# The skew modes, in their declared order, and the feature modes.
SKEW_NONE = "none"
SKEW_DISTANCE_UNIT = "distance_unit"
SKEW_TIMEZONE = "timezone"
SKEW_MODES = (SKEW_NONE, SKEW_DISTANCE_UNIT, SKEW_TIMEZONE)

FEATURE_MODE_BROKEN = "broken"
FEATURE_MODE_CORRECT = "correct"
FEATURE_MODES = (FEATURE_MODE_BROKEN, FEATURE_MODE_CORRECT)


def apply_fault(vector: dict[str, Column], pickup_utc_wall_clock: Column | str,
                skew_mode: Column, distance_sql: str | None = None) -> dict[str, Column]:
    """Returns the feature columns with the requested fault applied.

    distance_unit: only the distance changes (miles read as kilometres, rounded to 6 decimals).
    timezone: the five time features are re-derived from the UTC wall clock.
    ``distance_sql`` optionally gives the vector's distance as SQL text (cheaper to build).
    """
    utc_fields = (calendar_fields_sql(pickup_utc_wall_clock) if isinstance(pickup_utc_wall_clock, str)
                  else calendar_fields(pickup_utc_wall_clock))
    values = {}
    for name in FEATURE_NAMES:
        base = vector[name]
        if name == "trip_distance_miles":
            km = miles_to_kilometres(distance_sql if distance_sql is not None else base)
            values[name] = F.when(skew_mode == F.lit(SKEW_DISTANCE_UNIT), km).otherwise(base)
        elif name in utc_fields:
            values[name] = F.when(skew_mode == F.lit(SKEW_TIMEZONE), utc_fields[name]).otherwise(base)
        else:
            values[name] = base
    return values
