"""The canonical (training reference) transform, written out on its own.

It must produce exactly what ``shared_vector`` produces; tests hold the two equal on every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tripparity.functions.numeric import round6
from pyspark.sql.types import TimestampNTZType, TimestampType

from tripparity.operators.vector import flat_features, vector_struct


def canonical_columns(df: DataFrame, pickup: str = "pickup_datetime") -> dict[str, Column]:
    pickup_type = df.schema[pickup].dataType
    if isinstance(pickup_type, TimestampType):
        utc = f"timestampadd(MICROSECOND, unix_micros(`{pickup}`), timestamp_ntz'1970-01-01 00:00:00')"
    elif isinstance(pickup_type, TimestampNTZType):
        utc = f"`{pickup}`"
    else:
        raise TypeError(f"pickup must be a timestamp, got {pickup_type.simpleString()}")
    local = f"convert_timezone('UTC', 'America/New_York', {utc})"
    hour, weekday = f"hour({local})", f"weekday({local})"
    return {
        "trip_distance_miles": round6("CAST(`trip_distance_miles` AS DOUBLE)"),
        "passenger_count": F.expr("coalesce(try_cast(`passenger_count` AS INT), 1)"),
        "pickup_location_id": F.expr("try_cast(`pickup_location_id` AS BIGINT)"),
        "dropoff_location_id": F.expr("try_cast(`dropoff_location_id` AS BIGINT)"),
        "pickup_hour": F.expr(hour),
        "pickup_day_of_week": F.expr(weekday),
        "pickup_month": F.expr(f"month({local})"),
        "is_weekend": F.expr(f"CAST({weekday} >= 5 AS INT)"),
        "is_rush_hour": F.expr(f"CAST(({hour} >= 7 AND {hour} < 10) OR ({hour} >= 16 AND {hour} < 19) AS INT)"),
    }


def canonical_vector(df: DataFrame, pickup: str = "pickup_datetime") -> Column:
    return vector_struct(canonical_columns(df, pickup))


def canonical_features(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*keep, *flat_features(canonical_columns(df)))
