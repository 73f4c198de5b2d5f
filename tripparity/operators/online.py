"""An independent serving transform, into which a fault can be injected.

Deliberately does not import the canonical or shared transforms: it stands for a second code path
that has to be kept in parity with training.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from tripparity.functions.numeric import round6_sql

from tripparity.operators.faults import SKEW_NONE, apply_fault
from tripparity.operators.vector import flat_features, vector_struct


def _utc_wall_clock_sql(df: DataFrame, pickup: str) -> str:
    if isinstance(df.schema[pickup].dataType, TimestampType):
        return f"timestampadd(MICROSECOND, unix_micros(`{pickup}`), timestamp_ntz'1970-01-01 00:00:00')"
    return f"`{pickup}`"


def online_columns(df: DataFrame, skew_mode: Column | str | None = None,
                   pickup: str = "pickup_datetime") -> dict[str, Column]:
    utc_sql = _utc_wall_clock_sql(df, pickup)
    local = f"convert_timezone('UTC', 'America/New_York', {utc_sql})"
    distance_sql = "CAST(`trip_distance_miles` AS DOUBLE)"
    round6_sql_text = round6_sql(distance_sql)
    hour_local, dow_local = f"hour({local})", f"weekday({local})"
    rush = f"({hour_local} >= 7 AND {hour_local} < 10) OR ({hour_local} >= 16 AND {hour_local} < 19)"
    values = {
        "trip_distance_miles": F.expr(round6_sql_text),
        "passenger_count": F.expr("CASE WHEN `passenger_count` IS NULL THEN 1 "
                                  "ELSE try_cast(`passenger_count` AS INT) END"),
        "pickup_location_id": F.expr("try_cast(`pickup_location_id` AS BIGINT)"),
        "dropoff_location_id": F.expr("try_cast(`dropoff_location_id` AS BIGINT)"),
        "pickup_hour": F.expr(hour_local),
        "pickup_day_of_week": F.expr(dow_local),
        "pickup_month": F.expr(f"month({local})"),
        "is_weekend": F.expr(f"CASE WHEN {dow_local} >= 5 THEN 1 ELSE 0 END"),
        "is_rush_hour": F.expr(f"CASE WHEN {rush} THEN 1 ELSE 0 END"),
    }
    if skew_mode is None:
        mode = F.lit(SKEW_NONE)
    elif isinstance(skew_mode, str):
        mode = F.lit(skew_mode)
    else:
        mode = skew_mode
    return apply_fault(values, utc_sql, mode, distance_sql=round6_sql_text)


def online_vector(df: DataFrame, skew_mode: Column | str | None = None,
                  pickup: str = "pickup_datetime") -> Column:
    return vector_struct(online_columns(df, skew_mode, pickup))


def online_features(df: DataFrame, skew_mode: Column | str | None = None,
                    keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*keep, *flat_features(online_columns(df, skew_mode)))
