"""The single production transform shared by training and serving.

``shared_vector`` returns one struct column built from native expressions; the same function is
used by batch training jobs, batch scoring and Structured Streaming, which is what keeps the two
sides equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from tripparity.functions.numeric import DEFAULT_PASSENGER_COUNT, round6
from tripparity.functions.time import calendar_fields_sql, to_new_york_sql, utc_wall_clock_sql
from tripparity.operators.vector import flat_features, vector_struct


def shared_columns(df: DataFrame, *, pickup: str = "pickup_datetime",
                  passengers: str = "passenger_count", distance: str = "trip_distance_miles",
                  pickup_zone: str = "pickup_location_id", dropoff_zone: str = "dropoff_location_id",
                  pickup_is_new_york_wall_clock: bool = False) -> dict[str, Column]:
    """The nine features of each row, keyed by feature name.

    ``pickup_is_new_york_wall_clock`` declares a TIMESTAMP_NTZ pickup to already be New York local
    time (the training convention); otherwise an NTZ pickup is a UTC wall clock and a TIMESTAMP
    pickup an instant, and both are converted to New York.
    """
    data_type = df.schema[pickup].dataType
    if pickup_is_new_york_wall_clock and isinstance(data_type, TimestampNTZType):
        wall_clock = f"`{pickup}`"
    else:
        wall_clock = to_new_york_sql(utc_wall_clock_sql(pickup, data_type))
    values = {
        "trip_distance_miles": round6(f"CAST(`{distance}` AS DOUBLE)"),
        "passenger_count": F.expr(f"coalesce(try_cast(`{passengers}` AS INT), {DEFAULT_PASSENGER_COUNT})"),
        "pickup_location_id": F.expr(f"try_cast(`{pickup_zone}` AS BIGINT)"),
        "dropoff_location_id": F.expr(f"try_cast(`{dropoff_zone}` AS BIGINT)"),
        **calendar_fields_sql(wall_clock),
    }
    return values


def shared_vector(df: DataFrame, **kwargs) -> Column:
    """The nine features of each row as a struct."""
    return vector_struct(shared_columns(df, **kwargs))


def shared_features(df: DataFrame, keep: tuple[str, ...] = (), **kwargs) -> DataFrame:
    """T2 as a table: ``keep`` columns followed by the nine features."""
    values = shared_columns(df, **kwargs)
    return df.select(*keep, *flat_features(values))


def training_features(valid_raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Features of validated raw trips plus the float target ``fare_amount``.

    Passenger counts and zone ids are truncated to whole numbers; zone ids are 64-bit.
    """
    values = shared_columns(valid_raw, pickup="tpep_pickup_datetime", passengers="passenger_count",
                            distance="trip_distance", pickup_zone="PULocationID",
                            dropoff_zone="DOLocationID", pickup_is_new_york_wall_clock=True)
    return valid_raw.select(*keep, *flat_features(values),
                            F.col("fare_amount").cast("double").alias("fare_amount"))
