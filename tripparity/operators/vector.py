"""The nine-feature vector: names, order, types and its contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tripparity.functions.arrays import compact
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

# Feature names in their fixed order.
FEATURE_NAMES = (
    "trip_distance_miles",
    "passenger_count",
    "pickup_location_id",
    "dropoff_location_id",
    "pickup_hour",
    "pickup_day_of_week",
    "pickup_month",
    "is_weekend",
    "is_rush_hour",
)

ZONE_FEATURES = ("pickup_location_id", "dropoff_location_id")  # 64-bit: any whole number from 1 is a zone

FEATURE_SCHEMA = StructType(
    [StructField(FEATURE_NAMES[0], DoubleType(), False)]
    + [StructField(name, LongType() if name in ZONE_FEATURES else IntegerType(), False) for name in FEATURE_NAMES[1:]]
)

# The feature-vector contract, (feature, lower, lower inclusive, upper).
# Upper bounds are inclusive; None means unbounded.
FEATURE_CONTRACT = (
    ("trip_distance_miles", 0.0, False, None),
    ("passenger_count", 0, True, 8),
    ("pickup_location_id", 1, True, None),
    ("dropoff_location_id", 1, True, None),
    ("pickup_hour", 0, True, 23),
    ("pickup_day_of_week", 0, True, 6),
    ("pickup_month", 1, True, 12),
    ("is_weekend", 0, True, 1),
    ("is_rush_hour", 0, True, 1),
)


def _require_all(values: dict[str, Column]) -> None:
    missing = [name for name in FEATURE_NAMES if name not in values]
    if missing:
        raise ValueError(f"missing features: {missing}")


def vector_struct(values: dict[str, Column]) -> Column:
    """A feature struct with fields in FEATURE_NAMES order and the declared types."""
    _require_all(values)
    fields = [values["trip_distance_miles"].cast("double").alias("trip_distance_miles")]
    fields += [values[name].try_cast("bigint" if name in ZONE_FEATURES else "int").alias(name)
               for name in FEATURE_NAMES[1:]]
    return F.struct(*fields)


def flat_features(values: dict[str, Column], prefix: str = "", cast: bool = True) -> list[Column]:
    """The nine features as separate columns (optionally prefixed).

    ``cast=False`` is for values already of the declared types (the package's own transforms);
    it saves a cast per feature when the plan is built.
    """
    _require_all(values)
    if not cast:
        return [values[name].alias(f"{prefix}{name}") for name in FEATURE_NAMES]
    out = [values["trip_distance_miles"].cast("double").alias(f"{prefix}trip_distance_miles")]
    out += [values[name].try_cast("bigint" if name in ZONE_FEATURES else "int").alias(f"{prefix}{name}")
            for name in FEATURE_NAMES[1:]]
    return out


def struct_of(prefix: str) -> Column:
    """A feature struct assembled from prefixed flat columns (cheap: attribute references only)."""
    return F.struct(*[F.col(f"{prefix}{name}").alias(name) for name in FEATURE_NAMES])


def vector_violations(vector: Column | str, only: tuple[str, ...] | None = None) -> Column:
    """Contract clauses a feature vector violates (empty array when valid).

    ``vector`` is a struct column, or the prefix of flat feature columns; ``only`` restricts the
    check to some features.
    """
    return compact([F.when(~holds, F.lit(reason)) for reason, holds in vector_clauses(vector, only)])


def vector_clauses(vector: Column | str, only: tuple[str, ...] | None = None) -> list[tuple[str, Column]]:
    """P21 as (reason, holds) pairs."""
    clauses = []
    for name, lower, lower_inclusive, upper in FEATURE_CONTRACT:
        if only is not None and name not in only:
            continue
        value = F.col(f"{vector}{name}") if isinstance(vector, str) else vector[name]
        ok = value.isNotNull()
        if name == "trip_distance_miles":
            ok = ok & ~F.isnan(value)
        if lower is not None:
            ok = ok & ((value >= F.lit(lower)) if lower_inclusive else (value > F.lit(lower)))
        if upper is not None:
            ok = ok & (value <= F.lit(upper))
        clauses.append((f"feature_{name}_out_of_contract", F.coalesce(ok, F.lit(False))))
    return clauses


def ordered_features(df: DataFrame, vector_column: str | None = None) -> DataFrame:
    """The nine features as top-level columns in contract order."""
    if vector_column is None:
        return df.select(*FEATURE_NAMES)
    return df.select(*[F.col(f"{vector_column}.{name}").alias(name) for name in FEATURE_NAMES])


def as_double_features(df: DataFrame) -> DataFrame:
    """Every feature cast to double, for scoring, SHAP and drift."""
    return df.select(*[F.col(name).cast("double").alias(name) for name in FEATURE_NAMES],
                     *[c for c in df.columns if c not in FEATURE_NAMES])
