"""Contracts as data: raw-trip validation (P1-P15) and request validation.

Each clause is one boolean column; a row is valid when all hold. Nulls and NaN fail every numeric
clause. Violations are produced row-locally (no shuffle); their counts are one aggregate with a
``count_if`` per clause, so the table is never expanded before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (DateType, NumericType, StringType, TimestampNTZType,
                               TimestampType)

from tripparity.functions.arrays import compact
from tripparity.functions.numeric import not_nan
from tripparity.functions.time import has_offset, instant_of, to_new_york, utc_wall_clock
from tripparity.operators.faults import FEATURE_MODES, SKEW_MODES
from tripparity.sources.trips import RAW_COLUMNS


class ContractError(ValueError):
    """A table-level contract failure (missing or unexpected columns, no valid rows)."""


@dataclass(frozen=True)
class Clause:
    column: str
    check: str
    lower: float | None = None
    upper: float | None = None
    limit: float | None = None  # the first value that the feature's type cannot hold

    def holds(self, value: Column) -> Column:
        if self.check == "not_null":
            return value.isNotNull()
        ok = value.isNotNull() & not_nan(value)
        if self.lower is not None:
            ok = ok & (value >= F.lit(self.lower))
        if self.upper is not None:
            ok = ok & (value <= F.lit(self.upper))
        if self.limit is not None:
            ok = ok & (value < F.lit(self.limit))
        return F.coalesce(ok, F.lit(False))

    @property
    def name(self) -> str:
        if self.check == "not_null":
            return "not_null"
        if self.upper is None:
            return f"greater_than_or_equal_to({self.lower})"
        return f"in_range({self.lower}, {self.upper})"


# The raw-trip contract. Bounds are inclusive on both sides.
RAW_TRIP_CONTRACT = (
    Clause("tpep_pickup_datetime", "not_null"),
    Clause("passenger_count", "range", 1.0, 8.0),
    Clause("trip_distance", "range", 0.01, 100.0),
    Clause("PULocationID", "range", 1.0, None, 2.0 ** 63),
    Clause("DOLocationID", "range", 1.0, None, 2.0 ** 63),
    Clause("fare_amount", "range", 0.01, 500.0),
)


def check_columns(df: DataFrame, key_columns: tuple[str, ...] = ()) -> None:
    """P11 strict column set, checked at plan time."""
    present = [c for c in df.columns if c not in key_columns]
    missing = [c for c in RAW_COLUMNS if c not in present]
    unexpected = [c for c in present if c not in RAW_COLUMNS]
    if missing:
        raise ContractError(f"missing raw columns: {missing}")
    if unexpected:
        raise ContractError(f"unexpected raw columns: {unexpected}")


def coerce_raw(df: DataFrame, key_columns: tuple[str, ...] = ()) -> DataFrame:
    """Strict columns, bad values -> null, null passengers -> 1 before validation.

    Columns that already have the contract's type are passed through uncast so that range
    predicates can still be pushed into the Parquet scan.
    """
    check_columns(df, key_columns)
    out = []
    for name in RAW_COLUMNS:
        data_type = df.schema[name].dataType
        column = F.col(name)
        if name == "tpep_pickup_datetime":
            if isinstance(data_type, (TimestampNTZType, TimestampType)):
                value = column
            elif isinstance(data_type, (StringType, DateType)):
                value = _new_york_wall_clock(column) if isinstance(data_type, StringType) else column.try_cast("timestamp_ntz")
            else:
                raise ContractError(f"{name} cannot be read as a datetime ({data_type.simpleString()})")
        elif isinstance(data_type, NumericType):
            value = column if data_type.typeName() == "double" else column.cast("double")
        else:
            value = column.try_cast("double")
        if name == "passenger_count":
            value = F.coalesce(value, F.lit(1.0))
        out.append(value.alias(name))
    return df.select(*key_columns, *out)


def _new_york_wall_clock(text: Column) -> Column:
    """Text without an offset is New York wall clock; with one it is an instant and converted."""
    instant = instant_of(text)
    local = to_new_york(utc_wall_clock(instant, TimestampType()))
    return F.when(has_offset(text), local).otherwise(text.try_cast("timestamp_ntz"))


def raw_clause_results(df: DataFrame) -> list[tuple[Clause, Column]]:
    return [(clause, clause.holds(F.col(clause.column))) for clause in RAW_TRIP_CONTRACT]


def all_clauses_hold(df: DataFrame) -> Column:
    ok = F.lit(True)
    for _, holds in raw_clause_results(df):
        ok = ok & holds
    return ok


def valid_trips(coerced: DataFrame) -> DataFrame:
    """Keep the rows that satisfy every clause (order of the rest unchanged)."""
    return coerced.where(all_clauses_hold(coerced))


def violation_array(df: DataFrame) -> Column:
    """Every failed clause of a row as ``array<struct<column, check, failure_case>>``."""
    failures = [
        F.when(~holds, F.struct(F.lit(clause.column).alias("column"),
                                F.lit(clause.name).alias("check"),
                                F.col(clause.column).cast("string").alias("failure_case")))
        for clause, holds in raw_clause_results(df)
    ]
    return compact(failures, "struct<column:string,check:string,failure_case:string>")


def trip_violations(coerced: DataFrame, key: str = "trip_id") -> DataFrame:
    """P13 as a table: one row per (trip, failed clause)."""
    return coerced.select(F.col(key), F.inline(violation_array(coerced)))


def violation_counts(coerced: DataFrame) -> DataFrame:
    """Failing-row count per clause, plus ``rows`` and ``valid`` totals; one pass, one tiny shuffle."""
    results = raw_clause_results(coerced)
    aggs = [F.count_if(~holds).alias(f"c{i}") for i, (_, holds) in enumerate(results)]
    aggs.append(F.count(F.lit(1)).alias("rows"))
    aggs.append(F.count_if(all_clauses_hold(coerced)).alias("valid"))
    summary = coerced.agg(*aggs)
    pairs = [F.struct(F.lit(clause.column).alias("column"), F.lit(clause.name).alias("check"),
                      F.col(f"c{i}").alias("failing_rows"))
             for i, (clause, _) in enumerate(results)]
    return summary.select(F.inline(F.array(*pairs)), "rows", "valid")


def require_non_empty(df: DataFrame) -> DataFrame:
    """P15."""
    if df.isEmpty():
        raise ContractError("validation left no trip to train on")
    return df


# ----------------------------------------------------------------------------- requests

# The request contract. Zones >= 1; passengers null or 1..8; distance (0, 500].
REQUEST_MIN_ZONE = 1
REQUEST_PASSENGERS = (1, 8)
REQUEST_MAX_DISTANCE = 500.0


Holds = Column | str  # a boolean Column, or SQL text of one


def request_clauses(df: DataFrame) -> list[tuple[str, Holds]]:
    """P19/P20 as (reason, holds) pairs; ``holds`` is SQL text and never null."""
    dist = "CAST(`trip_distance_miles` AS DOUBLE)"
    low, high = REQUEST_PASSENGERS
    clauses: list[tuple[str, Holds]] = [
        ("pickup_datetime_missing", "`pickup_datetime` IS NOT NULL"),
        ("pickup_location_id_below_1", f"coalesce(`pickup_location_id` >= {REQUEST_MIN_ZONE}, false)"),
        ("dropoff_location_id_below_1", f"coalesce(`dropoff_location_id` >= {REQUEST_MIN_ZONE}, false)"),
        ("passenger_count_out_of_range",
         f"coalesce(`passenger_count` BETWEEN {low} AND {high}, `passenger_count` IS NULL)"),
        ("trip_distance_miles_out_of_range",
         f"coalesce(NOT isnan({dist}) AND {dist} > 0.0D AND {dist} <= {REQUEST_MAX_DISTANCE!r}D, false)"),
        ("feature_mode_unknown",
         "coalesce(`feature_mode` IN (" + ", ".join(f"'{m}'" for m in FEATURE_MODES) + "), false)"),
        ("skew_mode_unknown",
         "coalesce(`skew_mode` IN (" + ", ".join(f"'{m}'" for m in SKEW_MODES) + "), false)"),
    ]
    if "parse_errors" in df.columns:
        clauses.insert(0, ("parse_error", "size(`parse_errors`) = 0"))
    return clauses


def _as_column(holds: Holds) -> Column:
    return F.expr(holds) if isinstance(holds, str) else holds


def reasons_of(clauses: list[tuple[str, Holds]]) -> Column:
    """The reasons of the clauses that fail (empty array when all hold)."""
    if all(isinstance(h, str) for _, h in clauses):
        items = ", ".join(f"CASE WHEN NOT ({h}) THEN '{reason}' END" for reason, h in clauses)
        return F.expr(f"array_except(array({items}), array(CAST(NULL AS STRING)))")
    return compact([F.when(~_as_column(holds), F.lit(reason)) for reason, holds in clauses])


def all_of(clauses: list[tuple[str, Holds]]) -> Column:
    if all(isinstance(h, str) for _, h in clauses):
        return F.expr(" AND ".join(f"({h})" for _, h in clauses) or "true")
    ok = F.lit(True)
    for _, holds in clauses:
        ok = ok & _as_column(holds)
    return ok


def request_rejections(df: DataFrame, clauses: list[tuple[str, Holds]] | None = None) -> Column:
    """Reasons a request is rejected (empty array when accepted); parse errors first.

    ``clauses`` may pass in an already built ``request_clauses(df)``.
    """
    clauses = [c for c in (clauses if clauses is not None else request_clauses(df)) if c[0] != "parse_error"]
    found = reasons_of(clauses)
    if "parse_errors" in df.columns:
        found = F.concat(F.col("parse_errors"), found)
    return found
