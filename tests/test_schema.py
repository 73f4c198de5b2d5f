"""Raw-trip contract: single-clause violations, lazy violation table, strict columns, counts."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tripparity.operators import contracts
from tripparity.plans import catalog

from conftest import SF_MEDIUM, SF_SMALL

COLUMNS = ("trip_id", "tpep_pickup_datetime", "passenger_count", "trip_distance", "PULocationID",
           "DOLocationID", "fare_amount")
SCHEMA = ("trip_id long, tpep_pickup_datetime timestamp_ntz, passenger_count double, trip_distance double, "
          "PULocationID double, DOLocationID double, fare_amount double")
BASE = {"tpep_pickup_datetime": datetime(2024, 1, 8, 13, 30), "passenger_count": 2.0, "trip_distance": 4.5,
        "PULocationID": 132.0, "DOLocationID": 236.0, "fare_amount": 20.0}


def _raw(spark, *rows):
    data = [(i, *[{**BASE, **r}[c] for c in COLUMNS[1:]]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def _valid(spark, *rows):
    return contracts.valid_trips(contracts.coerce_raw(_raw(spark, *rows), key_columns=("trip_id",)))


def test_keeps_fully_valid_rows(spark):
    assert _valid(spark, {}, {}).count() == 2


@pytest.mark.parametrize("override", [
    {"tpep_pickup_datetime": None}, {"passenger_count": 9.0}, {"passenger_count": 0.0},
    {"trip_distance": 0.0}, {"trip_distance": 150.0}, {"fare_amount": 0.0}, {"fare_amount": -5.0},
    {"fare_amount": 600.0}, {"PULocationID": 0.0}, {"DOLocationID": 0.0}, {"fare_amount": float("nan")},
])
def test_drops_rows_violating_a_single_clause(spark, override):
    kept = _valid(spark, {}, override).collect()
    assert [r.trip_id for r in kept] == [0]


def test_boundaries_are_inclusive_and_null_passengers_default_to_one(spark):
    rows = [{"passenger_count": 1.0}, {"passenger_count": 8.0}, {"trip_distance": 0.01},
            {"trip_distance": 100.0}, {"fare_amount": 0.01}, {"fare_amount": 500.0}, {"PULocationID": 1.0},
            {"passenger_count": None}]
    assert _valid(spark, *rows).count() == len(rows)


def test_all_invalid_gives_an_empty_table(spark):
    assert _valid(spark, {"fare_amount": -1.0}).count() == 0
    with pytest.raises(contracts.ContractError):
        contracts.require_non_empty(_valid(spark, {"fare_amount": -1.0}))


def test_unexpected_and_missing_columns_are_rejected(spark):
    raw = _raw(spark, {}).withColumn("surcharge", F.lit(1.0))
    with pytest.raises(contracts.ContractError):
        contracts.coerce_raw(raw, key_columns=("trip_id",))
    with pytest.raises(contracts.ContractError):
        contracts.coerce_raw(_raw(spark, {}).drop("fare_amount"), key_columns=("trip_id",))


def test_string_columns_are_coerced_bad_values_become_null(spark):
    raw = spark.createDataFrame(
        [(0, "2024-01-08 13:30:00", "2", "4.5", "132", "236", "20.0"),
         (1, "not a date", "2", "4.5", "132", "236", "20.0"),
         (2, "2024-01-08 13:30:00", "two", "4.5", "132", "236", "20.0"),
         (3, "2024-01-08 13:30:00", "2", "far", "132", "236", "20.0")],
        "trip_id long, tpep_pickup_datetime string, passenger_count string, trip_distance string, "
        "PULocationID string, DOLocationID string, fare_amount string")
    coerced = contracts.coerce_raw(raw, key_columns=("trip_id",))
    # a non-numeric passenger count becomes null and then the default 1: valid, like the reference
    assert sorted(r.trip_id for r in contracts.valid_trips(coerced).collect()) == [0, 2]


def test_violation_table_lists_every_failure(spark):
    coerced = contracts.coerce_raw(_raw(spark, {}, {"fare_amount": -5.0, "PULocationID": 0.0}),
                                   key_columns=("trip_id",))
    rows = contracts.trip_violations(coerced).collect()
    assert sorted((r.trip_id, r.column) for r in rows) == [(1, "PULocationID"), (1, "fare_amount")]


@pytest.mark.parametrize(("sf_dir", "rows", "valid", "passengers_out", "fare_out"), [
    (SF_SMALL, 1000, 809, 119, 16), (SF_MEDIUM, 10000, 8742, 980, 205)])
def test_fixture_counts(spark, sf_dir, rows, valid, passengers_out, fare_out):
    counts = {r.column: r for r in catalog.q_trips_violation_counts(spark, sf_dir).collect()}
    assert counts["fare_amount"].rows == rows and counts["fare_amount"].valid == valid
    assert counts["passenger_count"].failing_rows == passengers_out
    assert counts["fare_amount"].failing_rows == fare_out
    assert counts["tpep_pickup_datetime"].failing_rows == 0
