"""Feature transforms: golden trips through every path, contract edges, independence, rounding."""

import ast
import math
import random
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tripparity.functions.numeric import round6
from tripparity.operators.canonical import canonical_features
from tripparity.operators.faults import SKEW_MODES
from tripparity.operators.online import online_features
from tripparity.operators.pairs import accepted, serve_requests
from tripparity.operators.shared import shared_features, training_features
from tripparity.operators.vector import FEATURE_NAMES, vector_violations
from tripparity.sources.requests import requests_from_trips
from tripparity.sources.trips import load_trips

from conftest import SF_SMALL

SCHEMA = ("pickup_datetime timestamp, pickup_location_id int, dropoff_location_id int, "
          "passenger_count int, trip_distance_miles double")


def _trip(spark, when, passengers=None, distance=4.5):
    return spark.createDataFrame([(when, 132, 236, passengers, distance)], SCHEMA)


def _row(df):
    return df.collect()[0].asDict()


CLOCK = ("pickup_hour", "pickup_day_of_week", "pickup_month", "is_weekend", "is_rush_hour")

# Pickup (UTC), passengers, miles -> New York clock fields, then the same read as UTC.
GOLDEN = (
    ((2024, 1, 8, 11, 59), None, 1.1234567, (6, 0, 1, 0, 0), (11, 0, 1, 0, 0)),
    ((2024, 1, 8, 12, 0), 2, 4.5, (7, 0, 1, 0, 1), (12, 0, 1, 0, 0)),
    ((2024, 1, 8, 13, 30), None, 4.5, (8, 0, 1, 0, 1), (13, 0, 1, 0, 0)),
    ((2024, 1, 8, 15, 0), 4, 8.25, (10, 0, 1, 0, 0), (15, 0, 1, 0, 0)),
    ((2024, 1, 13, 5, 30), 1, 2.0, (0, 5, 1, 1, 0), (5, 5, 1, 1, 0)),
    ((2024, 7, 8, 12, 30), 3, 9.0, (8, 0, 7, 0, 1), (12, 0, 7, 0, 0)),
    ((2024, 1, 1, 0, 30), 1, 2.0, (19, 6, 12, 1, 0), (0, 0, 1, 0, 0)),
)


def test_golden_trips_through_every_path_and_fault(spark):
    """One table of trips; each path's whole output is compared with the expected vectors."""
    rows = [(i, datetime(*when, tzinfo=timezone.utc), 132, 236, seats, miles)
            for i, (when, seats, miles, _, _) in enumerate(GOLDEN)]
    trips = spark.createDataFrame(rows, "trip_id int, " + SCHEMA)

    def expected(kilometres: bool, utc: bool) -> dict[int, tuple]:
        out = {}
        for i, (_, seats, miles, local, zulu) in enumerate(GOLDEN):
            distance = round(round(miles, 6) * 1.609344, 6) if kilometres else round(miles, 6)
            out[i] = (distance, seats or 1, 132, 236, *(zulu if utc else local))
        return out

    paths = {
        "canonical": (canonical_features(trips, keep=("trip_id",)), False, False),
        "shared": (shared_features(trips, keep=("trip_id",)), False, False),
        "online": (online_features(trips, keep=("trip_id",)), False, False),
        "online, distance": (online_features(trips, "distance_unit", keep=("trip_id",)), True, False),
        "online, time zone": (online_features(trips, "timezone", keep=("trip_id",)), False, True),
    }
    for name, (table, kilometres, utc) in paths.items():
        assert tuple(table.columns) == ("trip_id", *FEATURE_NAMES), name
        assert {r[0]: tuple(r[1:]) for r in table.collect()} == expected(kilometres, utc), name


def test_session_time_zone_does_not_change_features(spark):
    trip = _trip(spark, datetime(2024, 1, 8, 13, 30, tzinfo=timezone.utc))
    before = _row(shared_features(trip))
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        after = _row(shared_features(_trip(spark, datetime(2024, 1, 8, 13, 30, tzinfo=timezone.utc))))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert before == after


def test_training_path_reads_wall_clock_as_new_york(spark):
    raw = spark.createDataFrame(
        [(datetime(2024, 3, 10, 2, 30), 1.0, 2.0, 1.0, 1.0, 10.0),   # inside the DST gap
         (datetime(2024, 11, 3, 1, 30), 1.9, 2.0, 5.7, 1.0, 10.0),  # the repeated hour; truncation
         (datetime(2024, 1, 1, 0, 30), 1.0, 2.0, 1.0, 1.0, 10.0)],
        "tpep_pickup_datetime timestamp_ntz, passenger_count double, trip_distance double, "
        "PULocationID double, DOLocationID double, fare_amount double")
    rows = training_features(raw).collect()
    assert rows[0]["pickup_hour"] == 2
    assert rows[1]["pickup_hour"] == 1 and rows[1]["passenger_count"] == 1 and rows[1]["pickup_location_id"] == 5
    assert rows[2]["pickup_month"] == 1


def test_the_online_path_is_written_independently():
    """Neither of the other transforms is reachable from the module by import."""
    import tripparity.operators.online as online_module

    text = Path(online_module.__file__).read_text()
    assert not {"canonical", "shared"} & {part for node in ast.walk(ast.parse(text))
                                          for part in str(getattr(node, "module", "")).split(".")}
    assert len(SKEW_MODES) == 3


def test_round6_matches_python_round(spark):
    rng = random.Random(7)
    values = [0.1234565, 1.0000005, 0.0000025, 2.5e-7, 5e-7, 1.1234567, 123.4567895, -0.0000015,
              7.242048, 4.5 * 1.609344, 1e12 + 0.1234565, 0.0]
    values += [rng.uniform(-1000, 1000) for _ in range(500)]
    values += [rng.randint(0, 10**7) / 1e6 + 5e-7 for _ in range(300)]  # near-ties
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = df.select(round6(F.col("x")), round6("x")).collect()
    for v, (g, g_sql) in zip(values, rows):
        assert g == round(v, 6) or (g == 0 and round(v, 6) == 0), (v, g, round(v, 6))
        assert g_sql == g
    special = spark.createDataFrame([(math.inf,), (-math.inf,)], "x double").select(round6(F.col("x")))
    assert [r[0] for r in special.collect()] == [math.inf, -math.inf]


def test_clauses_not_checked_at_run_time_hold_by_construction(spark):
    """Requests at the edges of their contract: whatever is accepted satisfies the whole vector contract."""
    edge = [(datetime(y, m, d, h, 59, 59, tzinfo=timezone.utc), zone, zone, seats, miles, mode, skew)
            for y, m, d, h in ((1970, 1, 1, 0), (2024, 2, 29, 23), (2024, 3, 10, 7), (2024, 11, 3, 6), (2099, 12, 31, 23))
            for zone in (0, 1, 2 ** 63 - 1) for seats in (None, 0, 1, 8, 9) for miles in (0.0, 4e-7, 1e-6, 500.0, 500.1)
            for mode, skew in (("broken", "none"), ("broken", "distance_unit"), ("broken", "timezone"), ("correct", "none"))]
    requests = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(edge)], "request_id long, pickup_datetime timestamp, pickup_location_id long, "
        "dropoff_location_id long, passenger_count int, trip_distance_miles double, feature_mode string, skew_mode string")
    ok = accepted(serve_requests(requests)).cache()
    assert ok.count() == 5 * 2 * 3 * 2 * 4
    assert ok.where((F.size(vector_violations("t_")) > 0) | (F.size(vector_violations("s_")) > 0)).count() == 0


def test_whole_table_paths_agree_and_vectors_keep_their_contract(spark):
    served = serve_requests(requests_from_trips(load_trips(spark, SF_SMALL)))
    ok = accepted(served)
    # correct mode: both vectors come from the shared transform and match exactly
    correct = ok.where("feature_mode = 'correct'")
    diff = correct.where(" OR ".join(f"NOT (t_{n} <=> s_{n})" for n in FEATURE_NAMES)).count()
    assert diff == 0
    # the full vector contract holds for every accepted row, on both sides
    bad = ok.where((F.size(vector_violations("t_")) > 0) | (F.size(vector_violations("s_")) > 0)).count()
    assert bad == 0
    # broken mode with no fault: canonical and online transforms agree
    none = ok.where("feature_mode = 'broken' AND skew_mode = 'none'")
    assert none.where(" OR ".join(f"NOT (t_{n} <=> s_{n})" for n in FEATURE_NAMES)).count() == 0
