"""Parity: mismatch lists, reports and table-level rollups."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tripparity.operators import parity
from tripparity.operators.pairs import accepted, serve_requests, with_vector_structs
from tripparity.operators.vector import FEATURE_NAMES
from tripparity.sources.requests import requests_from_trips
from tripparity.sources.trips import load_trips

from conftest import SF_SMALL

SCHEMA = ("request_id long, pickup_datetime timestamp, pickup_location_id int, dropoff_location_id int, "
          "passenger_count int, trip_distance_miles double, feature_mode string, skew_mode string")


def _requests(spark, *modes):
    when = datetime(2024, 1, 8, 13, 30, tzinfo=timezone.utc)
    rows = [(i, when, 132, 236, 2, 4.5, fm, sm) for i, (fm, sm) in enumerate(modes)]
    return spark.createDataFrame(rows, SCHEMA)


def _mismatches(spark, feature_mode, skew_mode):
    served = serve_requests(_requests(spark, (feature_mode, skew_mode)))
    return parity.parity_long(served, keys=("request_id",), only_mismatches=True).collect()


def test_distance_unit_fault_is_exactly_one_mismatch(spark):
    rows = _mismatches(spark, "broken", "distance_unit")
    assert [r.feature for r in rows] == ["trip_distance_miles"]
    assert rows[0].absolute_difference > 0
    assert rows[0].relative_difference == rows[0].absolute_difference / 4.5


def test_timezone_fault_mismatches_hour_and_rush(spark):
    rows = _mismatches(spark, "broken", "timezone")
    assert {r.feature for r in rows} == {"pickup_hour", "is_rush_hour"}
    assert all(r.absolute_difference > 0 for r in rows)


def test_correct_mode_has_perfect_parity_and_applies_no_fault(spark):
    assert _mismatches(spark, "correct", "distance_unit") == []
    served = serve_requests(_requests(spark, ("correct", "distance_unit")))
    assert served.first()["applied_skew_mode"] == "none"


def test_report_counts_and_fake_scorer(spark):
    served = serve_requests(_requests(spark, ("broken", "distance_unit"), ("broken", "timezone"),
                                      ("correct", "none"), ("broken", "none")))
    report = parity.parity_report(served).orderBy("request_id").select(
        "parity.*", F.lit(3.0) + F.lit(2.5) * F.col("s_trip_distance_miles")).collect()
    assert [r.matched_count for r in report] == [8, 7, 9, 9]
    assert [r.mismatch_count for r in report] == [1, 2, 0, 0]
    assert [r.matched for r in report] == [False, False, True, True]
    assert all(r.total_features == 9 and len(r.comparisons) == 9 for r in report)
    assert report[0][-1] == 3.0 + 2.5 * 7.242048
    assert [c.feature for c in report[0].comparisons] == list(FEATURE_NAMES)


def test_unknown_modes_are_rejected(spark):
    served = serve_requests(_requests(spark, ("broken", "metric"), ("sometimes", "none")))
    reasons = [r.rejection_reasons for r in served.orderBy("request_id").collect()]
    assert reasons == [["skew_mode_unknown"], ["feature_mode_unknown"]]
    assert accepted(served).count() == 0


def test_vector_structs_are_nested_in_order(spark):
    nested = with_vector_structs(serve_requests(_requests(spark, ("broken", "none"))))
    assert nested.schema["training"].dataType.names == list(FEATURE_NAMES)


def test_rollup_is_independent_of_partitioning(spark):
    served = accepted(serve_requests(requests_from_trips(load_trips(spark, SF_SMALL))))
    a = parity.parity_rollup(served, ("feature_mode", "applied_skew_mode"))
    b = parity.parity_rollup(served.repartition(7), ("feature_mode", "applied_skew_mode"))
    key = ["feature_mode", "applied_skew_mode", "feature"]
    ra = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in a.select(*key, "mismatches", "rows", "max_absolute_difference").collect())
    rb = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in b.select(*key, "mismatches", "rows", "max_absolute_difference").collect())
    assert ra == rb


COLUMNS = "trip_id long, " + ", ".join(f"{n} {'double' if n == 'trip_distance_miles' else 'int'}" for n in FEATURE_NAMES)
BASE = (1.0, 1, 1, 1, 8, 0, 1, 0, 1)
WRONG = (3.5, 1, 1, 1, 9, 0, 1, 0, 1)


def test_every_served_row_is_compared(spark):
    offline = spark.createDataFrame([(1, *BASE), (2, *BASE), (2, *BASE), (5, *BASE)], COLUMNS)
    online = spark.createDataFrame([(1, *BASE), (1, *WRONG), (1, *WRONG), (3, *BASE), (5, *BASE), (None, *BASE)], COLUMNS)
    rows = {r.trip_id: r for r in parity.compare_tables(offline, online).collect()}
    one = rows[1]
    assert (one.offline_rows, one.online_rows, one.rows_compared, one.rows_mismatched, one.matched) == (1, 3, 3, 2, False)
    found = {f.feature: (f.mismatches, f.max_absolute_difference) for f in one.features}
    assert found["trip_distance_miles"] == (2, 2.5) and found["pickup_hour"] == (2, 1.0) and found["is_weekend"] == (0, 0.0)
    assert (rows[2].offline_rows, rows[2].missing_in, rows[2].matched, rows[2].features) == (2, "online", None, None)
    assert (rows[3].missing_in, rows[3].rows_compared, rows[None].missing_in) == ("offline", 0, "offline")
    assert rows[5].matched and rows[5].missing_in is None


def test_a_hot_key_costs_its_different_vectors_only(spark):
    offline = spark.createDataFrame([(4, *BASE)], COLUMNS)
    online = spark.range(20000).selectExpr("4L AS trip_id", "CASE WHEN id % 4 = 0 THEN 2D ELSE 1D END AS trip_distance_miles",
                                           *[f"{v} AS {n}" for n, v in list(zip(FEATURE_NAMES, BASE))[1:]])
    row = parity.compare_tables(offline, online).first()
    assert (row.online_rows, row.rows_mismatched) == (20000, 5000)


def test_duplicate_offline_rows_give_one_whole_row(spark):
    other = (9.0, 5, 7, 3, 2, 6, 1, 1, 0)
    offline = spark.createDataFrame([(4, *BASE), (4, *other)] * 3, COLUMNS)
    online = spark.createDataFrame([(4, *BASE)], COLUMNS)
    found = [parity.compare_tables(offline.repartition(n), online).first() for n in (3, 5)]
    assert found[0].offline_rows == 6 and found[0].rows_mismatched in (0, 1) and found[0] == found[1]
    assert {f.mismatches for f in found[0].features} <= ({0} if found[0].matched else {0, 1})


def test_joined_tables_are_dealt_by_their_rows(spark):
    """The tasks that join follow the rows of both tables; adaptive execution does not put them together again."""
    vectors = [F.col("trip_id").cast("double").alias(FEATURE_NAMES[0]), *[F.lit(1).alias(n) for n in FEATURE_NAMES[1:]]]
    offline = spark.range(0, 3000).select(F.col("id").alias("trip_id")).select("trip_id", *vectors)
    online = offline.where("trip_id % 3 > 0").unionByName(offline.where("trip_id % 3 = 1"))
    out = parity.compare_tables(offline, online, rows_a_task=300)
    assert parity.join_tasks(offline, online, 300) == 20
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 3000 and max(sizes) < 300
    found = {r["missing_in"]: r["n"] for r in out.groupBy("missing_in").agg(F.count("*").alias("n")).collect()}
    assert found == {None: 2000, "online": 1000} and out.where("missing_in is null and not matched").count() == 0
