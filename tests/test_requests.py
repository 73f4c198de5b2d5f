"""Wire JSON requests: offsets, lax integers, defaults, extras, rejection reasons."""

import json

from pyspark.sql import functions as F

from tripparity.operators.pairs import serve_requests
from tripparity.sources.requests import REQUEST_FIELDS, bare_trips, parse_json_requests, requests_from_trips
from tripparity.sources.trips import load_trips

from conftest import SF_SMALL

BASE = {"pickup_datetime": "2024-01-08T13:30:00Z", "pickup_location_id": 132, "dropoff_location_id": 236,
        "passenger_count": 2, "trip_distance_miles": 4.5}


def _serve(spark, *payloads):
    raw = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)], "id long, value string")
    parsed = parse_json_requests(raw, id_column="id")
    return {r.request_id: r for r in serve_requests(parsed).collect()}


def test_valid_request_gets_defaults_and_golden_features(spark):
    row = _serve(spark, BASE)[0]
    assert row.accepted and row.feature_mode == "broken" and row.skew_mode == "none"
    assert (row.t_pickup_hour, row.t_is_rush_hour) == (8, 1)


def test_offset_is_required_and_kept(spark):
    rows = _serve(spark, {**BASE, "pickup_datetime": "2024-01-08T13:30:00"},
                  {**BASE, "pickup_datetime": "2024-01-08T08:30:00-05:00"})
    assert not rows[0].accepted and "pickup_datetime_without_offset" in rows[0].rejection_reasons
    assert rows[1].accepted and rows[1].s_pickup_hour == 8


def test_lax_integers_and_rejections(spark):
    rows = _serve(spark, {**BASE, "passenger_count": "3"}, {**BASE, "passenger_count": 2.0},
                  {**BASE, "passenger_count": 2.5}, {**BASE, "passenger_count": None},
                  {**BASE, "skew_mode": "metric"}, {**BASE, "tip": 1},
                  {**BASE, "trip_distance_miles": 501}, {**BASE, "trip_distance_miles": 1e-7})
    assert rows[0].accepted and rows[0].s_passenger_count == 3
    assert rows[1].accepted
    assert not rows[2].accepted
    assert rows[3].accepted and rows[3].s_passenger_count == 1
    assert rows[4].rejection_reasons == ["skew_mode_unknown"]
    assert rows[5].rejection_reasons == ["unexpected_fields:tip"]
    assert rows[6].rejection_reasons == ["trip_distance_miles_out_of_range"]
    # passes the request contract, but rounds to 0 and fails the feature-vector contract
    assert rows[7].rejection_reasons == ["feature_trip_distance_miles_out_of_contract"]


def test_wire_json_round_trip_equals_the_typed_path(spark):
    from tripparity.sources.requests import requests_from_trips, requests_to_json
    from tripparity.sources.trips import load_trips

    typed = requests_from_trips(load_trips(spark, "/root/testdata/sf0.001"))
    wire = parse_json_requests(requests_to_json(typed), id_column="request_id")
    cols = ["request_id", "accepted", "s_trip_distance_miles", "s_pickup_hour", "s_passenger_count"]
    a = serve_requests(typed).select(*cols).where("accepted")
    b = serve_requests(wire).select(*cols).where("accepted")
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0


def test_bare_trips_have_no_modes(spark):
    trips = bare_trips(requests_from_trips(load_trips(spark, SF_SMALL)))
    assert trips.columns == ["request_id", *REQUEST_FIELDS[:5]] and trips.count() == load_trips(spark, SF_SMALL).count()


def test_the_distance_contract_reaches_the_scan(spark):
    from tripparity.plans import catalog

    plan = catalog.valid_raw(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(value,0.04), LessThanOrEqual(value,400.0)" in plan


TYPED = [  # field, JSON value, accepted value (None: rejected)
    ("pickup_location_id", "3", 3), ("pickup_location_id", '" 3 "', 3), ("pickup_location_id", '"3.0"', 3), ("pickup_location_id", "3e1", 30),
    ("pickup_location_id", '"3e1"', None), ("pickup_location_id", "3.5", None), ("pickup_location_id", "true", 1), ("pickup_location_id", "[3]", None),
    ("trip_distance_miles", '"1e1"', 10.0), ("trip_distance_miles", "true", 1.0), ("trip_distance_miles", '{"x":1}', None),
    ("pickup_datetime", '"2024-01-08T13:30Z"', 1704720600), ("pickup_datetime", '"2024-01-08 13:30+0100"', 1704717000),
    ("pickup_datetime", "1704719400", 1704719400), ("pickup_datetime", "1704719400000", 1704719400), ("pickup_datetime", '"1704719400"', 1704719400),
    ("pickup_datetime", "true", None), ("pickup_datetime", '"1e2"', None), ("pickup_datetime", "null", None), ("pickup_datetime", "9e300", None),
    ("feature_mode", "null", None), ("skew_mode", "null", None), ("passenger_count", "null", "missing"),
]


def test_types_of_wire_fields(spark):
    given = {"pickup_datetime": '"2024-01-08T13:30:00Z"', "pickup_location_id": "1", "dropoff_location_id": "2", "passenger_count": "1",
             "trip_distance_miles": "2.5"}
    rows = [(i, "{" + ",".join(f'"{k}":{v}' for k, v in (given | {field: value}).items()) + "}") for i, (field, value, _) in enumerate(TYPED)]
    found = {r["request_id"]: r for r in parse_json_requests(spark.createDataFrame(rows, "id int, value string"), id_column="id")
             .withColumn("pickup_datetime", F.unix_seconds("pickup_datetime")).collect()}
    for i, (field, value, want) in enumerate(TYPED):
        row = found[i]
        assert bool(row["parse_errors"]) == (want is None), (field, value, row)
        if want is not None:
            assert row[field] == (None if want == "missing" else want), (field, value)
    assert found[20]["parse_errors"] == ["feature_mode_null"] and found[21]["parse_errors"] == ["skew_mode_null"]
