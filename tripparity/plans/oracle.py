"""DuckDB SQL that recomputes each registered query independently, for the correctness gate.

Tables ``events`` etc. are views in the checking session. Wall-clock conversion uses
``(ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York'``; Monday = 0 is ``isodow - 1``.
"""

from __future__ import annotations

FEATURES = ("trip_distance_miles", "passenger_count", "pickup_location_id", "dropoff_location_id",
            "pickup_hour", "pickup_day_of_week", "pickup_month", "is_weekend", "is_rush_hour")

TRIPS = """
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
trips AS (
  SELECT event_id AS trip_id, ts AS pickup_datetime,
         CAST(user_id AS BIGINT) AS pickup_location_id,
         (event_id * 7919) % 263 AS dropoff_location_id,
         CASE WHEN k % 10 = 9 THEN NULL ELSE CAST(k % 10 AS DOUBLE) END AS passenger_count,
         CAST(value AS DOUBLE) / 4.0 AS trip_distance,
         CASE WHEN event_type = 'error' AND k < 10 THEN CAST(-5.0 AS DOUBLE)
              ELSE 3.0::DOUBLE + 2.5::DOUBLE * (CAST(value AS DOUBLE) / 4.0) + CAST(event_id % 7 AS DOUBLE) END
           AS fare_amount,
         event_type
  FROM ev),
raw AS (
  SELECT trip_id, pickup_datetime AS tpep_pickup_datetime,
         coalesce(passenger_count, 1.0::DOUBLE) AS passenger_count,
         trip_distance, CAST(pickup_location_id AS DOUBLE) AS PULocationID,
         CAST(dropoff_location_id AS DOUBLE) AS DOLocationID, fare_amount
  FROM trips),
valid AS (
  SELECT * FROM raw
  WHERE tpep_pickup_datetime IS NOT NULL
    AND passenger_count BETWEEN 1 AND 8 AND NOT isnan(passenger_count)
    AND trip_distance BETWEEN 0.01 AND 100 AND NOT isnan(trip_distance)
    AND PULocationID >= 1 AND NOT isnan(PULocationID)
    AND DOLocationID >= 1 AND NOT isnan(DOLocationID)
    AND fare_amount BETWEEN 0.01 AND 500 AND NOT isnan(fare_amount)),
training AS (
  SELECT trip_id,
         round(trip_distance, 6) AS trip_distance_miles,
         CAST(trunc(passenger_count) AS INTEGER) AS passenger_count,
         CAST(trunc(PULocationID) AS BIGINT) AS pickup_location_id,
         CAST(trunc(DOLocationID) AS BIGINT) AS dropoff_location_id,
         CAST(hour(tpep_pickup_datetime) AS INTEGER) AS pickup_hour,
         CAST(isodow(tpep_pickup_datetime) - 1 AS INTEGER) AS pickup_day_of_week,
         CAST(month(tpep_pickup_datetime) AS INTEGER) AS pickup_month,
         CASE WHEN isodow(tpep_pickup_datetime) - 1 >= 5 THEN 1 ELSE 0 END AS is_weekend,
         CASE WHEN (hour(tpep_pickup_datetime) >= 7 AND hour(tpep_pickup_datetime) < 10)
                OR (hour(tpep_pickup_datetime) >= 16 AND hour(tpep_pickup_datetime) < 19)
              THEN 1 ELSE 0 END AS is_rush_hour,
         fare_amount
  FROM valid)"""

REQUESTS = """
requests AS (
  SELECT trip_id AS request_id, pickup_datetime,
         CAST(pickup_location_id AS BIGINT) AS pickup_location_id,
         CAST(dropoff_location_id AS BIGINT) AS dropoff_location_id,
         CAST(passenger_count AS INTEGER) AS passenger_count,
         trip_distance AS trip_distance_miles,
         CASE WHEN trip_id % 4 = 0 THEN 'correct' ELSE 'broken' END AS feature_mode,
         CASE trip_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'distance_unit' ELSE 'timezone' END AS skew_mode,
         pickup_datetime AS served_at, event_type
  FROM trips),
req_checked AS (
  SELECT *, list_filter([
      CASE WHEN pickup_datetime IS NULL THEN 'pickup_datetime_missing' END,
      CASE WHEN NOT coalesce(pickup_location_id >= 1, false) THEN 'pickup_location_id_below_1' END,
      CASE WHEN NOT coalesce(dropoff_location_id >= 1, false) THEN 'dropoff_location_id_below_1' END,
      CASE WHEN passenger_count IS NOT NULL AND NOT (passenger_count BETWEEN 1 AND 8)
           THEN 'passenger_count_out_of_range' END,
      CASE WHEN NOT coalesce(trip_distance_miles > 0 AND trip_distance_miles <= 500, false)
           THEN 'trip_distance_miles_out_of_range' END
    ], lambda x: x IS NOT NULL) AS reasons
  FROM requests),
req_times AS (
  SELECT *, (pickup_datetime AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS ny,
         pickup_datetime AS utc
  FROM req_checked),
shared AS (
  SELECT request_id,
         round(trip_distance_miles, 6) AS trip_distance_miles,
         coalesce(passenger_count, 1) AS passenger_count,
         pickup_location_id, dropoff_location_id,
         CAST(hour(ny) AS INTEGER) AS pickup_hour,
         CAST(isodow(ny) - 1 AS INTEGER) AS pickup_day_of_week,
         CAST(month(ny) AS INTEGER) AS pickup_month,
         CASE WHEN isodow(ny) - 1 >= 5 THEN 1 ELSE 0 END AS is_weekend,
         CASE WHEN (hour(ny) >= 7 AND hour(ny) < 10) OR (hour(ny) >= 16 AND hour(ny) < 19)
              THEN 1 ELSE 0 END AS is_rush_hour
  FROM req_times),
utc_fields AS (
  SELECT request_id,
         CAST(hour(utc) AS INTEGER) AS pickup_hour,
         CAST(isodow(utc) - 1 AS INTEGER) AS pickup_day_of_week,
         CAST(month(utc) AS INTEGER) AS pickup_month,
         CASE WHEN isodow(utc) - 1 >= 5 THEN 1 ELSE 0 END AS is_weekend,
         CASE WHEN (hour(utc) >= 7 AND hour(utc) < 10) OR (hour(utc) >= 16 AND hour(utc) < 19)
              THEN 1 ELSE 0 END AS is_rush_hour
  FROM req_times),
pairs AS (
  SELECT r.request_id, r.feature_mode, r.skew_mode, r.served_at, r.event_type, r.reasons,
         CASE WHEN r.feature_mode = 'broken' THEN r.skew_mode ELSE 'none' END AS applied_skew_mode,
         s.trip_distance_miles AS t_trip_distance_miles, s.passenger_count AS t_passenger_count,
         s.pickup_location_id AS t_pickup_location_id, s.dropoff_location_id AS t_dropoff_location_id,
         s.pickup_hour AS t_pickup_hour, s.pickup_day_of_week AS t_pickup_day_of_week,
         s.pickup_month AS t_pickup_month, s.is_weekend AS t_is_weekend, s.is_rush_hour AS t_is_rush_hour,
         CASE WHEN r.feature_mode = 'broken' AND r.skew_mode = 'distance_unit'
              THEN round(s.trip_distance_miles * 1.609344, 6) ELSE s.trip_distance_miles END
           AS s_trip_distance_miles,
         s.passenger_count AS s_passenger_count,
         s.pickup_location_id AS s_pickup_location_id, s.dropoff_location_id AS s_dropoff_location_id,
         CASE WHEN r.feature_mode = 'broken' AND r.skew_mode = 'timezone' THEN u.pickup_hour
              ELSE s.pickup_hour END AS s_pickup_hour,
         CASE WHEN r.feature_mode = 'broken' AND r.skew_mode = 'timezone' THEN u.pickup_day_of_week
              ELSE s.pickup_day_of_week END AS s_pickup_day_of_week,
         CASE WHEN r.feature_mode = 'broken' AND r.skew_mode = 'timezone' THEN u.pickup_month
              ELSE s.pickup_month END AS s_pickup_month,
         CASE WHEN r.feature_mode = 'broken' AND r.skew_mode = 'timezone' THEN u.is_weekend
              ELSE s.is_weekend END AS s_is_weekend,
         CASE WHEN r.feature_mode = 'broken' AND r.skew_mode = 'timezone' THEN u.is_rush_hour
              ELSE s.is_rush_hour END AS s_is_rush_hour
  FROM req_times r JOIN shared s USING (request_id) JOIN utc_fields u USING (request_id)),
served AS (
  SELECT *, CASE WHEN len(reasons) = 0 THEN list_filter([
      CASE WHEN NOT (t_trip_distance_miles > 0) THEN 'feature_trip_distance_miles_out_of_contract' END,
      CASE WHEN NOT (s_trip_distance_miles > 0) AND (t_trip_distance_miles > 0)
           THEN 'feature_trip_distance_miles_out_of_contract' END
    ], lambda x: x IS NOT NULL) ELSE reasons END AS rejection_reasons
  FROM pairs),
accepted AS (SELECT * FROM served WHERE len(rejection_reasons) = 0),
comparisons AS (
  SELECT request_id, feature_mode, applied_skew_mode, c.feature, c.t AS training_value, c.s AS serving_value
  FROM (SELECT request_id, feature_mode, applied_skew_mode, unnest([
      {'feature': 'trip_distance_miles', 't': t_trip_distance_miles, 's': s_trip_distance_miles},
      {'feature': 'passenger_count', 't': CAST(t_passenger_count AS DOUBLE), 's': CAST(s_passenger_count AS DOUBLE)},
      {'feature': 'pickup_location_id', 't': CAST(t_pickup_location_id AS DOUBLE), 's': CAST(s_pickup_location_id AS DOUBLE)},
      {'feature': 'dropoff_location_id', 't': CAST(t_dropoff_location_id AS DOUBLE), 's': CAST(s_dropoff_location_id AS DOUBLE)},
      {'feature': 'pickup_hour', 't': CAST(t_pickup_hour AS DOUBLE), 's': CAST(s_pickup_hour AS DOUBLE)},
      {'feature': 'pickup_day_of_week', 't': CAST(t_pickup_day_of_week AS DOUBLE), 's': CAST(s_pickup_day_of_week AS DOUBLE)},
      {'feature': 'pickup_month', 't': CAST(t_pickup_month AS DOUBLE), 's': CAST(s_pickup_month AS DOUBLE)},
      {'feature': 'is_weekend', 't': CAST(t_is_weekend AS DOUBLE), 's': CAST(s_is_weekend AS DOUBLE)},
      {'feature': 'is_rush_hour', 't': CAST(t_is_rush_hour AS DOUBLE), 's': CAST(s_is_rush_hour AS DOUBLE)}
    ]) AS c FROM accepted)),
compared AS (
  SELECT *, (training_value = serving_value OR abs(training_value - serving_value)
               <= greatest(1e-9 * greatest(abs(training_value), abs(serving_value)), 1e-9)) AS matched,
         abs(training_value - serving_value) AS absolute_difference,
         abs(training_value - serving_value) / greatest(abs(training_value), 1e-12) AS relative_difference
  FROM comparisons)"""


def with_ctes(*parts: str, body: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + body


def _feature_list(prefix: str = "") -> str:
    return ", ".join(f"{prefix}{name}" for name in FEATURES)


def _fault_sql(mode: str) -> str:
    if mode == "distance_unit":
        cols = ("round(s.trip_distance_miles * 1.609344, 6) AS trip_distance_miles, s.passenger_count, "
                "s.pickup_location_id, s.dropoff_location_id, s.pickup_hour, s.pickup_day_of_week, "
                "s.pickup_month, s.is_weekend, s.is_rush_hour")
    else:
        cols = ("s.trip_distance_miles, s.passenger_count, s.pickup_location_id, s.dropoff_location_id, "
                "u.pickup_hour, u.pickup_day_of_week, u.pickup_month, u.is_weekend, u.is_rush_hour")
    return with_ctes(TRIPS, REQUESTS, body=f"""
SELECT a.request_id, {cols}
FROM accepted a JOIN shared s USING (request_id) JOIN utc_fields u USING (request_id)""")


ONLINE = """
online AS (SELECT request_id AS trip_id, s_trip_distance_miles AS trip_distance_miles,
                  s_passenger_count AS passenger_count, s_pickup_location_id AS pickup_location_id,
                  s_dropoff_location_id AS dropoff_location_id, s_pickup_hour AS pickup_hour,
                  s_pickup_day_of_week AS pickup_day_of_week, s_pickup_month AS pickup_month,
                  s_is_weekend AS is_weekend, s_is_rush_hour AS is_rush_hour FROM accepted)"""


def _duplicates_sql() -> str:
    equal = {n: f"t.{n} = s.{n}" for n in FEATURES}
    d = "trip_distance_miles"
    equal[d] = f"(t.{d} = s.{d} OR abs(t.{d} - s.{d}) <= greatest(1e-9 * greatest(abs(t.{d}), abs(s.{d})), 1e-9))"
    wrong = ", ".join(f"NOT {e} AS w_{n}" for n, e in equal.items())
    names = ", ".join(f"CASE WHEN bool_or(w_{n}) THEN '{n}' END" for n in FEATURES)
    return f"""
, many AS (
  SELECT trip_id, {_feature_list()} FROM online
  UNION ALL
  SELECT trip_id, {d} + CASE WHEN trip_id % 6 = 0 THEN 1.0::DOUBLE ELSE 0 END, {_feature_list().split(", ", 1)[1]}
  FROM online WHERE trip_id % 3 = 0
  UNION ALL
  SELECT 3, {_feature_list()} FROM online WHERE trip_id % 10 = 0),
pairs_ AS (SELECT s.trip_id, t.trip_id IS NOT NULL AS known, abs(t.{d} - s.{d}) AS diff, {wrong}
           FROM many s LEFT JOIN training t ON t.trip_id = s.trip_id)
SELECT trip_id, CAST(CASE WHEN known THEN 1 ELSE 0 END AS BIGINT) AS offline_rows, count(*) AS online_rows,
       CASE WHEN NOT known THEN 'offline' END AS missing_in,
       CASE WHEN known THEN count(*) ELSE 0 END AS rows_compared,
       CASE WHEN known THEN count_if({" OR ".join(f"w_{n}" for n in FEATURES)}) ELSE 0 END AS rows_mismatched,
       CASE WHEN known THEN count_if({" OR ".join(f"w_{n}" for n in FEATURES)}) = 0 END AS matched,
       CASE WHEN known THEN array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), ',') ELSE '' END
         AS mismatched_features,
       round(max(diff), 6) AS max_distance_difference
FROM pairs_ GROUP BY trip_id, known
UNION ALL
SELECT trip_id, 1, 0, 'online', 0, 0, NULL, '', NULL FROM training WHERE trip_id NOT IN (SELECT trip_id FROM many)"""


# One kind of damage per remainder of the id; zone 0 of an event stays a zone problem besides.
DAMAGED_JSON = """
, w AS (SELECT request_id, request_id % 23 AS w, pickup_location_id AS z,
               CASE WHEN request_id % 23 = 4 THEN pickup_datetime - INTERVAL 330 MINUTE ELSE pickup_datetime END AS utc
        FROM requests),
r AS (SELECT *, list_filter(CASE WHEN w = 15 THEN
        ['malformed_json', 'pickup_datetime_missing', 'pickup_location_id_not_integer', 'dropoff_location_id_not_integer',
         'trip_distance_miles_not_number', 'pickup_datetime_missing', 'pickup_location_id_below_1',
         'dropoff_location_id_below_1', 'trip_distance_miles_out_of_range'] ELSE [
        CASE WHEN w IN (0, 1, 2) THEN 'pickup_datetime_without_offset' END,
        CASE WHEN w = 3 THEN 'pickup_datetime_invalid' END,
        CASE WHEN w IN (6, 7, 20) THEN 'pickup_location_id_not_integer' END,
        CASE WHEN w IN (9, 10) THEN 'trip_distance_miles_not_number' END,
        CASE WHEN w = 16 THEN 'feature_mode_null' END,
        CASE WHEN w = 17 THEN 'skew_mode_null' END,
        CASE WHEN w <= 3 THEN 'pickup_datetime_missing' END,
        CASE WHEN w IN (6, 7, 8, 20) OR (w NOT IN (5, 21) AND z < 1) THEN 'pickup_location_id_below_1' END,
        CASE WHEN w IN (9, 10, 11) THEN 'trip_distance_miles_out_of_range' END,
        CASE WHEN w = 13 THEN 'feature_mode_unknown' END,
        CASE WHEN w = 14 THEN 'skew_mode_unknown' END] END, lambda x: x IS NOT NULL) AS reasons FROM w)
SELECT request_id, len(reasons) = 0 AS accepted, array_to_string(reasons, ',') AS reasons,
       CASE WHEN len(reasons) = 0
            THEN CAST(hour(date_trunc('second', utc) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') AS INTEGER) END AS pickup_hour,
       CASE WHEN len(reasons) = 0 THEN CASE w WHEN 5 THEN 3000000000 WHEN 21 THEN 100 ELSE z END END AS pickup_location_id
FROM r"""

DAMAGED_TEXT = """
, w AS (SELECT trip_id, trip_id % 8 AS w, pickup_datetime AS ts FROM trips WHERE pickup_datetime IS NOT NULL),
l AS (SELECT trip_id, w, CASE w WHEN 0 THEN ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York'
                              WHEN 1 THEN (ts - INTERVAL 330 MINUTE) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York'
                              ELSE ts END AS local
      FROM w WHERE w IN (0, 1, 3, 7))
SELECT trip_id, 4.5::DOUBLE AS trip_distance_miles, CAST(CASE WHEN w = 3 THEN 10000000000 ELSE 12 END AS BIGINT) AS pickup_location_id,
       CAST(hour(local) AS INTEGER) AS pickup_hour, CAST(isodow(local) - 1 AS INTEGER) AS pickup_day_of_week,
       20.0::DOUBLE AS fare_amount
FROM l"""


RAW_ROWS = """
SELECT pickup_datetime AS tpep_pickup_datetime, passenger_count, trip_distance, CAST(pickup_location_id AS DOUBLE) AS PULocationID,
       CAST(dropoff_location_id AS DOUBLE) AS DOLocationID, fare_amount
FROM trips"""


def base_sql() -> dict[str, str]:
    return {
        "trips_raw_scan": with_ctes(TRIPS, body=RAW_ROWS),
        "trips_first_rows": with_ctes(TRIPS, body=RAW_ROWS + " ORDER BY trip_id LIMIT 2500"),
        "trips_valid": with_ctes(TRIPS, body="SELECT * FROM valid"),
        "trips_violations": with_ctes(TRIPS, body="""
SELECT trip_id, v.column AS "column", v."check" AS "check", v.failure_value
FROM (SELECT trip_id, unnest(list_filter([
    CASE WHEN tpep_pickup_datetime IS NULL THEN {'column': 'tpep_pickup_datetime', 'check': 'not_null', 'failure_value': NULL::DOUBLE} END,
    CASE WHEN NOT coalesce(passenger_count BETWEEN 1 AND 8, false) THEN {'column': 'passenger_count', 'check': 'in_range(1.0, 8.0)', 'failure_value': passenger_count} END,
    CASE WHEN NOT coalesce(trip_distance BETWEEN 0.01 AND 100, false) THEN {'column': 'trip_distance', 'check': 'in_range(0.01, 100.0)', 'failure_value': trip_distance} END,
    CASE WHEN NOT coalesce(PULocationID >= 1, false) THEN {'column': 'PULocationID', 'check': 'greater_than_or_equal_to(1.0)', 'failure_value': PULocationID} END,
    CASE WHEN NOT coalesce(DOLocationID >= 1, false) THEN {'column': 'DOLocationID', 'check': 'greater_than_or_equal_to(1.0)', 'failure_value': DOLocationID} END,
    CASE WHEN NOT coalesce(fare_amount BETWEEN 0.01 AND 500, false) THEN {'column': 'fare_amount', 'check': 'in_range(0.01, 500.0)', 'failure_value': fare_amount} END
  ], lambda x: x IS NOT NULL)) AS v FROM raw)"""),
        "trips_violation_counts": with_ctes(TRIPS, body="""
, agg AS (
  SELECT count_if(tpep_pickup_datetime IS NULL) AS c0,
         count_if(NOT coalesce(passenger_count BETWEEN 1 AND 8, false)) AS c1,
         count_if(NOT coalesce(trip_distance BETWEEN 0.01 AND 100, false)) AS c2,
         count_if(NOT coalesce(PULocationID >= 1, false)) AS c3,
         count_if(NOT coalesce(DOLocationID >= 1, false)) AS c4,
         count_if(NOT coalesce(fare_amount BETWEEN 0.01 AND 500, false)) AS c5,
         count(*) AS rows, (SELECT count(*) FROM valid) AS valid
  FROM raw)
SELECT c.column AS "column", c."check" AS "check", c.failing_rows, rows, valid
FROM (SELECT rows, valid, unnest([
    {'column': 'tpep_pickup_datetime', 'check': 'not_null', 'failing_rows': c0},
    {'column': 'passenger_count', 'check': 'in_range(1.0, 8.0)', 'failing_rows': c1},
    {'column': 'trip_distance', 'check': 'in_range(0.01, 100.0)', 'failing_rows': c2},
    {'column': 'PULocationID', 'check': 'greater_than_or_equal_to(1.0)', 'failing_rows': c3},
    {'column': 'DOLocationID', 'check': 'greater_than_or_equal_to(1.0)', 'failing_rows': c4},
    {'column': 'fare_amount', 'check': 'in_range(0.01, 500.0)', 'failing_rows': c5}
  ]) AS c FROM agg)"""),
        "requests_rejected": with_ctes(TRIPS, REQUESTS, body="""
SELECT request_id, unnest(rejection_reasons) AS reason FROM served WHERE len(rejection_reasons) > 0"""),
        "requests_from_json": with_ctes(TRIPS, REQUESTS, body="""
SELECT request_id, len(rejection_reasons) = 0 AS accepted,
       CASE WHEN len(rejection_reasons) = 0 THEN applied_skew_mode END AS applied_skew_mode,
       CASE WHEN len(rejection_reasons) = 0 THEN s_trip_distance_miles END AS trip_distance_miles,
       CASE WHEN len(rejection_reasons) = 0 THEN s_passenger_count END AS passenger_count,
       CASE WHEN len(rejection_reasons) = 0 THEN s_pickup_hour END AS pickup_hour,
       CASE WHEN len(rejection_reasons) = 0 THEN s_pickup_day_of_week END AS pickup_day_of_week
FROM served"""),
        "features_training": with_ctes(TRIPS, body="SELECT * FROM training"),
        "features_serving": with_ctes(TRIPS, REQUESTS, body=f"""
SELECT s.request_id, {_feature_list('s.')} FROM accepted a JOIN shared s USING (request_id)"""),
        "features_fault_distance": _fault_sql("distance_unit"),
        "features_fault_timezone": _fault_sql("timezone"),
        "features_mixed_modes": with_ctes(TRIPS, REQUESTS, body=f"""
SELECT request_id, feature_mode, skew_mode, applied_skew_mode, {_feature_list('t_')}, {_feature_list('s_')}
FROM accepted"""),
        "parity_mismatches": with_ctes(TRIPS, REQUESTS, body="""
SELECT request_id, feature, training_value, serving_value, absolute_difference, relative_difference
FROM compared WHERE NOT matched"""),
        "parity_comparisons": with_ctes(TRIPS, REQUESTS, body="""
SELECT request_id, feature, training_value, serving_value, matched, absolute_difference FROM compared"""),
        "parity_report_counts": with_ctes(TRIPS, REQUESTS, body="""
SELECT feature_mode, applied_skew_mode, (mismatch_count = 0) AS matched,
       CAST(9 - mismatch_count AS INTEGER) AS matched_count, CAST(mismatch_count AS INTEGER) AS mismatch_count,
       count(*) AS trips
FROM (SELECT request_id, feature_mode, applied_skew_mode, count_if(NOT matched) AS mismatch_count
      FROM compared GROUP BY ALL)
GROUP BY ALL"""),
        "parity_rollup": with_ctes(TRIPS, REQUESTS, body="""
SELECT feature_mode, applied_skew_mode, feature, count(*) AS rows, count_if(NOT matched) AS mismatches,
       round(count_if(NOT matched) / count(*), 9) AS mismatch_rate,
       round(max(absolute_difference), 6) AS max_absolute_difference,
       round(avg(absolute_difference), 6) AS mean_absolute_difference
FROM compared GROUP BY ALL"""),
        "parity_tables_duplicates": with_ctes(TRIPS, REQUESTS, ONLINE, body=_duplicates_sql()),
        "requests_damaged_json": with_ctes(TRIPS, REQUESTS, body=DAMAGED_JSON),
        "trips_damaged_text": with_ctes(TRIPS, body=DAMAGED_TEXT),
        "parity_tables_joined": with_ctes(TRIPS, REQUESTS, ONLINE, body="""
, j AS (SELECT coalesce(o.trip_id, n.trip_id) AS trip_id,
             CASE WHEN o.trip_id IS NULL THEN 0 ELSE 1 END AS offline_rows,
             CASE WHEN n.trip_id IS NULL THEN 0 ELSE 1 END AS online_rows,
             o.trip_distance_miles AS t0, n.trip_distance_miles AS s0,
             o.passenger_count AS t1, n.passenger_count AS s1,
             o.pickup_location_id AS t2, n.pickup_location_id AS s2,
             o.dropoff_location_id AS t3, n.dropoff_location_id AS s3,
             o.pickup_hour AS t4, n.pickup_hour AS s4,
             o.pickup_day_of_week AS t5, n.pickup_day_of_week AS s5,
             o.pickup_month AS t6, n.pickup_month AS s6,
             o.is_weekend AS t7, n.is_weekend AS s7,
             o.is_rush_hour AS t8, n.is_rush_hour AS s8
      FROM training o FULL OUTER JOIN online n ON o.trip_id = n.trip_id),
m AS (SELECT *, list_filter([
        CASE WHEN NOT (t0 = s0 OR abs(t0 - s0) <= greatest(1e-9 * greatest(abs(t0), abs(s0)), 1e-9)) THEN 'trip_distance_miles' END,
        CASE WHEN t1 <> s1 THEN 'passenger_count' END,
        CASE WHEN t2 <> s2 THEN 'pickup_location_id' END,
        CASE WHEN t3 <> s3 THEN 'dropoff_location_id' END,
        CASE WHEN t4 <> s4 THEN 'pickup_hour' END,
        CASE WHEN t5 <> s5 THEN 'pickup_day_of_week' END,
        CASE WHEN t6 <> s6 THEN 'pickup_month' END,
        CASE WHEN t7 <> s7 THEN 'is_weekend' END,
        CASE WHEN t8 <> s8 THEN 'is_rush_hour' END], lambda x: x IS NOT NULL) AS mism
      FROM j)
SELECT trip_id, CAST(offline_rows AS BIGINT) AS offline_rows, CAST(online_rows AS BIGINT) AS online_rows,
       CASE WHEN offline_rows = 0 THEN 'offline' WHEN online_rows = 0 THEN 'online' END AS missing_in,
       CASE WHEN offline_rows = 1 AND online_rows = 1 THEN CAST(9 - len(mism) AS INTEGER) END AS matched_count,
       CASE WHEN offline_rows = 1 AND online_rows = 1 THEN array_to_string(mism, ',') END AS mismatched_features
FROM m"""),
    }


# ----------------------------------------------------------------------------- drift

def _double_features(prefix: str = "") -> str:
    return ", ".join(f"CAST({prefix}{n} AS DOUBLE) AS {n}" for n in FEATURES)


_UNPIVOT_ON = ", ".join(FEATURES)

REFERENCE = f"""
tl AS (UNPIVOT (SELECT trip_id, {_double_features()} FROM training)
       ON {_UNPIVOT_ON} INTO NAME feature VALUE value),
rq AS (SELECT feature, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS mn, max(value) AS mx,
              quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS qs
       FROM tl GROUP BY feature),
ru AS (SELECT *, list_sort(list_distinct(list_transform(qs, lambda q: round(q, 9)))) AS u FROM rq),
redges AS (SELECT feature, mean, std, mn, mx,
                  CASE WHEN len(u) < 2 THEN ['-inf'::DOUBLE, 'inf'::DOUBLE]
                       ELSE list_concat(['-inf'::DOUBLE], u[2:len(u) - 1], ['inf'::DOUBLE]) END AS edges
           FROM ru),
rbins AS (SELECT feature, unnest(range(0, len(edges) - 1)) AS bin FROM redges),
rcounts AS (SELECT t.feature, len(list_filter(r.edges[2:len(r.edges) - 1], lambda e: t.value >= e)) AS bin,
                   count(*) AS c
            FROM tl t JOIN redges r USING (feature) GROUP BY ALL),
rtot AS (SELECT feature, count(*) AS n FROM tl GROUP BY feature),
rprops AS (SELECT b.feature, b.bin, coalesce(c.c, 0) / t.n AS proportion
           FROM rbins b JOIN rtot t USING (feature)
           LEFT JOIN rcounts c ON c.feature = b.feature AND c.bin = b.bin)"""

SERVED_LOG = f"""
slog AS (SELECT request_id, served_at, event_type, {", ".join(f"s_{n} AS {n}" for n in FEATURES)}
         FROM accepted)"""


def _psi_sql(sample_cte: str, group: str | None = None, distance_factor: str | None = None) -> str:
    """PSI per (group,) feature of ``sample`` against the reference CTEs."""
    g = f"{group}, " if group else ""
    gsel = f"s.{group}, " if group else ""
    gjoin = f" AND c.{group} = t.{group}" if group else ""
    dist = f"trip_distance_miles * {distance_factor} AS trip_distance_miles" if distance_factor else None
    cols = ", ".join((dist if (n == "trip_distance_miles" and dist) else f"CAST({n} AS DOUBLE) AS {n}")
                     for n in FEATURES)
    return f"""
, sample AS ({sample_cte}),
sl AS (UNPIVOT (SELECT request_id, {g}{cols} FROM sample) ON {_UNPIVOT_ON} INTO NAME feature VALUE value),
scounts AS (SELECT {gsel}s.feature, len(list_filter(r.edges[2:len(r.edges) - 1], lambda e: s.value >= e)) AS bin,
                   count(*) AS c
            FROM sl s JOIN redges r USING (feature) GROUP BY ALL),
stot AS (SELECT {g}count(*) AS n FROM sample {"GROUP BY " + group if group else ""}),
smeans AS (SELECT {g}feature, avg(value) AS current_mean FROM sl GROUP BY ALL),
psi AS (SELECT {"t." + group + ", " if group else ""}p.feature,
               sum((greatest(coalesce(c.c, 0) / t.n, 1e-6) - greatest(p.proportion, 1e-6))
                   * ln(greatest(coalesce(c.c, 0) / t.n, 1e-6) / greatest(p.proportion, 1e-6))) AS psi
        FROM rprops p CROSS JOIN stot t
        LEFT JOIN scounts c ON c.feature = p.feature AND c.bin = p.bin{gjoin}
        WHERE t.n >= 30
        GROUP BY ALL)
SELECT {"p." + group + ", " if group else ""}p.feature, round(p.psi, 6) AS psi,
       CASE WHEN p.psi >= 0.25 THEN 'significant' WHEN p.psi >= 0.1 THEN 'moderate' ELSE 'stable' END AS status,
       round(r.mean, 6) AS reference_mean, round(m.current_mean, 6) AS current_mean
FROM psi p JOIN redges r USING (feature)
JOIN smeans m ON m.feature = p.feature {"AND m." + group + " = p." + group if group else ""}"""


LAST_500 = "SELECT * FROM slog ORDER BY served_at DESC, request_id DESC LIMIT 500"
LAST_500_PER_TYPE = ("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type "
                     "ORDER BY served_at DESC, request_id DESC) AS rn FROM slog) WHERE rn <= 500")


def _history_sql() -> str:
    """PSI of a frame of 500 rows at every served row: one count per bin, feature by feature."""
    return f"""
, sl AS (UNPIVOT (SELECT request_id, served_at, {_double_features()} FROM slog)
         ON {_UNPIVOT_ON} INTO NAME feature VALUE value),
sb AS (SELECT s.request_id, s.served_at, s.feature,
              len(list_filter(r.edges[2:len(r.edges) - 1], lambda e: s.value >= e)) AS bin
       FROM sl s JOIN redges r USING (feature)),
counted AS (SELECT s.request_id, s.feature, p.proportion, count(*) OVER w AS n, count_if(s.bin = p.bin) OVER w AS c
            FROM sb s JOIN rprops p USING (feature)
            WINDOW w AS (PARTITION BY s.feature, p.bin ORDER BY s.served_at, s.request_id ROWS 499 PRECEDING)),
psi AS (SELECT request_id, feature, n,
               sum((greatest(c / n, 1e-6) - greatest(proportion, 1e-6)) * ln(greatest(c / n, 1e-6) / greatest(proportion, 1e-6))) AS psi
        FROM counted GROUP BY ALL)
SELECT request_id, n AS sample_count,
       CASE WHEN n < 30 THEN 'insufficient_data' WHEN max(psi) >= 0.25 THEN 'significant'
            WHEN max(psi) >= 0.1 THEN 'moderate' ELSE 'stable' END AS status,
       CASE WHEN n >= 30 THEN round(max(psi) FILTER (feature = 'trip_distance_miles'), 6) END AS distance_psi,
       CASE WHEN n >= 30 THEN round(max(psi) FILTER (feature = 'pickup_hour'), 6) END AS hour_psi
FROM psi GROUP BY request_id, n"""


def drift_sql() -> dict[str, str]:
    base = (TRIPS, REQUESTS, REFERENCE, SERVED_LOG)
    overall = f"""
, sample AS ({LAST_500}),
psi AS (SELECT p.feature,
               sum((greatest(coalesce(c.c, 0) / t.n, 1e-6) - greatest(p.proportion, 1e-6))
                   * ln(greatest(coalesce(c.c, 0) / t.n, 1e-6) / greatest(p.proportion, 1e-6))) AS psi
        FROM rprops p CROSS JOIN (SELECT count(*) AS n FROM sample) t
        LEFT JOIN (SELECT s.feature, len(list_filter(r.edges[2:len(r.edges) - 1], lambda e: s.value >= e)) AS bin,
                          count(*) AS c
                   FROM (UNPIVOT (SELECT request_id, {_double_features()} FROM sample)
                         ON {_UNPIVOT_ON} INTO NAME feature VALUE value) s
                   JOIN redges r USING (feature) GROUP BY ALL) c
          ON c.feature = p.feature AND c.bin = p.bin
        GROUP BY ALL)
SELECT CASE WHEN (SELECT count(*) FROM sample) < 30 THEN 'insufficient_data'
            WHEN max(psi) >= 0.25 THEN 'significant' WHEN max(psi) >= 0.1 THEN 'moderate' ELSE 'stable' END
         AS status,
       (SELECT count(*) FROM sample) AS sample_count, true AS reference_available
FROM psi"""
    return {
        "ref_stats_moments": with_ctes(*base, body="""
SELECT feature, round(mean, 6) AS mean, round(std, 6) AS std, mn AS "min", mx AS "max" FROM redges"""),
        "ref_stats_edges": with_ctes(*base, body="""
SELECT feature, CAST(i - 1 AS INTEGER) AS edge_index, edges[i] AS edge
FROM (SELECT feature, edges, unnest(range(1, len(edges) + 1)) AS i FROM redges)"""),
        "ref_stats_proportions": with_ctes(*base, body="""
SELECT feature, CAST(bin AS INTEGER) AS bin_index, round(proportion, 9) AS proportion FROM rprops"""),
        "drift_last_500": with_ctes(*base, body=f"""
SELECT request_id, served_at, {", ".join(FEATURES)} FROM ({LAST_500})"""),
        "drift_report_features": with_ctes(*base, body=_psi_sql(LAST_500)),
        "drift_report_overall": with_ctes(*base, body=overall),
        "drift_insufficient": with_ctes(*base, body="""
SELECT 'insufficient_data' AS status, count(*) AS sample_count, true AS reference_available
FROM (SELECT * FROM slog ORDER BY served_at DESC, request_id DESC LIMIT 29)"""),
        "drift_unavailable": with_ctes(*base, body=f"""
SELECT 'unavailable' AS status, count(*) AS sample_count, false AS reference_available FROM ({LAST_500})"""),
        "drift_by_group": with_ctes(*base, body=_psi_sql(LAST_500_PER_TYPE, group="event_type")),
        "drift_shifted": with_ctes(*base, body=_psi_sql(LAST_500, distance_factor="1.609344")),
        "drift_history": with_ctes(*base, body=_history_sql()),
    }


def model_sql() -> dict[str, str]:
    base = (TRIPS, REQUESTS)
    split = "('0x' || substr(md5(CAST(trip_id AS VARCHAR)), 1, 8))::BIGINT % 5 = 0"
    zero_feats = [n for n in FEATURES if n != "trip_distance_miles"]
    contrib_rows = ",\n      ".join(
        ["{'feature': 'trip_distance_miles', 'value': s_trip_distance_miles, "
         "'shap_value': 2.5 * (s_trip_distance_miles - m.mean_distance)}"]
        + [f"{{'feature': '{n}', 'value': CAST(s_{n} AS DOUBLE), 'shap_value': 0.0::DOUBLE}}" for n in zero_feats])
    explained = f"""
, m AS (SELECT avg(trip_distance_miles) AS mean_distance FROM training),
ex AS (SELECT a.request_id, 3.0 + 2.5 * m.mean_distance AS base_value,
              3.0 + 2.5 * m.mean_distance + 2.5 * (a.s_trip_distance_miles - m.mean_distance) AS predicted_fare_amount,
              unnest([{contrib_rows}]) AS c
       FROM accepted a CROSS JOIN m)"""
    return {
        "split_exact": with_ctes(*base, body="""
SELECT trip_id, row_number() OVER (ORDER BY substr(md5(CAST(trip_id AS VARCHAR)), 1, 15))
                  <= (SELECT (count(*) + 4) // 5 FROM training) AS is_validation
FROM training"""),
        "split_assignment": with_ctes(*base, body=f"SELECT trip_id, ({split}) AS is_validation FROM training"),
        "score_linear": with_ctes(*base, body="""
SELECT request_id, 3.0 + 2.5 * s_trip_distance_miles AS predicted_fare_amount FROM accepted"""),
        "metrics_linear": with_ctes(*base, body=f"""
, v AS (SELECT fare_amount, fare_amount - (3.0 + 2.5 * trip_distance_miles) AS e FROM training WHERE {split})
SELECT count(*) AS rows, round(avg(abs(e)), 6) AS mean_absolute_error,
       round(sqrt(avg(e * e)), 6) AS root_mean_squared_error,
       round(1 - sum(e * e) / (var_pop(fare_amount) * count(*)), 6) AS r2_score
FROM v"""),
        "metrics_by_skew": with_ctes(*base, body="""
, v AS (SELECT a.feature_mode, a.applied_skew_mode, t.fare_amount,
               t.fare_amount - (3.0 + 2.5 * a.s_trip_distance_miles) AS e
        FROM accepted a JOIN training t ON a.request_id = t.trip_id)
SELECT feature_mode, applied_skew_mode, count(*) AS rows, round(avg(abs(e)), 6) AS mean_absolute_error,
       round(sqrt(avg(e * e)), 6) AS root_mean_squared_error,
       round(1 - sum(e * e) / (var_pop(fare_amount) * count(*)), 6) AS r2_score
FROM v GROUP BY ALL"""),
        "linear_contributions": with_ctes(*base, body=explained + """
SELECT request_id, c.feature AS feature, c.value AS value, round(c.shap_value, 9) AS shap_value,
       round(base_value, 9) AS base_value, round(predicted_fare_amount, 9) AS predicted_fare_amount
FROM ex"""),
        "linear_importance": with_ctes(*base, body=explained + """
SELECT c.feature AS feature, count(*) AS rows, round(avg(abs(c.shap_value)), 6) AS importance
FROM ex GROUP BY ALL"""),
    }


def _windows_sql(unit: str, tail: str) -> str:
    return with_ctes(TRIPS, REQUESTS, REFERENCE, SERVED_LOG, body=f"""
, sl AS (UNPIVOT (SELECT request_id, date_trunc('{unit}', served_at) AS window_start, {_double_features()} FROM slog)
         ON {_UNPIVOT_ON} INTO NAME feature VALUE value),
scounts AS (SELECT s.window_start, s.feature,
                   len(list_filter(r.edges[2:len(r.edges) - 1], lambda e: s.value >= e)) AS bin, count(*) AS c
            FROM sl s JOIN redges r USING (feature) GROUP BY ALL),
stot AS (SELECT date_trunc('{unit}', served_at) AS window_start, count(*) AS n FROM slog GROUP BY ALL),
smeans AS (SELECT window_start, feature, avg(value) AS current_mean FROM sl GROUP BY ALL),
psi AS (SELECT t.window_start, t.n, p.feature,
               sum((greatest(coalesce(c.c, 0) / t.n, 1e-6) - greatest(p.proportion, 1e-6))
                   * ln(greatest(coalesce(c.c, 0) / t.n, 1e-6) / greatest(p.proportion, 1e-6))) AS psi
        FROM rprops p CROSS JOIN stot t
        LEFT JOIN scounts c ON c.feature = p.feature AND c.bin = p.bin AND c.window_start = t.window_start
        GROUP BY ALL)
{tail}""")


WINDOW_FEATURES = """SELECT p.window_start, p.n AS sample_count, p.feature, round(p.psi, 6) AS psi,
       CASE WHEN p.psi >= 0.25 THEN 'significant' WHEN p.psi >= 0.1 THEN 'moderate' ELSE 'stable' END AS status,
       round(m.current_mean, 6) AS current_mean
FROM psi p JOIN smeans m USING (window_start, feature)
WHERE p.n >= 30"""

WINDOW_STATUS = """SELECT p.window_start, p.n AS sample_count,
       CASE WHEN p.n < 30 THEN 'insufficient_data' WHEN max(p.psi) >= 0.25 THEN 'significant'
            WHEN max(p.psi) >= 0.1 THEN 'moderate' ELSE 'stable' END AS status
FROM psi p GROUP BY p.window_start, p.n"""


def _boosted_sql(rounds: int, leaves: int, rate: float, least_rows: int, bins: int) -> str:
    """Best-first L1 boosting, one split a step: every step takes the leaf, feature and bin of greatest gain."""
    middle = "min(x) FILTER (rn IN ((n - 1) // 2, n // 2)) / 2 + max(x) FILTER (rn IN ((n - 1) // 2, n // 2)) / 2"
    features = ", ".join(f"CAST({n} AS DOUBLE) AS f{i}" for i, n in enumerate(FEATURES))
    out = f"""
, long AS MATERIALIZED (UNPIVOT (SELECT trip_id, {features} FROM training) ON {", ".join(f"f{i}" for i in range(len(FEATURES)))} INTO NAME f VALUE x),
ranked AS (SELECT f, x, row_number() OVER (PARTITION BY f ORDER BY x) - 1 AS rn, count(*) OVER (PARTITION BY f) AS n FROM long),
edges AS MATERIALIZED (SELECT DISTINCT f, x AS edge FROM ranked JOIN range(1, {bins}) AS cut(i) ON rn = i * n // {bins}),
bins AS MATERIALIZED (SELECT trip_id, f, b FROM long JOIN (
  SELECT v.f, v.x, count(e.edge) AS b FROM (SELECT DISTINCT f, x FROM long) v LEFT JOIN edges e ON e.f = v.f AND e.edge < v.x GROUP BY ALL) USING (f, x)),
score0 AS MATERIALIZED (SELECT trip_id, fare_amount AS y, (SELECT {middle} FROM (
  SELECT fare_amount AS x, row_number() OVER (ORDER BY fare_amount) - 1 AS rn, count(*) OVER () AS n FROM training)) AS score FROM training)"""
    for r in range(rounds):
        out += f"""
, grad{r} AS MATERIALIZED (SELECT trip_id, y, score, y - score AS rest, -sign(y - score) AS g FROM score{r}),
leaf{r}_0 AS (SELECT trip_id, '' AS path FROM grad{r})"""
        for k in range(leaves - 1):
            out += f"""
, sums{r}_{k} AS (SELECT path, f, b, CAST(count(*) AS DOUBLE) AS n, CAST(sum(g) AS DOUBLE) AS s
  FROM bins JOIN leaf{r}_{k} USING (trip_id) JOIN grad{r} USING (trip_id) GROUP BY ALL),
side{r}_{k} AS (SELECT path, f, b, sum(n) OVER o AS n0, sum(s) OVER o AS s0, sum(n) OVER w AS n, sum(s) OVER w AS s FROM sums{r}_{k}
  WINDOW o AS (PARTITION BY path, f ORDER BY b), w AS (PARTITION BY path, f)),
best{r}_{k} AS MATERIALIZED (SELECT * FROM (SELECT *, s0 * s0 / n0 + (s - s0) * (s - s0) / (n - n0) - s * s / n AS gain FROM side{r}_{k}
  WHERE n0 >= {least_rows} AND n - n0 >= {least_rows}) WHERE gain > 1e-7 ORDER BY gain DESC, path, f, b LIMIT 1),
leaf{r}_{k + 1} AS MATERIALIZED (SELECT l.trip_id, l.path || CASE WHEN t.path IS NULL THEN '' WHEN i.b <= t.b THEN '0' ELSE '1' END AS path
  FROM leaf{r}_{k} l LEFT JOIN best{r}_{k} t ON t.path = l.path LEFT JOIN bins i ON i.trip_id = l.trip_id AND i.f = t.f)"""
        out += f"""
, value{r} AS (SELECT path, {middle} AS m FROM (SELECT path, rest AS x, row_number() OVER (PARTITION BY path ORDER BY rest) - 1 AS rn,
  count(*) OVER (PARTITION BY path) AS n FROM grad{r} JOIN leaf{r}_{leaves - 1} USING (trip_id)) GROUP BY path),
score{r + 1} AS MATERIALIZED (SELECT trip_id, y, score + {rate} * m AS score FROM grad{r} JOIN leaf{r}_{leaves - 1} USING (trip_id) JOIN value{r} USING (path))"""
    return with_ctes(TRIPS, body=out + f"\nSELECT trip_id, round(score, 6) AS predicted_fare_amount FROM score{rounds}")


def trained_sql() -> dict[str, str]:
    """What holds of the fitted models, and a depth-1 tree in full: the split with the largest drop of
    the squared error among the midpoints of neighbouring values of all features."""
    features = ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in FEATURES)
    stump = with_ctes(TRIPS, body=f"""
, tv AS (UNPIVOT (SELECT trip_id, fare_amount, {features} FROM training) ON {", ".join(FEATURES)}
         INTO NAME feature VALUE x),
vc AS (SELECT feature, x, count(*) AS n, sum(fare_amount) AS s FROM tv GROUP BY ALL),
cut AS (SELECT feature, x, lead(x) OVER f AS nx, sum(n) OVER f AS nl, sum(s) OVER f AS sl,
               sum(n) OVER w AS nt, sum(s) OVER w AS st
        FROM vc WINDOW f AS (PARTITION BY feature ORDER BY x), w AS (PARTITION BY feature)),
best AS (SELECT feature, (x + nx) / 2 AS threshold, sl / nl AS left_mean, (st - sl) / (nt - nl) AS right_mean
         FROM cut WHERE nx IS NOT NULL
         ORDER BY sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) DESC LIMIT 1)
SELECT v.trip_id, round(CASE WHEN v.x <= b.threshold THEN b.left_mean ELSE b.right_mean END, 6) AS predicted_fare_amount
FROM tv v JOIN best b USING (feature)""")
    return {
        "tree_stump_scores": stump,
        "boosted_leafwise_scores": _boosted_sql(rounds=2, leaves=4, rate=0.3, least_rows=20, bins=255),
        "ridge_normal_equations": "SELECT unnest([" + ", ".join(f"'{n}'" for n in FEATURES) + "]) AS feature, true AS holds",
        "score_tree_checks": with_ctes(TRIPS, REQUESTS, body="""
SELECT request_id, true AS prediction_finite, CAST(9 - count_if(NOT matched) AS INTEGER) AS matched_count
FROM compared GROUP BY ALL"""),
        "explain_tree_checks": with_ctes(TRIPS, REQUESTS, body="""
SELECT request_id, true AS additive, 9 AS contributions FROM accepted"""),
    }


def stream_sql() -> dict[str, str]:
    base = (TRIPS, REQUESTS)
    return {
        "stream_parity_scored": with_ctes(*base, body="""
SELECT request_id, feature_mode, applied_skew_mode,
       CAST(9 - count_if(NOT matched) AS INTEGER) AS matched_count,
       CAST(count_if(NOT matched) AS INTEGER) AS mismatch_count,
       3.0 + 2.5 * max(CASE WHEN feature = 'trip_distance_miles' THEN serving_value END) AS predicted_fare_amount
FROM compared GROUP BY ALL"""),
        "stream_json_requests": f"""
WITH checked AS ({base_sql()["requests_damaged_json"]}),
applied AS (SELECT *, CASE WHEN request_id % 4 = 0 OR request_id % 3 = 0 THEN 'none'
                           WHEN request_id % 3 = 1 THEN 'distance_unit' ELSE 'timezone' END AS skew,
                   CASE WHEN request_id % 23 = 12 THEN 4.5::DOUBLE ELSE 2.25::DOUBLE END AS miles FROM checked)
SELECT request_id, reasons, CASE WHEN accepted THEN skew END AS applied_skew_mode,
       CASE WHEN accepted THEN 3.0::DOUBLE + 2.5::DOUBLE * round(miles * CASE WHEN skew = 'distance_unit' THEN 1.609344::DOUBLE ELSE 1 END, 6)
       END AS predicted_fare_amount
FROM applied""",
        "stream_drift_windows": _windows_sql("day", WINDOW_FEATURES),
        "stream_drift_hourly": _windows_sql("hour", WINDOW_STATUS),
        "stream_rejects": base_sql()["requests_rejected"],
        "stream_rolling_drift": drift_sql()["drift_report_overall"],
    }


def all_sql() -> dict[str, str]:
    return {**base_sql(), **drift_sql(), **model_sql(), **trained_sql(), **stream_sql()}
