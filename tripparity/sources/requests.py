"""Scoring-request sources.

A request is a trip (pickup instant, zones, passengers, miles) plus a feature mode and a skew mode.
Requests arrive either as a typed table (here derived from the ``trips`` view) or as wire JSON
strings, which are parsed with the same lax rules a JSON API applies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from tripparity.functions.time import has_offset, instant_of, utc_wall_clock
from tripparity.operators.faults import (FEATURE_MODE_BROKEN, FEATURE_MODE_CORRECT, SKEW_MODES,
                                         SKEW_NONE)

REQUEST_FIELDS = (
    "pickup_datetime",
    "pickup_location_id",
    "dropoff_location_id",
    "passenger_count",
    "trip_distance_miles",
    "feature_mode",
    "skew_mode",
)

# A decimal number as text.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def requests_from_trips(trips: DataFrame) -> DataFrame:
    """Requests derived from trips: pickup is read as UTC; modes are mixed by trip id.

    ``served_at`` (the pickup instant) and ``request_id`` order the served log.
    """
    event_id = F.col("trip_id")
    skew = (F.when(event_id % 3 == 0, F.lit(SKEW_MODES[0]))
            .when(event_id % 3 == 1, F.lit(SKEW_MODES[1]))
            .otherwise(F.lit(SKEW_MODES[2])))
    return trips.select(
        event_id.alias("request_id"),
        F.col("pickup_datetime"),
        F.col("pickup_location_id").try_cast("bigint").alias("pickup_location_id"),
        F.col("dropoff_location_id").try_cast("bigint").alias("dropoff_location_id"),
        F.col("passenger_count").try_cast("int").alias("passenger_count"),
        F.col("trip_distance").cast("double").alias("trip_distance_miles"),
        F.when(event_id % 4 == 0, F.lit(FEATURE_MODE_CORRECT)).otherwise(F.lit(FEATURE_MODE_BROKEN))
        .alias("feature_mode"),
        skew.alias("skew_mode"),
        F.col("pickup_datetime").alias("served_at"),
        F.col("event_type"),
    )


TRIP_FIELDS = REQUEST_FIELDS[:5]


def bare_trips(requests: DataFrame) -> DataFrame:
    """The trips of requests, without modes."""
    return requests.select("request_id", *TRIP_FIELDS)


def requests_to_json(requests: DataFrame) -> DataFrame:
    """The wire form of typed requests: ``request_id`` plus one JSON document per request.

    The pickup is written as ISO-8601 with a ``Z`` offset (``pickup_datetime`` is a UTC wall clock
    or an instant); a null passenger count is written as JSON null.
    """
    data_type = requests.schema["pickup_datetime"].dataType.simpleString()
    pickup = F.col("pickup_datetime")
    if data_type == "timestamp":
        pickup = utc_wall_clock(pickup, requests.schema["pickup_datetime"].dataType)
    iso = F.date_format(pickup, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    body = F.to_json(F.struct(iso.alias("pickup_datetime"), *[F.col(c) for c in REQUEST_FIELDS[1:]]),
                     {"ignoreNullFields": "false"})
    return requests.select("request_id", body.alias("value"))


def _kind(variant, text, name: str):
    """The JSON type of a field: STRING, BIGINT, DECIMAL(..), DOUBLE, BOOLEAN, VOID (null), ...; null if it is missing.

    A document that only the lenient reader takes (a key given twice) counts as text.
    """
    own = F.schema_of_variant(F.try_variant_get(variant, f"$.{name}", "variant"))
    return F.coalesce(own, F.when(text.isNotNull(), F.lit("STRING")))


def _lax_int(text, kind):
    """An integer as a JSON number (3, 3.0, 3e0), text ("3", "3.0") or boolean; 2.5, "3e0", junk or one beyond 64 bits -> null."""
    as_double = _number(text, kind)
    whole = F.when(as_double == F.rint(as_double), as_double.try_cast("long"))
    return F.when(kind == "BOOLEAN", (text == "true").cast("long")) \
        .when(text.rlike(r"^\s*[+-]?[0-9]+(\.0+)?\s*$"), F.regexp_replace(F.trim(text), r"\.0+$", "").try_cast("long")) \
        .when(kind != "STRING", whole)


def _number(text, kind):
    """A decimal number, written out or as text, or a boolean; type suffixes, names of non-numbers and junk -> null."""
    return F.when(kind == "BOOLEAN", (text == "true").cast("double")).when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


EPOCH_PATTERN = r"^[+-]?[0-9]+(\.[0-9]*)?$"
MILLISECONDS_FROM = 2e10  # fixed value: a greater epoch number counts milliseconds
LATEST_EPOCH = 253402300800.0  # seconds: the year 10000


def _epoch_number(text, kind):
    """Whether a pickup is a number of seconds (or milliseconds) since the epoch."""
    return F.coalesce(kind.rlike("^(BIGINT|DECIMAL|DOUBLE)") | ((kind == "STRING") & text.rlike(EPOCH_PATTERN)), F.lit(False))


def _epoch_instant(text):
    number = text.try_cast("double")
    seconds = F.when(F.abs(number) > MILLISECONDS_FROM, number / 1000).otherwise(number)
    return F.when(F.abs(seconds) < LATEST_EPOCH, F.timestamp_micros(F.rint(seconds * 1000000).cast("long")))


def parse_json_requests(raw: DataFrame, column: str = "value", id_column: str | None = None) -> DataFrame:
    """Wire JSON requests -> typed requests plus ``parse_errors`` (array<string>).

    Every field is read as text beside its JSON type, so that type problems are reported instead of
    silently becoming null, a null is told from a missing field and ``"1e2"`` from ``1e2``; unexpected
    fields are reported too. The pickup must carry an offset or be a number since the epoch; it is kept
    as an instant (TIMESTAMP).
    """
    fields = F.from_json(F.col(column), MapType(StringType(), StringType()))
    parsed = raw.select(*([F.col(id_column).alias("request_id")] if id_column else []),
                        fields.alias("_m"), F.try_parse_json(F.col(column)).alias("_v"))
    m, v = F.col("_m"), F.col("_v")
    # The types are read once, in a projection of their own.
    parsed = parsed.select("*", *[_kind(v, m[name], name).alias(f"_k_{name}") for name in REQUEST_FIELDS])
    kind = {name: F.col(f"_k_{name}") for name in REQUEST_FIELDS}
    pickup_text = m["pickup_datetime"]
    epoch = _epoch_number(pickup_text, kind["pickup_datetime"])
    zoned = has_offset(pickup_text) | epoch
    pickup = F.when(epoch, _epoch_instant(pickup_text)).otherwise(instant_of(pickup_text))
    pu, do, pc = (_lax_int(m[name], kind[name]) for name in ("pickup_location_id", "dropoff_location_id", "passenger_count"))
    distance = _number(m["trip_distance_miles"], kind["trip_distance_miles"])
    feature_mode = F.coalesce(m["feature_mode"], F.lit(FEATURE_MODE_BROKEN))
    skew_mode = F.coalesce(m["skew_mode"], F.lit(SKEW_NONE))
    extras = F.array_except(F.map_keys(m), F.array(*[F.lit(f) for f in REQUEST_FIELDS]))
    errors = F.array(
        F.when(m.isNull(), F.lit("malformed_json")),
        F.when(pickup_text.isNull(), F.lit("pickup_datetime_missing")),
        F.when(pickup_text.isNotNull() & ~zoned, F.lit("pickup_datetime_without_offset")),
        F.when(zoned & pickup.isNull(), F.lit("pickup_datetime_invalid")),
        F.when(pu.isNull(), F.lit("pickup_location_id_not_integer")),
        F.when(do.isNull(), F.lit("dropoff_location_id_not_integer")),
        F.when(m["passenger_count"].isNotNull() & pc.try_cast("int").isNull(), F.lit("passenger_count_not_integer")),
        F.when(distance.isNull(), F.lit("trip_distance_miles_not_number")),
        F.when(F.size(extras) > 0, F.concat(F.lit("unexpected_fields:"), F.array_join(extras, ","))),
        *[F.when(kind[name] == "VOID", F.lit(f"{name}_null")) for name in ("feature_mode", "skew_mode")],
    )
    return parsed.select(
        *(["request_id"] if id_column else []),
        pickup.alias("pickup_datetime"),
        pu.alias("pickup_location_id"),
        do.alias("dropoff_location_id"),
        pc.try_cast("int").alias("passenger_count"),
        distance.alias("trip_distance_miles"),
        feature_mode.alias("feature_mode"),
        skew_mode.alias("skew_mode"),
        F.array_except(errors, F.array(F.lit(None).cast("string"))).alias("parse_errors"),
    )
