"""Per-request training and serving vectors under the request's feature mode.

broken  -> training = canonical transform, serving = independent online transform + requested fault
correct -> training = serving = shared transform, no fault applied

All three transforms are native expressions in one projection; the row is never split by mode, so a
table may mix modes freely and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripparity.operators.canonical import canonical_columns
from tripparity.operators.contracts import all_of, reasons_of, request_clauses, request_rejections
from tripparity.operators.faults import FEATURE_MODE_BROKEN, SKEW_NONE
from tripparity.operators.online import online_columns
from tripparity.operators.shared import shared_columns
from tripparity.operators.vector import FEATURE_NAMES, flat_features, struct_of, vector_clauses


TRAINING_PREFIX = "t_"
SERVING_PREFIX = "s_"


def feature_pairs(requests: DataFrame) -> DataFrame:
    """Adds the training vector (``t_*``), the serving vector (``s_*``) and ``applied_skew_mode``.

    The three transforms are projected as flat columns first (sub-expressions they share, such as
    the zone conversion, are computed once per row by codegen's common-subexpression elimination)
    and then chosen per row by mode. Vectors stay flat inside the plan: every consumer reads plain
    attributes, which keeps generated code linear in the number of features. ``with_vector_structs``
    nests them for reports.
    """
    stage = requests.select(
        "*",
        *flat_features(canonical_columns(requests), "_c_", cast=False),
        *flat_features(shared_columns(requests), "_h_", cast=False),
        *flat_features(online_columns(requests, F.col("skew_mode")), "_o_", cast=False),
    )
    broken = f"`feature_mode` = '{FEATURE_MODE_BROKEN}'"
    training = {n: F.expr(f"CASE WHEN {broken} THEN `_c_{n}` ELSE `_h_{n}` END") for n in FEATURE_NAMES}
    serving = {n: F.expr(f"CASE WHEN {broken} THEN `_o_{n}` ELSE `_h_{n}` END") for n in FEATURE_NAMES}
    applied = F.expr(f"CASE WHEN {broken} THEN `skew_mode` ELSE '{SKEW_NONE}' END")
    return stage.select(*requests.columns, *flat_features(training, TRAINING_PREFIX, cast=False),
                        *flat_features(serving, SERVING_PREFIX, cast=False), applied.alias("applied_skew_mode"))


def with_vector_structs(df: DataFrame, drop_flat: bool = True) -> DataFrame:
    """Nests ``t_*``/``s_*`` into ``training``/``serving`` structs (the D9 response shape)."""
    out = df.select("*", struct_of(TRAINING_PREFIX).alias("training"),
                    struct_of(SERVING_PREFIX).alias("serving"))
    if drop_flat:
        out = out.drop(*[f"{p}{n}" for p in (TRAINING_PREFIX, SERVING_PREFIX) for n in FEATURE_NAMES])
    return out


def serve_requests(requests: DataFrame) -> DataFrame:
    """Request contract + feature pairs + vector contract.

    Adds ``rejection_reasons`` (empty for an accepted request) and the boolean ``accepted``. A
    request is checked before its vectors are trusted: a distance that rounds to 0 passes the
    request contract but not the vector contract, and is rejected rather than raising.
    """
    request_checks = request_clauses(requests)
    checked = requests.select("*", all_of(request_checks).alias("_request_ok"),
                              request_rejections(requests, request_checks).alias("_request_reasons"))
    paired = feature_pairs(checked)
    # Given an accepted request, every vector clause except "distance > 0" holds by construction
    # (hour/weekday/month come from calendar functions, flags are 0/1, passengers and zones are
    # request-checked), and the serving distance is the training distance or its kilometre
    # conversion, which is positive whenever the training distance (>= 1e-6 once rounded) is. So
    # only the training distance is checked per row. This matters for scale: Spark pushes the
    # acceptance filter towards the scan, and filters get no common-subexpression elimination.
    # The full contract on both vectors (``vector_violations``) is asserted on whole tables in tests.
    vector_checks = vector_clauses(TRAINING_PREFIX, only=("trip_distance_miles",))
    vector_reasons = F.array_distinct(reasons_of(vector_checks))
    reasons = F.when(F.col("_request_ok"), vector_reasons).otherwise(F.col("_request_reasons"))
    ok = F.col("_request_ok") & all_of(vector_checks)
    return (paired.select("*", reasons.alias("rejection_reasons"), ok.alias("accepted"))
            .drop("_request_reasons", "_request_ok"))


def accepted(served: DataFrame) -> DataFrame:
    return served.where(F.col("accepted"))


def rejected(served: DataFrame) -> DataFrame:
    return served.where(~F.col("accepted"))
