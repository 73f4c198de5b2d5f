"""Numeric helpers: rounding, unit conversion, tolerant comparison, finiteness (F8-F16)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values shared with the feature contract.
MILES_TO_KILOMETRES = 1.609344
DEFAULT_PASSENGER_COUNT = 1
RELATIVE_TOLERANCE = 1e-9
ABSOLUTE_TOLERANCE = 1e-9
RELATIVE_DENOMINATOR_FLOOR = 1e-12


def round6_exact(x: Column) -> Column:
    """Six-decimal rounding, half-even on the exact binary value, by fixed-pattern formatting.

    ``round``/``bround`` go through the shortest decimal string and disagree with that rule on a
    few inputs; ``format_number`` with a pattern rounds the exact value half-even. It is slow.
    """
    return F.call_function("format_number", x, F.lit("0.000000")).cast("double")


def round6_sql(x: str) -> str:
    """SQL text of :func:`round6` applied to the SQL expression ``x``."""
    y = f"(({x}) * 1000000D)"
    return (f"CASE WHEN abs({y}) < 1000000000D AND abs({y} - floor({y}) - 0.5D) > 0.000001D "
            f"THEN rint({y}) / 1000000D "
            f"WHEN isnan({x}) OR abs({x}) = CAST('Infinity' AS DOUBLE) THEN ({x}) "
            f"ELSE CAST(format_number({x}, '0.000000') AS DOUBLE) END")


def round6(x: Column | str) -> Column:
    """Python ``round(x, 6)`` (half-even on the exact binary value), mostly in arithmetic.

    With ``y = x * 1e6`` (relative error <= 2^-53), when ``y`` is clearly away from a .5 tie the
    rounding decision is unambiguous and ``rint(y) / 1e6`` is the double nearest to the rounded
    decimal, which is exactly what Python returns. Only near-ties (and huge values) take the exact,
    slower formatting path. Non-finite values pass through. ``x`` may be a Column or SQL text (SQL
    text builds in one call to the JVM).
    """
    if isinstance(x, str):
        return F.expr(round6_sql(x))
    y = x * F.lit(1e6)
    # |y| < 1e9 also excludes NaN and infinities; the common path touches x only a few times.
    clear = (F.abs(y) < F.lit(1e9)) & (F.abs(y - F.floor(y) - F.lit(0.5)) > F.lit(1e-6))
    non_finite = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return (F.when(clear, F.rint(y) / F.lit(1e6))
            .when(non_finite, x)
            .otherwise(round6_exact(x)))


def miles_to_kilometres(distance: Column | str) -> Column:
    """``round6(distance * 1.609344)``; ``distance`` may be SQL text."""
    if isinstance(distance, str):
        return F.expr(round6_sql(f"({distance}) * {MILES_TO_KILOMETRES!r}D"))
    return round6(distance * F.lit(MILES_TO_KILOMETRES))


def is_close(a: Column, b: Column, rel_tol: float = RELATIVE_TOLERANCE,
             abs_tol: float = ABSOLUTE_TOLERANCE) -> Column:
    """``|a-b| <= max(rel_tol * max(|a|, |b|), abs_tol)``; equal infinities match, NaN never.

    ``a`` and ``b`` are doubles (ints compare exactly through the same formula once cast).
    """
    diff = F.abs(a - b)
    bound = F.greatest(F.lit(rel_tol) * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_tol))
    any_nan = F.isnan(a) | F.isnan(b)
    return F.when(any_nan, F.lit(False)).when(a == b, F.lit(True)).otherwise(
        F.coalesce(diff <= bound, F.lit(False)))


def absolute_difference(a: Column, b: Column) -> Column:
    """F12 (double inputs)."""
    return F.abs(a - b)


def relative_difference(training: Column, serving: Column) -> Column:
    """relative to the training value, floored at 1e-12 (double inputs)."""
    denominator = F.greatest(F.abs(training), F.lit(RELATIVE_DENOMINATOR_FLOOR))
    return absolute_difference(training, serving) / denominator


def is_finite(x: Column) -> Column:
    """F16 (null counts as not finite)."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False))


def not_nan(x: Column) -> Column:
    """Spark orders NaN above every number, so range checks must exclude it explicitly."""
    return ~F.isnan(x.cast("double"))


def ordered_key(column: str) -> Column:
    """A long that orders doubles as they compare: the bits of x, mirrored for negative x (both zeros are 0).

    The exponent is guessed by a logarithm and corrected, the 52 bits after it are an exact division by
    a power of two; numbers below the normal range need no special case. Null and NaN give null.
    """
    a = f"abs(`{column}`)"
    guess = f"greatest(-1022, least(1023, cast(coalesce(floor(log2({a})), -1022) AS int)))"
    exponent = f"({guess} + CASE WHEN {a} >= power(2D, {guess} + 1) THEN 1 WHEN {a} < power(2D, {guess}) AND {guess} > -1022 THEN -1 ELSE 0 END)"
    bits = f"(({exponent} + 1022) * 4503599627370496L + cast({a} / power(2D, {exponent} - 52) AS bigint))"
    bits = f"CASE WHEN {a} = double('infinity') THEN 2047 * 4503599627370496L ELSE {bits} END"
    return F.expr(f"CASE WHEN isnan(`{column}`) THEN NULL WHEN `{column}` < 0 THEN -1L - ({bits}) ELSE {bits} END")
