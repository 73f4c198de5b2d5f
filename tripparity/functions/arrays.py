"""Array helpers for histogram bins and PSI."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the drift contract.
PROPORTION_FLOOR = 1e-6
PSI_MODERATE = 0.1
PSI_SIGNIFICANT = 0.25
EDGE_DECIMALS = 9  # quantile edges are snapped so engines that differ by ulps bin alike

INF = float("inf")


def compact(values: list[Column], element_type: str = "string") -> Column:
    """``array(values)`` without its nulls, order kept.

    ``array_except`` against a one-null array is code-generated, unlike a ``filter`` lambda (a
    higher-order function is interpreted, together with every expression beneath it).
    """
    return F.array_except(F.array(*values), F.array(F.lit(None).cast(element_type)))


def pin_edges_py(quantiles: list[float]) -> list[float]:
    """sorted distinct quantiles (snapped to ``EDGE_DECIMALS``), outer edges -inf/+inf.

    Runs on the collected quantile row (at most ``bins + 1`` values per feature). A constant
    column (one distinct quantile) gets the single bin (-inf, +inf).
    """
    snapped = sorted({round(q, EDGE_DECIMALS) for q in quantiles})
    if len(snapped) < 2:
        return [-INF, INF]
    return [-INF, *snapped[1:-1], INF]


def sql_double(value: float) -> str:
    """A finite double as an exact Spark SQL literal (``repr`` round-trips)."""
    return f"{float(value)!r}D"


def bin_index_literal(column: str, edges: list[float]) -> Column:
    """F18 with edges known at plan time: bins are [e_i, e_{i+1}), the outer ones unbounded.

    Built as one SQL expression over the column name (one call to the JVM instead of dozens).
    """
    interior = edges[1:-1]
    if not interior:
        return F.lit(0)
    return F.expr(" + ".join(f"CAST(`{column}` >= {sql_double(e)} AS INT)" for e in interior))


def bin_counts(index_column: str, n_bins: int, prefix: str) -> list[Column]:
    """``count_if(index = b)`` for every bin, aliased ``<prefix><b>``."""
    return [F.expr(f"count_if(`{index_column}` = {b}) AS `{prefix}{b}`") for b in range(n_bins)]


def psi_sql(reference_proportions: tuple[float, ...], count_prefix: str, total: str) -> Column:
    """PSI of the count columns ``<count_prefix><b>`` against reference proportions.

    Each bin adds ``(cur - ref) * ln(cur / ref)`` with both proportions floored at 1e-6; an empty
    sample has PSI 0.
    """
    floor = sql_double(PROPORTION_FLOOR)
    terms = []
    for b, ref_p in enumerate(reference_proportions):
        ref = sql_double(max(ref_p, PROPORTION_FLOOR))
        cur = f"greatest(`{count_prefix}{b}` / `{total}`, {floor})"
        terms.append(f"({cur} - {ref}) * ln({cur} / {ref})")
    return F.expr(f"CASE WHEN `{total}` = 0 THEN 0D ELSE {' + '.join(terms) or '0D'} END")


def psi_status(psi: Column) -> Column:
    """F14."""
    return (F.when(psi >= F.lit(PSI_SIGNIFICANT), F.lit("significant"))
            .when(psi >= F.lit(PSI_MODERATE), F.lit("moderate"))
            .otherwise(F.lit("stable")))
