"""M1 split, A12 regression metrics, W2/W3 ranking and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripparity.operators.drift import select_ranks

# Fixed values of model selection.
SELECTION_METRIC = "root_mean_squared_error"
METRIC_NAMES = ("mean_absolute_error", "root_mean_squared_error", "r2_score")
VALIDATION_BUCKETS = 5  # one bucket of five -> 20 % validation


def split_bucket(key: Column, buckets: int = VALIDATION_BUCKETS) -> Column:
    """M1: a stable bucket from the key's md5 (first 8 hex digits as an integer).

    Unlike ``randomSplit`` it does not depend on partitioning or row order, so every engine, run
    and candidate sees the same split.
    """
    head = F.substring(F.md5(key.cast("string")), 1, 8)
    return (F.conv(head, 16, 10).cast("bigint") % F.lit(buckets)).cast("int")


def with_split(df: DataFrame, key: str = "trip_id", buckets: int = VALIDATION_BUCKETS) -> DataFrame:
    """Adds ``is_validation`` (bucket 0 of ``buckets``)."""
    return df.withColumn("is_validation", split_bucket(F.col(key), buckets) == 0)


def with_exact_split(df: DataFrame, key: str = "trip_id", buckets: int = VALIDATION_BUCKETS) -> DataFrame:
    """M1 with the validation part's size fixed: adds ``is_validation`` to ceil(rows / ``buckets``) rows.

    These are the rows of the smallest md5 of ``key`` (60 bits of it), so the split is as stable as
    ``with_split``'s. The greatest md5 taken is found by radix selection: bucket counts, no sort of the
    table. Rows of one key stay on one side, so the part is larger than said only if the last key
    taken repeats. A null key counts as the empty text. ``df`` is read up to five times.
    """
    mark = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")
    rows = df.count()
    if not rows:
        return df.withColumn("is_validation", F.lit(False))
    wanted = -(-rows // buckets)
    keys = df.select(F.lit(0).alias("f"), mark.alias("key")).withColumn("x", F.col("key"))
    greatest = select_ranks(keys, {0: {wanted - 1}})[0, wanted - 1]
    return df.withColumn("is_validation", mark <= greatest)


def regression_metrics(df: DataFrame, label: str = "fare_amount", prediction: str = "prediction",
                       group_by: tuple[str, ...] = ()) -> DataFrame:
    """MAE, RMSE and R^2 in one pass (R^2 via the numerically stable ``var_pop``).

    R^2 of a constant label is 1 without any error and 0 otherwise; under two rows it is null.
    """
    err = F.col(label).cast("double") - F.col(prediction).cast("double")
    aggs = [F.count(F.lit(1)).alias("rows"),
            F.avg(F.abs(err)).alias("mean_absolute_error"),
            F.sqrt(F.avg(err * err)).alias("root_mean_squared_error"),
            F.when(F.count(F.lit(1)) >= 2, F.coalesce(
                F.lit(1.0) - F.try_divide(F.sum(err * err), F.var_pop(F.col(label)) * F.count(F.lit(1))),
                F.when(F.sum(err * err) == 0, 1.0).otherwise(0.0))).alias("r2_score")]
    return df.groupBy(*group_by).agg(*aggs) if group_by else df.agg(*aggs)


def rank_candidates(comparison: DataFrame, metric: str = SELECTION_METRIC) -> DataFrame:
    """Candidates ordered by the selection metric (ties keep candidate order)."""
    return comparison.orderBy(F.col(metric).asc(), F.col("candidate_order").asc())


def select_best(comparison: DataFrame, metric: str = SELECTION_METRIC) -> DataFrame:
    """The candidate with the lowest metric, first wins ties; empty input raises."""
    if comparison.isEmpty():
        raise ValueError("no candidate to choose from")
    return rank_candidates(comparison, metric).limit(1)
