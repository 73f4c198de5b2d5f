"""Q1-Q6: feature-by-feature parity of training and serving vectors.

Per row the nine comparisons are a fixed-size array built by one projection over flat feature
columns (``t_*`` training, ``s_*`` serving), so per-trip parity never shuffles and stays in
generated code. Table-level rollups aggregate the
nine features as columns first (map-side partial aggregation) and unpivot the small result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tripparity.functions.arrays import compact
from tripparity.functions.numeric import (ABSOLUTE_TOLERANCE, RELATIVE_DENOMINATOR_FLOOR,
                                          RELATIVE_TOLERANCE, absolute_difference, is_close,
                                          relative_difference)
from tripparity.operators.vector import FEATURE_NAMES, vector_struct

Vector = Column | str  # a struct column, or the prefix of flat feature columns


def _field(vector: Vector, name: str) -> Column:
    """One feature of a vector as a double."""
    value = F.col(f"{vector}{name}") if isinstance(vector, str) else vector[name]
    return value.cast(DOUBLE)

TOTAL_FEATURES = len(FEATURE_NAMES)
DOUBLE = DoubleType()


def _sql_terms(training: str, serving: str, name: str, rel_tol: float, abs_tol: float
               ) -> tuple[str, str, str, str, str]:
    """SQL text of (training value, serving value, matched, absolute diff, relative diff)."""
    t, s = f"CAST(`{training}{name}` AS DOUBLE)", f"CAST(`{serving}{name}` AS DOUBLE)"
    close = (f"(CASE WHEN isnan({t}) OR isnan({s}) THEN false WHEN {t} = {s} THEN true "
             f"ELSE coalesce(abs({t} - {s}) <= greatest({rel_tol!r}D * greatest(abs({t}), abs({s})), "
             f"{abs_tol!r}D), false) END)")
    diff = f"abs({t} - {s})"
    rel = f"({diff} / greatest(abs({t}), {RELATIVE_DENOMINATOR_FLOOR!r}D))"
    return t, s, close, diff, rel


def _sql_struct(training: str, serving: str, name: str, rel_tol: float, abs_tol: float) -> str:
    t, s, close, diff, rel = _sql_terms(training, serving, name, rel_tol, abs_tol)
    return (f"named_struct('feature', '{name}', 'training_value', {t}, 'serving_value', {s}, "
            f"'matched', {close}, 'absolute_difference', {diff}, 'relative_difference', {rel})")


def _flat(training: Vector, serving: Vector) -> bool:
    """Both vectors given as column prefixes: expressions are built as SQL text (one JVM call each)."""
    return isinstance(training, str) and isinstance(serving, str)


def comparison_structs(training: Vector, serving: Vector, rel_tol: float = RELATIVE_TOLERANCE,
                       abs_tol: float = ABSOLUTE_TOLERANCE) -> list[Column]:
    if _flat(training, serving):
        return [F.expr(_sql_struct(training, serving, n, rel_tol, abs_tol)) for n in FEATURE_NAMES]
    structs = []
    for name in FEATURE_NAMES:
        t, s = _field(training, name), _field(serving, name)
        structs.append(F.struct(
            F.lit(name).alias("feature"),
            t.alias("training_value"),
            s.alias("serving_value"),
            is_close(t, s, rel_tol, abs_tol).alias("matched"),
            absolute_difference(t, s).alias("absolute_difference"),
            relative_difference(t, s).alias("relative_difference"),
        ))
    return structs


def comparisons(training: Vector, serving: Vector, rel_tol: float = RELATIVE_TOLERANCE,
                abs_tol: float = ABSOLUTE_TOLERANCE) -> Column:
    """Q2/Q4: ``array<struct<feature, training_value, serving_value, matched,
    absolute_difference, relative_difference>>`` in feature order."""
    if _flat(training, serving):
        return F.expr("array(" + ", ".join(_sql_struct(training, serving, n, rel_tol, abs_tol)
                                           for n in FEATURE_NAMES) + ")")
    return F.array(*comparison_structs(training, serving, rel_tol, abs_tol))


COMPARISON_TYPE = ("struct<feature:string,training_value:double,serving_value:double,matched:boolean,"
                   "absolute_difference:double,relative_difference:double>")


def mismatch_count(training: Vector, serving: Vector, rel_tol: float = RELATIVE_TOLERANCE,
                   abs_tol: float = ABSOLUTE_TOLERANCE) -> Column:
    """Number of features outside tolerance, as one scalar (code-generated) expression."""
    if _flat(training, serving):
        return F.expr(" + ".join(f"CAST(NOT {_sql_terms(training, serving, n, rel_tol, abs_tol)[2]} AS INT)"
                                 for n in FEATURE_NAMES))
    return _count_unmatched(comparison_structs(training, serving, rel_tol, abs_tol))


def _count_unmatched(structs: list[Column]) -> Column:
    total = F.lit(0)
    for s in structs:
        total = total + (~s["matched"]).cast("int")
    return total


def _unmatched(structs: list[Column]) -> Column:
    return compact([F.when(~s["matched"], s) for s in structs], COMPARISON_TYPE)


def mismatched_names(training: Vector, serving: Vector, rel_tol: float = RELATIVE_TOLERANCE,
                     abs_tol: float = ABSOLUTE_TOLERANCE, separator: str = ",") -> Column:
    """The names of the features outside tolerance, joined in feature order (a compact scalar)."""
    if _flat(training, serving):
        parts = ", ".join(f"CASE WHEN NOT {_sql_terms(training, serving, n, rel_tol, abs_tol)[2]} THEN '{n}' END"
                          for n in FEATURE_NAMES)
        return F.expr(f"concat_ws('{separator}', {parts})")
    return F.concat_ws(separator, *[
        F.when(~is_close(_field(training, n), _field(serving, n), rel_tol, abs_tol), F.lit(n))
        for n in FEATURE_NAMES])


def mismatch_structs(training: Vector, serving: Vector, rel_tol: float = RELATIVE_TOLERANCE,
                     abs_tol: float = ABSOLUTE_TOLERANCE) -> Column:
    """Q1: the comparisons outside tolerance, in feature order."""
    if _flat(training, serving):
        items = ", ".join(f"CASE WHEN NOT {_sql_terms(training, serving, n, rel_tol, abs_tol)[2]} "
                          f"THEN {_sql_struct(training, serving, n, rel_tol, abs_tol)} END" for n in FEATURE_NAMES)
        return F.expr(f"array_except(array({items}), array(CAST(NULL AS {COMPARISON_TYPE})))")
    return _unmatched(comparison_structs(training, serving, rel_tol, abs_tol))


def parity_struct(training: Vector, serving: Vector, rel_tol: float = RELATIVE_TOLERANCE,
                  abs_tol: float = ABSOLUTE_TOLERANCE) -> Column:
    """Q3: matched, matched_count, mismatch_count, total_features, comparisons, mismatches.

    The nine comparison structs are built once and shared by all fields (codegen evaluates each
    once per row).
    """
    if _flat(training, serving):
        n_mismatch = mismatch_count(training, serving, rel_tol, abs_tol)
        comps = comparisons(training, serving, rel_tol, abs_tol)
        mismatches = mismatch_structs(training, serving, rel_tol, abs_tol)
    else:
        structs = comparison_structs(training, serving, rel_tol, abs_tol)
        n_mismatch, comps, mismatches = _count_unmatched(structs), F.array(*structs), _unmatched(structs)
    return F.struct(
        (n_mismatch == 0).alias("matched"),
        (F.lit(TOTAL_FEATURES) - n_mismatch).alias("matched_count"),
        n_mismatch.alias("mismatch_count"),
        F.lit(TOTAL_FEATURES).alias("total_features"),
        comps.alias("comparisons"),
        mismatches.alias("mismatches"),
    )


def parity_report(df: DataFrame, training: Vector = "t_", serving: Vector = "s_",
                  rel_tol: float = RELATIVE_TOLERANCE, abs_tol: float = ABSOLUTE_TOLERANCE) -> DataFrame:
    """Adds the ``parity`` struct to every row (vectors given as flat prefixes or struct columns)."""
    return df.withColumn("parity", parity_struct(training, serving, rel_tol, abs_tol))


def parity_long(df: DataFrame, keys: tuple[str, ...], training: Vector = "t_",
                serving: Vector = "s_", only_mismatches: bool = False,
                rel_tol: float = RELATIVE_TOLERANCE, abs_tol: float = ABSOLUTE_TOLERANCE) -> DataFrame:
    """Q1/Q2 as a long table (row x feature). With ``only_mismatches`` it is Q1's mismatch list."""
    if only_mismatches:
        comps = mismatch_structs(training, serving, rel_tol, abs_tol)
    else:
        comps = comparisons(training, serving, rel_tol, abs_tol)
    return df.select(*keys, F.inline(comps))


def parity_rollup(df: DataFrame, group_by: tuple[str, ...], training: Vector = "t_",
                  serving: Vector = "s_", rel_tol: float = RELATIVE_TOLERANCE,
                  abs_tol: float = ABSOLUTE_TOLERANCE) -> DataFrame:
    """Q5: per group and feature: rows, mismatches, mismatch rate, max and mean absolute difference."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(FEATURE_NAMES):
        if _flat(training, serving):
            _, _, close, diff_sql, _ = _sql_terms(training, serving, name, rel_tol, abs_tol)
            aggs += [F.expr(f"count_if(NOT {close}) AS m{i}"), F.expr(f"max({diff_sql}) AS x{i}"),
                     F.expr(f"sum({diff_sql}) AS s{i}")]
            continue
        t, s = _field(training, name), _field(serving, name)
        diff = absolute_difference(t, s)
        aggs += [F.count_if(~is_close(t, s, rel_tol, abs_tol)).alias(f"m{i}"),
                 F.max(diff).alias(f"x{i}"), F.sum(diff).alias(f"s{i}")]
    wide = df.groupBy(*group_by).agg(*aggs)
    per_feature = F.array(*[
        F.struct(F.lit(name).alias("feature"), F.col(f"m{i}").alias("mismatches"),
                 F.col(f"x{i}").alias("max_absolute_difference"),
                 F.col(f"s{i}").alias("sum_absolute_difference"))
        for i, name in enumerate(FEATURE_NAMES)])
    return (wide.select(*group_by, "rows", F.inline(per_feature))
            .withColumn("mismatch_rate", F.col("mismatches") / F.col("rows"))
            .withColumn("mean_absolute_difference", F.col("sum_absolute_difference") / F.col("rows"))
            .drop("sum_absolute_difference"))


def _keyed_vectors(df: DataFrame, key: str, side: str) -> DataFrame:
    """One row per key: the duplicate count and a deterministic representative row.

    The representative is the row with the smallest content hash: ``min_by(feature, hash)`` per
    feature keeps fixed-width buffers, so the aggregation is hash-based (no sort) and combines
    map-side before the shuffle; a key repeated many times is collapsed in every task instead of
    being sent to one. All features follow the same ordering, so they come from the same row.
    """
    row_hash = F.xxhash64(*[F.col(n) for n in FEATURE_NAMES])
    hashed = df.select(key, *FEATURE_NAMES, row_hash.alias("_h"))
    aggs = [F.count(F.lit(1)).alias(f"{side}_rows")]
    aggs += [F.min_by(F.col(n), F.col("_h")).alias(f"_{side}_{n}") for n in FEATURE_NAMES]
    reduced = hashed.groupBy(key).agg(*aggs)
    vector = vector_struct({n: F.col(f"_{side}_{n}") for n in FEATURE_NAMES})
    return reduced.select(key, f"{side}_rows", vector.alias(side))


ROWS_A_TASK = 250_000  # of both tables, in a task that joins them


def join_tasks(offline: DataFrame, online: DataFrame, rows_a_task: int = ROWS_A_TASK) -> int:
    """Tasks enough for both tables, so that a task's memory does not grow with them."""
    least = int(offline.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-(offline.count() + online.count()) // rows_a_task))


def compare_tables(offline: DataFrame, online: DataFrame, key: str = "trip_id", rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """Q6: parity of every online row with the offline row of its key.

    One row per key: offline_rows, online_rows, missing_in (the side without the key), rows_compared,
    rows_mismatched, matched (null unless both sides have the key) and, per feature in order, the
    number of mismatching rows and the largest difference. The offline side has one row per key
    (duplicates are counted, one is taken); equal online vectors of a key are counted before the
    join, so a trip served often costs one comparison per different vector and loses none. Both
    tables are counted first and what is left of them is dealt to a task for every ``rows_a_task``
    rows, a number that adaptive execution keeps.
    """
    tasks = join_tasks(offline, online, rows_a_task)
    left = _keyed_vectors(offline, key, "training").repartition(tasks, key)
    served = online.groupBy(key, *FEATURE_NAMES).agg(F.count(F.lit(1)).alias("_n")).repartition(tasks, key)
    paired = served.join(left, on=key, how="left").select(
        key, "_n", "training_rows", *[F.col(n).alias(f"s_{n}") for n in FEATURE_NAMES],
        *[F.col(f"training.{n}").alias(f"t_{n}") for n in FEATURE_NAMES])
    found = F.col("training_rows").isNotNull()
    aggs = [F.max("training_rows").alias("training_rows"), F.sum("_n").alias("online_rows"),
            F.sum(F.when(found & (mismatch_count("t_", "s_") > 0), F.col("_n")).otherwise(0)).alias("rows_mismatched")]
    for i, name in enumerate(FEATURE_NAMES):
        _, _, close, diff, _ = _sql_terms("t_", "s_", name, RELATIVE_TOLERANCE, ABSOLUTE_TOLERANCE)
        aggs += [F.sum(F.when(found & ~F.expr(close), F.col("_n")).otherwise(0)).alias(f"m{i}"), F.max(F.expr(diff)).alias(f"d{i}")]
    both = F.col("training_rows").isNotNull()
    compared = paired.groupBy(key).agg(*aggs).select(
        key, F.coalesce("training_rows", F.lit(0)).alias("offline_rows"), "online_rows",
        F.when(~both, F.lit("offline")).alias("missing_in"),
        F.when(both, F.col("online_rows")).otherwise(F.lit(0)).alias("rows_compared"), "rows_mismatched",
        F.when(both, F.col("rows_mismatched") == 0).alias("matched"),
        F.when(both, F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"m{i}").alias("mismatches"),
                                        F.col(f"d{i}").alias("max_absolute_difference"))
                               for i, n in enumerate(FEATURE_NAMES)])).alias("features"))
    zero = F.lit(0).cast("bigint")
    unserved = left.join(online.select(key).distinct().repartition(tasks, key), on=key, how="left_anti").select(
        key, F.col("training_rows").alias("offline_rows"), zero.alias("online_rows"), F.lit("online").alias("missing_in"),
        zero.alias("rows_compared"), zero.alias("rows_mismatched"), F.lit(None).cast("boolean").alias("matched"),
        F.lit(None).cast(compared.schema["features"].dataType).alias("features"))
    return compared.unionByName(unserved)


def mismatching_features(features: str = "features") -> Column:
    """Names of the features of ``compare_tables`` with a mismatching row, joined in order."""
    return F.array_join(F.transform(F.filter(features, lambda f: f["mismatches"] > 0), lambda f: f["feature"]), ",")
