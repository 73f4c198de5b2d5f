"""Reference statistics of the training features and PSI drift of served traffic, now or as of any row.

Reference statistics read the nine feature columns a few times and shuffle only bounded aggregates:
moments, bucket histograms for the exact deciles (buckets that get finer where a decile lies), bin
counts. Only the summary (9 features x at most 11 edges) ever reaches the driver.

Drift is one aggregate over the sample (per group, optionally) followed by a projection: PSI uses
the reference's own edges and proportions as literals, so no join and no broadcast of data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from tripparity.functions.arrays import bin_counts, bin_index_literal, pin_edges_py, psi_sql, psi_status
from tripparity.functions.numeric import ordered_key
from tripparity.operators.vector import FEATURE_NAMES
from tripparity.session import scratch_path

# Fixed values of the drift monitor.
DEFAULT_BUFFER_SIZE = 500
MINIMUM_SAMPLES_FOR_DRIFT = 30
DRIFT_BIN_COUNT = 10

STATUS_UNAVAILABLE = "unavailable"
STATUS_INSUFFICIENT = "insufficient_data"
STATUS_STABLE = "stable"
STATUS_MODERATE = "moderate"
STATUS_SIGNIFICANT = "significant"
SEVERITY = (STATUS_STABLE, STATUS_MODERATE, STATUS_SIGNIFICANT)  # worst-of order

REFERENCE_SCHEMA = StructType([
    StructField("feature", StringType(), False),
    StructField("mean", DoubleType(), False),
    StructField("std", DoubleType(), False),
    StructField("min", DoubleType(), False),
    StructField("max", DoubleType(), False),
    StructField("bin_edges", ArrayType(DoubleType(), False), False),
    StructField("bin_proportions", ArrayType(DoubleType(), False), False),
])


@dataclass(frozen=True)
class FeatureReference:
    mean: float
    std: float
    minimum: float
    maximum: float
    bin_edges: tuple[float, ...]
    bin_proportions: tuple[float, ...]


ReferenceStats = dict[str, FeatureReference]


# ----------------------------------------------------------------------------- reference (A1-A5)

DIGIT = 16  # bits of a key that one pass decides


def _values(features: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(f, x, key) of every row and feature number f; nulls go."""
    pairs = F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).alias("x")) for i, c in enumerate(columns)])
    return features.select(F.explode(pairs).alias("p")).select("p.f", "p.x").where("x IS NOT NULL") \
        .withColumn("key", ordered_key("x"))


def _histogram(values: DataFrame, parents: dict[int, set[int]] | None, digits: int) -> DataFrame:
    """(f, parent, bucket): how many keys share their first ``digits`` digits, with the least and greatest value.

    Counted in every task first; at most 2^DIGIT buckets of each parent (the digits before) are
    shuffled, however many values there are. ``parents`` keeps the buckets that go on.
    """
    shift = 64 - DIGIT * digits
    parent = F.shiftright("key", shift + DIGIT) if digits > 1 else F.lit(0).cast("long")
    values = values.withColumn("parent", parent)
    if parents is not None:
        # At most one row per wanted rank; as a join, so that the key is computed once.
        wanted = values.sparkSession.createDataFrame([(f, p) for f, held in sorted(parents.items()) for p in sorted(held)], "f int, parent long")
        values = values.join(F.broadcast(wanted), ["f", "parent"], "left_semi")
    bucket = F.shiftright("key", shift) if shift else F.col("key")
    return values.groupBy("f", "parent", bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))


def _magnitude(column: str) -> Column:
    """A whole number that never falls as the double grows: sixteenths of octaves of its size, mirrored for negative ones."""
    octaves = "cast(floor(greatest(-18000D, least(16 * log2({}), 18000D))) AS bigint) + 20000L"
    return F.expr(f"CASE WHEN `{column}` > 0 THEN {octaves.format(f'`{column}`')} WHEN `{column}` < 0 THEN -({octaves.format(f'-`{column}`')}) ELSE 0L END")


def order_statistics(features: DataFrame, columns: tuple[str, ...], ranks: dict[int, set[int]]) -> dict[tuple[int, int], float]:
    """Values at the wanted 0-based ranks of the columns' sorted rows. Columns hold doubles without NaN; nulls are left out.

    The first pass counts rows by sixteenths of octaves, at most 2^17 buckets of a column. Inside one,
    doubles lie evenly, so every further pass cuts the buckets with a wanted rank into 2^DIGIT equal
    parts between their least and greatest value, down to a single value: about four passes, which
    read the columns that are still open and drop all other rows by a small join.
    """
    spark = features.sparkSession
    open_ = [(f, rank, 0, rank) for f, wanted in ranks.items() for rank in sorted(wanted)]  # f, rank, span, rank within
    found: dict[tuple[int, int], float] = {}
    levels: list[DataFrame] = []
    while open_:
        asked_columns = tuple(c for f, c in enumerate(columns) if any(o[0] == f for o in open_))
        numbers = F.array(*[F.lit(columns.index(c)) for c in asked_columns])
        rows = _values(features, asked_columns).select(numbers[F.col("f")].alias("f"), "x", F.lit(0).alias("span"), _magnitude("x").alias("bucket"))
        for level in levels:  # one row per span
            rows = rows.join(F.broadcast(level), ["f", "span", "bucket"]).select(
                "f", "x", F.col("next").alias("span"), F.floor((F.col("x") - F.col("low")) / F.col("width") * (1 << DIGIT)).alias("bucket"))
        buckets = rows.groupBy("f", "span", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        upto = F.sum("n").over(Window.partitionBy("f", "span").orderBy("bucket"))
        asked = spark.createDataFrame(open_, "f int, rank long, span int, within long")
        hit = buckets.withColumn("before", upto - F.col("n")).join(F.broadcast(asked), ["f", "span"]) \
            .where((F.col("within") >= F.col("before")) & (F.col("within") < F.col("before") + F.col("n")))
        open_, spans = [], {}
        for r in hit.select("f", "rank", "span", "bucket", "low", "high", (F.col("within") - F.col("before")).alias("left")).collect():
            if r["low"] == r["high"]:
                found[r["f"], r["rank"]] = r["low"]
            else:
                at = spans.setdefault((r["f"], r["span"], r["bucket"]), (len(spans), r["low"], r["high"] - r["low"]))
                open_.append((r["f"], r["rank"], at[0], r["left"]))
        levels.append(spark.createDataFrame([(*key, *span) for key, span in spans.items()],
                                            "f int, span int, bucket long, next int, low double, width double"))
    return found


def select_ranks(values: DataFrame, ranks: dict[int, set[int]]) -> dict[tuple[int, int], float]:
    """Values at the wanted 0-based ranks within each group f of (f, x, key = ordered_key(x)), by radix selection.

    Every pass counts one more digit of the order-preserving keys, but only inside the buckets where a
    wanted rank lies; a bucket of equal values ends its ranks early. Four passes at most, and the
    driver sees one row per wanted rank.
    """
    spark = values.sparkSession
    open_ = [(f, rank, 0, rank) for f, wanted in ranks.items() for rank in sorted(wanted)]  # f, rank, bucket, rank within
    found: dict[tuple[int, int], float] = {}
    for digits in range(1, 64 // DIGIT + 1):
        if not open_:
            break
        parents = {f: {o[2] for o in open_ if o[0] == f} for f in {o[0] for o in open_}}
        buckets = _histogram(values, parents if digits > 1 else None, digits)
        # One window per parent bucket: at most 2^DIGIT rows.
        upto = F.sum("n").over(Window.partitionBy("f", "parent").orderBy("bucket"))
        asked = spark.createDataFrame(open_, "f int, rank long, parent long, within long")
        hit = buckets.withColumn("before", upto - F.col("n")).join(F.broadcast(asked), ["f", "parent"]) \
            .where((F.col("within") >= F.col("before")) & (F.col("within") < F.col("before") + F.col("n")))
        open_ = []
        for r in hit.select("f", "rank", "bucket", "low", "high", (F.col("within") - F.col("before")).alias("left")).collect():
            if r["low"] == r["high"]:
                found[r["f"], r["rank"]] = r["low"]
            else:
                open_.append((r["f"], r["rank"], r["bucket"], r["left"]))
    return found


def compute_reference_stats(features: DataFrame, bins: int = DRIFT_BIN_COUNT,
                            columns: tuple[str, ...] = FEATURE_NAMES, written: bool = False) -> ReferenceStats:
    """A1-A5: mean, population std, min, max, pinned decile edges and bin proportions per feature.

    Exact at every size: moments and bin counts are single aggregates, the order statistics around each
    decile (joined by linear interpolation) come from bucket counts that get finer, so no exchange grows
    with the values. The columns are read several times: unless ``features`` is a ``written`` table they are
    written to the shared folder first. Nulls are left out; a feature without any value and values
    that are not finite raise a ValueError that names them.
    """
    spark = features.sparkSession
    features = features.select(*[F.col(c).cast("double").alias(c) for c in columns])
    if not written:
        path = scratch_path(spark, "reference-features")
        features.write.parquet(path)
        features = spark.read.schema(features.schema).parquet(path)

    odd = [F.isnan(c) | (F.abs(c) == float("inf")) for c in columns]
    totals = features.agg(*[f(F.col(c)).alias(f"{name}{i}") for i, c in enumerate(columns) for name, f in (
        ("rows", F.count), ("mean", F.avg), ("low", F.min), ("high", F.max))],
        *[F.count_if(o).alias(f"odd{i}") for i, o in enumerate(odd)]).first()
    if not any(totals[f"rows{i}"] for i in range(len(columns))):
        raise ValueError("reference statistics need at least one row")
    bad = [f"{c}: {totals[f'odd{i}']} values are not finite" if totals[f"odd{i}"] else f"{c}: no value"
           for i, c in enumerate(columns) if totals[f"odd{i}"] or not totals[f"rows{i}"]]
    if bad:
        raise ValueError("no reference statistics for " + "; ".join(bad))

    rows = {i: totals[f"rows{i}"] for i in range(len(columns))}
    places = {(f, i): divmod(i * (n - 1), bins) for f, n in rows.items() for i in range(bins + 1)}
    ranks: dict[int, set[int]] = {}
    for (f, _), (low, part) in places.items():
        ranks.setdefault(f, set()).update({low, low + 1} if part else {low})
    values = order_statistics(features, columns, ranks)
    edges = {}
    for f in range(len(columns)):
        quantiles = []
        for i in range(bins + 1):
            low, part = places[f, i]
            share = part / bins
            quantiles.append(values[f, low] if not part else (1 - share) * values[f, low] + share * values[f, low + 1])
        edges[f] = pin_edges_py(quantiles)

    # Bins and squared deviations: one more aggregate over the rows.
    binned = features.select("*", *[bin_index_literal(c, edges[f]).alias(f"__b{f}") for f, c in enumerate(columns)])
    aggs = [F.avg((F.col(c) - F.lit(totals[f"mean{f}"])) * (F.col(c) - F.lit(totals[f"mean{f}"]))).alias(f"var{f}") for f, c in enumerate(columns)]
    for f, c in enumerate(columns):
        aggs += [F.expr(f"count_if(`__b{f}` = {b} AND `{c}` IS NOT NULL) AS c{f}_{b}") for b in range(len(edges[f]) - 1)]
    counts = binned.agg(*aggs).first()
    return {name: FeatureReference(
        mean=float(totals[f"mean{f}"]), std=math.sqrt(counts[f"var{f}"]), minimum=float(totals[f"low{f}"]),
        maximum=float(totals[f"high{f}"]), bin_edges=tuple(edges[f]),
        bin_proportions=tuple(counts[f"c{f}_{b}"] / rows[f] for b in range(len(edges[f]) - 1)))
        for f, name in enumerate(columns)}


def reference_frame(spark: SparkSession, stats: ReferenceStats) -> DataFrame:
    """The statistics as a small DataFrame (one row per feature, D12)."""
    rows = [(name, s.mean, s.std, s.minimum, s.maximum, list(s.bin_edges), list(s.bin_proportions))
            for name, s in stats.items()]
    return spark.createDataFrame(rows, REFERENCE_SCHEMA)


def stats_from_frame(frame: DataFrame) -> ReferenceStats:
    """Back from the D12 frame; it holds one row per feature, so collecting it is bounded."""
    return {row["feature"]: FeatureReference(row["mean"], row["std"], row["min"], row["max"],
                                             tuple(row["bin_edges"]), tuple(row["bin_proportions"]))
            for row in frame.collect()}


# ----------------------------------------------------------------------------- served buffer

SALTS = 64  # parts of a group that are ranked on their own first


def latest(served: DataFrame, n: int = DEFAULT_BUFFER_SIZE,
           order: tuple[str, ...] = ("served_at", "request_id")) -> DataFrame:
    """The ``n`` most recent served rows (ties broken by the later columns, descending).

    Rows per hour give the newest hour before which ``n`` rows are already covered; only rows from
    that hour on are sorted (top-k per task, then one merge), however long the log is.
    """
    hour = F.date_trunc("hour", F.col(order[0]))
    hours = served.where(F.col(order[0]).isNotNull()).groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    newest_first = Window.orderBy(F.col("hour").desc())  # one row per hour of the log
    covered = hours.withColumn("upto", F.sum("n").over(newest_first)).where(F.col("upto") >= n)
    since = covered.agg(F.max("hour").alias("since"))
    recent = served.where(F.coalesce(hour >= since.scalar(), F.lit(True)))
    return recent.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def latest_per_group(served: DataFrame, group: str, n: int = DEFAULT_BUFFER_SIZE,
                     order: tuple[str, ...] = ("served_at", "request_id"), salts: int = SALTS) -> DataFrame:
    """W1 per group: the ``n`` most recent rows of each group.

    Ranks twice: first within (group, hash of the order columns), then the at most ``n`` rows of each
    part within the group. A hot group is spread over ``salts`` tasks whatever ``n`` is.
    """
    newest = [F.col(c).desc() for c in order]
    salted = served.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    part = Window.partitionBy(group, "_salt").orderBy(*newest)
    salted = salted.withColumn("_rank", F.row_number().over(part)).where(F.col("_rank") <= n).drop("_rank", "_salt")
    whole = Window.partitionBy(group).orderBy(*newest)
    return salted.withColumn("_rank", F.row_number().over(whole)).where(F.col("_rank") <= n).drop("_rank")


# ----------------------------------------------------------------------------- PSI

def psi_expression(reference: FeatureReference, count_prefix: str, total: str) -> Column:
    """PSI of the bin-count columns ``<count_prefix><b>`` against the reference (literals)."""
    if len(reference.bin_proportions) != len(reference.bin_edges) - 1:
        raise ValueError("a reference needs one proportion for every bin")
    return psi_sql(reference.bin_proportions, count_prefix, total)


def worst_status(statuses: list[Column]) -> Column:
    rank = F.greatest(*[F.when(s == F.lit(SEVERITY[2]), 2).when(s == F.lit(SEVERITY[1]), 1).otherwise(0)
                        for s in statuses])
    return F.when(rank == 2, F.lit(SEVERITY[2])).when(rank == 1, F.lit(SEVERITY[1])).otherwise(
        F.lit(SEVERITY[0]))


def drift_summary(sample: DataFrame, reference: ReferenceStats | None,
                  group_by: tuple[str, ...] = (), min_samples: int = MINIMUM_SAMPLES_FOR_DRIFT
                  ) -> DataFrame:
    """One row per group: sample count, per-feature current mean and PSI, per-feature status.

    One aggregate (count, 9 means, <= 90 bin counts), then a projection. Features missing from the
    reference raise, like the reference lookup it mirrors.
    """
    aggs = [F.count(F.lit(1)).alias("sample_count")]
    if reference is not None:
        missing = [name for name in FEATURE_NAMES if name not in reference]
        if missing:
            raise KeyError(f"reference statistics lack features: {missing}")
        # Bin index computed once per feature in a projection, then one count_if per bin.
        sample = sample.select(*group_by, *[F.col(name).cast("double").alias(f"x{i}")
                                            for i, name in enumerate(FEATURE_NAMES)])
        sample = sample.select("*", *[bin_index_literal(f"x{i}", list(reference[name].bin_edges))
                                      .alias(f"b{i}") for i, name in enumerate(FEATURE_NAMES)])
        for i, name in enumerate(FEATURE_NAMES):
            aggs.append(F.avg(F.col(f"x{i}")).alias(f"mean{i}"))
            aggs += bin_counts(f"b{i}", len(reference[name].bin_edges) - 1, f"c{i}_")
    agg = sample.groupBy(*group_by).agg(*aggs) if group_by else sample.agg(*aggs)
    if reference is None:
        return agg.select(*group_by, "sample_count",
                          F.lit(STATUS_UNAVAILABLE).alias("status"), F.lit(False).alias("reference_available"))
    n = F.col("sample_count")
    out = [*group_by, "sample_count"]
    statuses = []
    for i, name in enumerate(FEATURE_NAMES):
        psi = psi_expression(reference[name], f"c{i}_", "sample_count")
        out += [psi.alias(f"psi{i}"), F.col(f"mean{i}").alias(f"current_mean{i}")]
    with_psi = agg.select(*out)
    for i in range(len(FEATURE_NAMES)):
        statuses.append(psi_status(F.col(f"psi{i}")))
    status = F.when(n < F.lit(min_samples), F.lit(STATUS_INSUFFICIENT)).otherwise(worst_status(statuses))
    return with_psi.select("*", *[s.alias(f"status{i}") for i, s in enumerate(statuses)],
                           status.alias("status"), F.lit(True).alias("reference_available"))


def drift_features(summary: DataFrame, reference: ReferenceStats | None,
                   group_by: tuple[str, ...] = (), min_samples: int = MINIMUM_SAMPLES_FOR_DRIFT
                   ) -> DataFrame:
    """D13 per feature: feature, psi, status, reference_mean, current_mean (empty when gated)."""
    schema = StructType([StructField("feature", StringType()), StructField("psi", DoubleType()),
                         StructField("status", StringType()), StructField("reference_mean", DoubleType()),
                         StructField("current_mean", DoubleType())])
    if reference is None:
        return summary.sparkSession.createDataFrame([], schema)
    rows = F.array(*[
        F.struct(F.lit(name).alias("feature"), F.col(f"psi{i}").alias("psi"),
                 F.col(f"status{i}").alias("status"), F.lit(reference[name].mean).alias("reference_mean"),
                 F.col(f"current_mean{i}").alias("current_mean"))
        for i, name in enumerate(FEATURE_NAMES)])
    return (summary.where(F.col("sample_count") >= F.lit(min_samples))
            .select(*group_by, F.inline(rows)))


def drift_overall(summary: DataFrame, group_by: tuple[str, ...] = ()) -> DataFrame:
    """D13 report: status, sample_count, reference_available."""
    return summary.select(*group_by, "status", "sample_count", "reference_available")


def drift_report(sample: DataFrame, reference: ReferenceStats | None,
                 group_by: tuple[str, ...] = (), min_samples: int = MINIMUM_SAMPLES_FOR_DRIFT
                 ) -> tuple[DataFrame, DataFrame]:
    """A10: (per-feature results, overall report). An empty sample reports sample_count 0."""
    summary = drift_summary(sample, reference, group_by, min_samples)
    return drift_features(summary, reference, group_by, min_samples), drift_overall(summary, group_by)


# ----------------------------------------------------------------------------- drift as of every served row

SEGMENT = 100_000  # consecutive served rows that one task slides over


def served_positions(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``position``, their 0-based place by ``order`` (ascending, nulls first), without a single-task sort.

    Rows are range-partitioned and sorted once and written with their place in their part; the parts'
    sizes, one row a part, give every part's start. Rows with equal ``order`` stand in any order, but
    keep it, since the places are written; they are spread by a random tie, so one repeated row can't
    fill a part.
    """
    spark = rows.sparkSession
    place = F.monotonically_increasing_id()  # (part << 33) + place in the part
    path = scratch_path(spark, "served-positions")
    tied = rows.withColumn("_tie", F.rand(1))
    tied.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie") \
        .withColumn("_place", place).write.parquet(path)
    placed = spark.read.parquet(path)
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part") \
        .withColumn("position", F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))) \
        .drop("_part", "_place", "_start")


def drift_history(served: DataFrame, reference: ReferenceStats, n: int = DEFAULT_BUFFER_SIZE,
                  order: tuple[str, ...] = ("served_at", "request_id"),
                  min_samples: int = MINIMUM_SAMPLES_FOR_DRIFT, segment: int = SEGMENT) -> DataFrame:
    """A10 as of every served row: the report that the buffer of the newest ``n`` rows gave right after it.

    One row per served row: the ``order`` columns, sample_count, psi0..psi8 (by feature number; null below
    ``min_samples``) and status. The log is cut into segments of equal length by position; each gets the
    n - 1 rows before it as a halo from the segment before, so no window spans the log and a busy hour
    is no larger than any other. Inside, a bin's count is the difference of two running counts, which
    costs the same for any ``n``; running counts share longs. Rows of equal ``order`` are taken by their features, rows without a
    time first; an empty log gives no row.
    """
    if n < 1 or segment < n:
        raise ValueError("drift history needs n of at least 1 and segments of at least n rows")
    missing = [name for name in FEATURE_NAMES if name not in reference]
    if missing:
        raise KeyError(f"reference statistics lack features: {missing}")
    bins = [len(reference[name].bin_edges) - 1 for name in FEATURE_NAMES]
    rows = served.select(*order, *[F.col(name).cast("double").alias(f"x{i}") for i, name in enumerate(FEATURE_NAMES)])
    placed = served_positions(rows, (*order, *[f"x{i}" for i in range(len(bins))]))
    binned = placed.select(*order, "position", *[
        bin_index_literal(f"x{i}", list(reference[name].bin_edges)).cast("tinyint").alias(f"b{i}") for i, name in enumerate(FEATURE_NAMES)])
    own = F.floor(F.col("position") / F.lit(segment))
    halo = F.col("position") % segment >= segment - (n - 1)
    spread = binned.withColumn("own", own).withColumn(
        "segment", F.explode(F.when(halo, F.array("own", F.col("own") + 1)).otherwise(F.array("own"))))

    by_place = Window.partitionBy("segment").orderBy("position")
    upto = by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Several running counts share a long: no count outgrows its bits, so the difference of two longs is that of each count.
    bits = (segment + n).bit_length()
    held = 63 // bits
    counts = [(i, b) for i, k in enumerate(bins) for b in range(k)]
    packs = [counts[at:at + held] for at in range(0, len(counts), held)]
    ones = [" + ".join(f"CASE WHEN b{i} = {b} THEN {1 << bits * k}L ELSE 0L END" for k, (i, b) in enumerate(pack)) for pack in packs]
    running = spread.select("*", *[F.sum(F.expr(one)).over(upto).alias(f"r{j}") for j, one in enumerate(ones)])
    before = running.select("*", *[F.lag(f"r{j}", n, 0).over(by_place).alias(f"p{j}") for j in range(len(packs))])
    apart = before.where(F.col("segment") == F.col("own")).select(
        *order, F.least(F.col("position") + 1, F.lit(n)).alias("sample_count"), *[(F.col(f"r{j}") - F.col(f"p{j}")).alias(f"d{j}") for j in range(len(packs))])
    counted = apart.select(*order, "sample_count", *[F.expr(f"shiftright(d{j}, {bits * k}) & {(1 << bits) - 1}L").alias(f"c{i}_{b}")
                                                     for j, pack in enumerate(packs) for k, (i, b) in enumerate(pack)])
    judged = counted.select(*order, "sample_count", *[
        F.when(F.col("sample_count") >= min_samples, psi_expression(reference[name], f"c{i}_", "sample_count")).alias(f"psi{i}")
        for i, name in enumerate(FEATURE_NAMES)])
    status = F.when(F.col("sample_count") < min_samples, F.lit(STATUS_INSUFFICIENT)) \
        .otherwise(worst_status([psi_status(F.col(f"psi{i}")) for i in range(len(bins))]))
    return judged.withColumn("status", status)


__all__ = ["compute_reference_stats", "reference_frame", "stats_from_frame", "latest",
           "latest_per_group", "drift_summary", "drift_features", "drift_overall", "drift_report",
           "drift_history", "served_positions", "FeatureReference", "ReferenceStats"]
