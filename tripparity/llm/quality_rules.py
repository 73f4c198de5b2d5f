"""Text statistics, fixed rules and robust multivariate outliers, in DataFrame functions only.

Per language and source a minimum-covariance-determinant estimate is fitted to the transformed
statistics: starting from binned medians and deviations, and from small subsets of the rows, the share
``core`` of a group's rows that is closest to the current centre gives the next mean and covariance
(C-steps) until the determinant falls no more; the least determinant is kept. Documents beyond the
cutoff in Mahalanobis distance are rejected. Quantiles come from fixed bins, so every step is a
grouped aggregation whose partial results are small; the result does not depend on the partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripparity.llm.common import SPACES, WORD, materialize, read_table

WINDOW = 8  # words; doubled hashes reach it in three steps
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
CORE = 0.75
STEPS = 4  # of one start that is not followed to convergence
STARTS = 5
MOST_STEPS = 30
TOLERANCE = 1e-6  # of the determinant's logarithm
MIN_GROUP = 25
MIN_POOL = 20
CUTOFF_PROBABILITY = 3e-4
BIN = 0.01
LOG_BINS = 50.0
# Transformed statistics and the least standard deviation each is credited with. Repeated lines and
# words are 0 in most clean documents, so their core has no spread, yet clean documents reach roots of
# 0.58 and 0.53: with floors of the bin's width 169 of sf0.1's 3,302 clean documents would go.
FEATURES = (("log_words", 0.2), ("log_word_length", 0.04), ("symbol_root", 0.05), ("line_root", 0.15), ("repeat_root", 0.15))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often a lambda inside refers to it."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def _tail(values: Column, skip: int) -> Column:
    return F.slice(values, skip + 1, F.greatest(F.size(values) - skip, F.lit(0)))


def _doubled(values: Column, width: int) -> Column:
    """Hashes of windows of 2 * width from hashes of windows of width, position by position."""
    return let(values, lambda v: F.zip_with(F.slice(v, 1, F.greatest(F.size(v) - width, F.lit(0))), _tail(v, width),
                                            lambda a, b: F.xxhash64(a, b)))


def repeat_words(words: Column) -> Column:
    """Number of words inside 8-word windows that occur twice or more in the text."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = _doubled(_doubled(_doubled(hashes, 1), 2), 4)

    def covered(rows: Column) -> Column:
        # rows: (hash, position) in order; a window repeats if a neighbour has its hash
        twin = lambda x, i: ((i > 0) & (rows[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | (
            (i < F.size(rows) - 1) & (rows[F.least(i + 1, F.size(rows) - 1)]["h"] == x["h"]))
        places = F.sort_array(F.transform(F.filter(rows, twin), lambda x: x["i"]))
        return let(places, lambda p: F.aggregate(
            p, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum")),
            lambda acc, at: F.struct(at.alias("last"), (acc["sum"] + F.least(at - acc["last"], F.lit(WINDOW))).alias("sum")),
            lambda acc: acc["sum"]))

    return let(windows, lambda w: F.when(
        F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(
        let(F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered)).cast("long"))


def text_statistics(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (null text: none)."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(WORD))
    return let(words_of(text), lambda w: let(lines, lambda rows: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size(rows).cast("long").alias("n_lines"),
        (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"),
        F.when(F.size(w) > WINDOW, repeat_words(w)).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"))))


# ----------------------------------------------------------------------------- chi-square constants


def chi_square_tail(x: float, d: int) -> float:
    """P(chi-square with d degrees of freedom > x), by the recurrence in d."""
    tail = math.erfc(math.sqrt(x / 2)) if d % 2 else math.exp(-x / 2)
    for k in range(2 - d % 2, d, 2):
        tail += math.exp(k / 2 * math.log(x / 2) - x / 2 - math.lgamma(k / 2 + 1)) if x else 0.0
    return tail


def chi_square_quantile(tail: float, d: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_tail(mid, d) > tail else (low, mid)
    return high


# ----------------------------------------------------------------------------- estimates


def _quantile_bins(rows: DataFrame, keys: list[str], bin_: Column, share: float, name: str) -> DataFrame:
    """Per key the first bin at which ``share`` of the key's rows is reached."""
    counts = rows.groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n"))
    part = ", ".join(keys)
    reached = counts.selectExpr(*keys, "bin", f"sum(n) over (partition by {part} order by bin) as upto",
                                f"sum(n) over (partition by {part}) as total")
    return materialize(reached.where(F.col("upto") >= F.ceil(F.col("total") * F.lit(share)))
                       .groupBy(*keys).agg(F.min("bin").alias("bin")), name)


def _distance(rows: DataFrame, names: list[str]) -> DataFrame:
    """Adds ``d2`` from centre columns c_* and Cholesky columns l_i_j by forward substitution."""
    for i, n in enumerate(names):
        z = F.col(n) - F.col(f"c_{n}")
        for j in range(i):
            z = z - F.col(f"l_{i}_{j}") * F.col(f"z_{j}")
        rows = rows.withColumn(f"z_{i}", z / F.col(f"l_{i}_{i}"))
    return rows.withColumn("d2", sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(1, len(names))),
                                     F.col("z_0") * F.col("z_0"))).drop(*[f"z_{i}" for i in range(len(names))])


def _factored(table: DataFrame, names: list[str], floors: list[float], scale: float) -> DataFrame:
    """Centre, Cholesky factor of (scaled covariance + squared floors on the diagonal) and ``det``, the
    logarithm of its determinant, per group and start."""
    for i in range(len(names)):
        for j in range(i + 1):
            value = F.col(f"s_{i}_{j}") * F.lit(scale) + F.lit(floors[i] ** 2 if i == j else 0.0)
            for k in range(j):
                value = value - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            table = table.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(value, F.lit(floors[i] ** 2 * 1e-3))) if i == j
                                     else value / F.col(f"l_{j}_{j}"))
    det = sum((2 * F.log(F.col(f"l_{i}_{i}")) for i in range(1, len(names))), 2 * F.log(F.col("l_0_0")))
    return table.select("group", "start", *[f"c_{n}" for n in names],
                        *[f"l_{i}_{j}" for i in range(len(names)) for j in range(i + 1)], det.alias("det"))


def _moments(rows: DataFrame, names: list[str], moved: dict[str, Column], *origin: Column) -> DataFrame:
    """Centre c_* and covariance s_i_j per group and start; ``moved`` are the statistics less ``origin``'s o_*."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    sums = rows.groupBy("group", "start").agg(
        *origin, *[F.avg(moved[n]).alias(f"m_{n}") for n in names],
        *[F.avg(moved[names[i]] * moved[names[j]]).alias(f"p_{i}_{j}") for i, j in pairs])
    return sums.select("group", "start", *[(F.col(f"o_{n}") + F.col(f"m_{n}")).alias(f"c_{n}") for n in names],
                       *[(F.col(f"p_{i}_{j}") - F.col(f"m_{names[i]}") * F.col(f"m_{names[j]}")).alias(f"s_{i}_{j}") for i, j in pairs])


def _median_start(rows: DataFrame, names: list[str]) -> DataFrame:
    long = rows.select("group", F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(n).alias("x"))
                                                    for i, n in enumerate(names)])).alias("v")).select("group", "v.f", "v.x")
    medians = _quantile_bins(long, ["group", "f"], F.floor(F.col("x") / BIN), 0.5, "mcd-medians") \
        .select("group", "f", ((F.col("bin") + 0.5) * BIN).alias("median"))
    spread = _quantile_bins(long.join(medians, ["group", "f"]), ["group", "f"],
                            F.floor(F.abs(F.col("x") - F.col("median")) / BIN), 0.5, "mcd-spreads") \
        .select("group", "f", (1.4826 * (F.col("bin") + 0.5) * BIN).alias("spread"))
    d = len(names)
    start = medians.join(spread, ["group", "f"]).groupBy("group").agg(
        F.lit(0).alias("start"), *[F.max(F.when(F.col("f") == i, F.col("median"))).alias(f"c_{n}") for i, n in enumerate(names)],
        *[F.max(F.when(F.col("f") == i, F.col("spread") * F.col("spread"))).alias(f"s_{i}_{i}") for i in range(d)])
    return start.withColumns({f"s_{i}_{j}": F.lit(0.0) for i in range(d) for j in range(i)})


def _subset_starts(rows: DataFrame, names: list[str], starts: int) -> DataFrame:
    """Mean and covariance of about 2 (d + 1) rows a group and start, picked by a hash of their values."""
    sizes = materialize(rows.groupBy("group").agg(F.count("*").alias("n")), "mcd-sizes")
    picked = [F.when(F.pmod(F.xxhash64(F.lit(k), *names), F.col("n")) < 2 * (len(names) + 1), F.lit(k)) for k in range(1, starts)]
    drawn = rows.join(sizes, "group").withColumn("start", F.explode(F.array_compact(F.array(*picked))))
    return _moments(drawn, names, {n: F.col(n) for n in names}, *[F.lit(0.0).alias(f"o_{n}") for n in names])


def covariance_estimates(rows: DataFrame, features: Iterable[tuple[str, float]] = FEATURES, core: float = CORE,
                         steps: int = STEPS, starts: int = 1, tolerance: float | None = None) -> DataFrame:
    """Minimum-covariance-determinant centre and Cholesky factor per ``group`` of ``rows``.

    Of ``starts`` starts the one that ends at the least determinant. With a ``tolerance`` a start is
    done when a step lowers the logarithm of its determinant by no more, ``steps`` at most. The
    covariance is scaled to be consistent for normal data; a statistic's own floor is added so that
    statistics that hardly vary do not reject every other value.
    """
    names, floors = [n for n, _ in features], [f for _, f in features]
    d = len(names)
    factor = core / (1 - chi_square_tail(chi_square_quantile(1 - core, d), d + 2))
    begin = _median_start(rows, names)
    if starts > 1:
        begin = begin.unionByName(_subset_starts(rows, names, starts))
    estimate = materialize(_factored(begin, names, floors, 1.0).withColumn("det", F.lit(math.inf)), "mcd-start")
    moved = {n: F.col(n) - F.col(f"c_{n}") for n in names}
    ended = []
    for _ in range(steps):
        ring = F.floor(LOG_BINS * F.log1p("d2"))
        near = _distance(rows.join(estimate, "group"), names).withColumn("ring", ring)
        limit = _quantile_bins(near, ["group", "start"], F.col("ring"), core, "mcd-rings").withColumnRenamed("bin", "limit")
        # the limits join the few estimates, so that rows meet both in one join
        inner = _distance(rows.join(estimate.join(limit, ["group", "start"]), "group"), names).where(ring <= F.col("limit"))
        table = _moments(inner, names, moved, *[F.first(f"c_{n}").alias(f"o_{n}") for n in names])
        after = _factored(table, names, floors, factor)
        if tolerance is None:
            estimate = materialize(after, "mcd-estimate")
            continue
        before = estimate.select("group", "start", F.col("det").alias("before"))
        after = materialize(after.join(before, ["group", "start"])
                            .withColumn("falls", F.col("before") - F.col("det") > tolerance).drop("before"), "mcd-estimate")
        ended.append(after.where(~F.col("falls")).drop("falls"))
        estimate = after.where("falls").drop("falls")
        if estimate.isEmpty():
            break
    for part in ended:
        estimate = estimate.unionByName(part)
    kept = [c for c in estimate.columns if c not in ("group", "start", "det")]
    best = estimate.groupBy("group").agg(F.min_by(F.struct(*kept), F.struct("det", "start")).alias("best"))
    return materialize(best.select("group", "best.*"), "mcd-best")


def _grouped(rows: DataFrame, min_group: int, min_pool: int) -> DataFrame:
    """Adds ``group``: language and source, or for small groups their language's pool, or one pool of
    the rest; null if even that is too small."""
    own = F.concat_ws("|", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("null")), F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
    rows = rows.withColumns({"own": own, "pool": F.concat(F.lit("pool|"), F.coalesce(F.concat(F.lit("="), "lang"), F.lit("null")))})
    sizes = rows.groupBy("own", "pool").agg(F.count("*").alias("n"))
    small = sizes.withColumn("left_over", F.when(F.col("n") < min_group, F.col("n")).otherwise(F.lit(0)))
    pools = small.groupBy("pool").agg(F.sum("left_over").alias("pooled"))
    rest = pools.agg(F.sum(F.when(F.col("pooled") < min_group, F.col("pooled"))).alias("rest"))
    total = rest.first()["rest"] or 0
    chosen = small.join(pools, "pool").select("own", F.when(F.col("n") >= min_group, F.col("own")).when(
        F.col("pooled") >= min_group, F.col("pool")).when(F.lit(total >= min_pool), F.lit("rest")).alias("group"))
    return rows.join(materialize(chosen, "mcd-groups"), "own").drop("own", "pool")


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                     source_col: str = "source", min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT,
                     cutoff_probability: float = CUTOFF_PROBABILITY, min_group: int = MIN_GROUP,
                     min_pool: int = MIN_POOL, features: tuple[tuple[str, float], ...] = FEATURES) -> DataFrame:
    """One row per document: the statistics, base_failed, kept and the squared distance.

    A null text has no words and fails; null languages and sources are groups of their own; groups
    under ``min_group`` rows share their language's pool, pools under it one common pool, and
    with fewer than ``min_pool`` rows there nothing is rejected beyond the rules; repeated rows stay;
    an empty table gives an empty result; other columns are ignored. Estimates use the documents
    that pass the rules.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
                       F.col(source_col).cast("string").alias("source"), text_statistics(F.col(text_col)).alias("s"))
    rows = rows.select("doc_id", "lang", "source", "s.*")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    rows = materialize(rows.withColumn("base_failed", failed), "quality-statistics")
    shown = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    words = F.col("n_words").cast("double")
    passed = rows.where(~F.col("base_failed")).withColumns({
        "log_words": F.log1p(words), "log_word_length": F.log(F.col("word_chars") / words),
        "symbol_root": F.sqrt(F.col("n_symbols") / words), "line_root": F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        "repeat_root": F.sqrt(F.col("n_repeat_words") / words)})
    passed = materialize(_grouped(passed, min_group, min_pool).select(*shown, "group", *[n for n, _ in features]), "quality-passed")
    estimates = covariance_estimates(passed.where("group is not null"), features, steps=MOST_STEPS, starts=STARTS, tolerance=TOLERANCE)
    judged = _distance(passed.join(estimates, "group", "left"), [n for n, _ in features])
    cutoff = chi_square_quantile(cutoff_probability, len(features))
    judged = judged.select(*shown, F.coalesce(F.col("d2") <= cutoff, F.lit(True)).alias("kept"), F.col("d2").alias("distance2"))
    return judged.unionByName(rows.where("base_failed").select(
        *shown, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance2")))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document, default rules and estimates."""
    return quality_verdicts(read_table(spark, sf_dir, "documents"))
