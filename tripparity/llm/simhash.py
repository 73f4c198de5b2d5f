"""SimHash near-duplicate groups by a binary-trie self-join of the fingerprints.

The distinct 64-bit fingerprints form a binary trie. The join walks pairs of trie nodes from the
root down, adds up the bits in which the two paths differ and drops a pair as soon as it differs in
more than the budget. The top of the trie is walked as a table of node pairs, two bits a step, for
as long as a node of the pair holds more than ``node_size`` fingerprints; every lighter pair becomes
one unit of work whose two subtrees are walked inside a task. A unit never holds more than two
nodes' fingerprints, a fingerprint joins at most as many units as there are prefixes within the
budget, and the number of links of a fingerprint is bounded by the number of words within the
budget, so no group is ever expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripparity.llm.common import materialize, read_table, ready
from tripparity.llm.components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
NODE_SIZE = 4096
STEP = 2
BITS = 64
_HASH_BLOCK = 1 << 16
_PAIR_BLOCK = 1 << 19
_LEAF_PAIRS = 8


def simhash(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Fingerprint of UTF-8 ``text`` as a signed 64-bit integer; 0 for null or wordless text."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    rows = zip(*[words[i:] for i in range(shingle_words)]) if len(words) >= shingle_words else [words]
    ones, n, block = np.zeros(BITS, np.int64), 0, []

    def add() -> None:
        nonlocal ones
        bits = np.unpackbits(np.array(block, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = ones + bits.sum(axis=0, dtype=np.int64)

    digest, join = xxhash.xxh64_intdigest, b" ".join
    for row in rows:
        block.append(digest(join(row), SEED))
        if len(block) == _HASH_BLOCK:
            add()
            n += len(block)
            block = []
    if block:
        add()
        n += len(block)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """Signed 64-bit SimHash of a text column."""

    @F.pandas_udf("long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([simhash(t, shingle_words) for t in part], dtype="int64")

    return run(text.cast("binary"))


# ----------------------------------------------------------------------------- trie walk in a task


def _split(zeros: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return lo + zeros[hi] - zeros[lo]


def walk_pairs(xs: np.ndarray, ys: np.ndarray | None, depth: int, spent: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of fingerprints within ``budget`` differing bits.

    ``xs`` and ``ys`` are sorted distinct uint64 arrays, each under one trie node of ``depth`` bits
    whose paths differ in ``spent`` bits. ``ys`` None joins ``xs`` with itself (i < j only).
    """
    own = ys is None
    ys = xs if own else ys
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if not len(xs) or not len(ys) or spent > budget:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    one = np.ones(1, np.int64)
    stack = [(depth, 0 * one, len(xs) * one, 0 * one, len(ys) * one, spent * one, np.array([own]))]
    while stack:
        bit, xl, xh, yl, yh, e, same = stack.pop()
        few = (xh - xl) * (yh - yl) <= _LEAF_PAIRS
        if bit == BITS:
            few[:] = True
        if few.any():
            a, b, na, nb, s = xl[few], yl[few], (xh - xl)[few], (yh - yl)[few], same[few]
            for i in range(int(na.max())):
                for j in range(int(nb.max())):
                    at = (na > i) & (nb > j) & (~s | (i < j))
                    x, y = a[at] + i, b[at] + j
                    near = np.bitwise_count(xs[x] ^ ys[y]) <= budget
                    found.append((x[near], y[near]))
            keep = ~few
            xl, xh, yl, yh, e, same = xl[keep], xh[keep], yl[keep], yh[keep], e[keep], same[keep]
        if not len(xl):
            continue
        if len(xl) > _PAIR_BLOCK:  # depth first in blocks: the frontier stays small
            half = len(xl) // 2
            stack.append((bit, *(v[half:] for v in (xl, xh, yl, yh, e, same))))
            stack.append((bit, *(v[:half] for v in (xl, xh, yl, yh, e, same))))
            continue
        shift = np.uint64(BITS - 1 - bit)
        zx = np.concatenate(([0], np.cumsum((xs >> shift) & np.uint64(1) == 0)))
        zy = zx if own else np.concatenate(([0], np.cumsum((ys >> shift) & np.uint64(1) == 0)))
        xm, ym = _split(zx, xl, xh), _split(zy, yl, yh)
        no = np.zeros(len(xl), bool)
        parts = [(xl, xm, yl, ym, e, same), (xm, xh, ym, yh, e, same), (xl, xm, ym, yh, e + 1, no),
                 (xm, xh, yl, ym, np.where(same, budget + 1, e + 1), no)]
        xl, xh, yl, yh, e, same = (np.concatenate(v) for v in zip(*parts))
        live = (xl < xh) & (yl < yh) & (e <= budget)
        stack.append((bit + 1, xl[live], xh[live], yl[live], yh[live], e[live], same[live]))
    return np.concatenate([f[0] for f in found] or [np.empty(0, np.int64)]), \
        np.concatenate([f[1] for f in found] or [np.empty(0, np.int64)])


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index linked to each of n indices."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def unit_links(unit: pd.DataFrame, budget: int) -> pd.DataFrame:
    """Walks one unit's two subtrees; returns links (u, v) that span its groups."""
    depth, spent = int(unit["depth"].iloc[0]), int(unit["spent"].iloc[0])
    left = np.sort(unit.loc[unit["side"] == 0, "fp"].to_numpy().astype(np.int64).view(np.uint64))
    right = np.sort(unit.loc[unit["side"] == 1, "fp"].to_numpy().astype(np.int64).view(np.uint64))
    own = unit["a"].iloc[0] == unit["b"].iloc[0]
    i, j = walk_pairs(left, None if own else right, depth, spent, budget)
    both = left if own else np.concatenate([left, right])
    label = _forest(len(both), i, j if own else j + len(left))
    linked = np.flatnonzero(label != np.arange(len(both)))
    values = both.view(np.int64)
    return pd.DataFrame({"u": values[linked], "v": values[label[linked]]})


# ----------------------------------------------------------------------------- trie walk over tables


def _prefix(fp: Column, depth: int) -> Column:
    """The top ``depth`` bits as a number (0 bits: 0)."""
    return F.shiftrightunsigned(fp, BITS - depth) if depth else F.lit(0).cast("long")


def trie_units(fps: DataFrame, budget: int, node_size: int) -> list[tuple[int, DataFrame]]:
    """Node pairs of at most ``node_size`` fingerprints a side: (depth, table of a, b, spent)."""
    spark = fps.sparkSession
    heavy = spark.createDataFrame([(0, 0, 0)], "a long, b long, spent int")
    units: list[tuple[int, DataFrame]] = []
    if fps.count() <= node_size:
        return [(0, heavy)]
    for depth in range(STEP, BITS + 1, STEP):
        nodes = fps.groupBy(_prefix(F.col("fp"), depth).alias("node")).agg(F.count("*").alias("size"))
        nodes = materialize(nodes.withColumn("parent", F.shiftrightunsigned("node", STEP)), "simhash-nodes")
        first = nodes.select(F.col("parent").alias("a"), F.col("node").alias("na"), F.col("size").alias("sa"))
        second = nodes.select(F.col("parent").alias("b"), F.col("node").alias("nb"), F.col("size").alias("sb"))
        pairs = heavy.join(first, "a").join(second, "b").where("a < b or na <= nb") \
            .withColumn("spent", (F.col("spent") + F.bit_count(F.expr("(na ^ nb) & %d" % ((1 << STEP) - 1)))).cast("int")) \
            .where(F.col("spent") <= budget)
        large = (F.greatest("sa", "sb") > node_size) if depth < BITS else F.lit(False)
        pairs = materialize(pairs.select(F.col("na").alias("a"), F.col("nb").alias("b"), "spent", large.alias("large")),
                            "simhash-pairs")
        units.append((depth, pairs.where(~F.col("large")).drop("large")))
        heavy = pairs.where("large").drop("large")
        if heavy.isEmpty():
            break
    return units


def trie_links(fps: DataFrame, budget: int = MAX_BITS, node_size: int = NODE_SIZE) -> DataFrame:
    """Links (u, v) that span all groups of distinct fingerprints ``fps`` (fp) within ``budget`` bits."""
    rows = None
    for depth, units in trie_units(fps, budget, node_size):
        keyed = fps.select("fp", _prefix(F.col("fp"), depth).alias("node"))
        sides = [keyed.join(units.withColumnRenamed("a", "node").withColumn("a", F.col("node")), "node")
                 .withColumn("side", F.lit(0)),
                 keyed.join(units.where("a <> b").withColumnRenamed("b", "node").withColumn("b", F.col("node")), "node")
                 .withColumn("side", F.lit(1))]
        for side in sides:
            part = side.select(F.lit(depth).alias("depth"), "a", "b", "spent", "side", "fp")
            rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("depth", "a", "b").applyInPandas(lambda unit: unit_links(unit, budget), "u long, v long")


def group_table(prints: DataFrame, budget: int = MAX_BITS, node_size: int = NODE_SIZE) -> DataFrame:
    """(fp, root) for every distinct fingerprint of ``prints`` (fp): its group's representative."""
    ready(prints.sparkSession)
    fps = materialize(prints.select("fp").distinct(), "simhash-fps")
    linked = materialize(connected_components(trie_links(fps, budget, node_size)), "simhash-groups")
    return fps.join(linked.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS,
                    max_bits: int = MAX_BITS, node_size: int = NODE_SIZE) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most ``max_bits`` differing
    bits. Null and wordless texts have fingerprint zero and link like any other; a null id is
    ignored by the minimum (null only if the whole group has no id); repeated rows stay; an empty
    table gives an empty result; other columns are ignored.
    """
    ready(docs.sparkSession)
    prints = materialize(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), shingle_words).alias("fp")),
                         "simhash-prints")
    least = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-least")
    groups = materialize(group_table(prints, max_bits, node_size).join(least, "fp"), "simhash-members")
    of_group = materialize(groups.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-components")
    of_print = materialize(groups.join(of_group, "root").select("fp", "component_id"), "simhash-of-print")
    return prints.join(of_print, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                         node_size: int = NODE_SIZE) -> DataFrame:
    """Keeps one row of each near-duplicate group, the one with the smallest id (nulls last).

    All columns of ``docs`` are returned. Of repeated rows with the same smallest id one stays.
    """
    ready(docs.sparkSession)
    inner = {c: f"__in_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.withColumns({"__fp": fingerprint(F.col(text_col), shingle_words), "__row": F.monotonically_increasing_id()})
    rows = materialize(rows.withColumnsRenamed(inner), "simhash-rows")
    ids = rows.select(F.col(inner[id_col]).alias("id"), F.col("__fp").alias("fp"), F.col("__row").alias("row"))
    best = materialize(ids.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("best")),
                       "simhash-best")
    groups = group_table(ids, max_bits, node_size).join(best, "fp")
    kept = materialize(groups.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias("__row")),
                       "simhash-kept")
    # The same join at every size: a broadcast of the kept rows would have no bound.
    return rows.join(kept.hint("merge"), "__row", "left_semi").select([F.col(v).alias(k) for k, v in inner.items()])


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: 3-word shingles, at most 2 differing bits, all documents."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))
