"""M4 in the reference's shape: L1 boosting of best-first trees with a bounded number of leaves.

Features are cut into at most ``bins`` bins at exact order statistics. A tree grows by the leaf with
the greatest gain; the candidates' histograms (rows and gradient sums by leaf, feature and bin) are
grouped sums over all rows, for all leaves that best-first growth would take next at once, so a tree
takes about as many passes as it is deep. Each leaf's value is the exact median of its residuals, by
radix selection. Only best splits and medians reach the driver.

The rows stand in a written table of bins, target and score that is rewritten after every round, so a
pass evaluates one tree only and any job can be rerun after the loss of an executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripparity.functions.arrays import sql_double
from tripparity.functions.numeric import ordered_key
from tripparity.operators import drift
from tripparity.operators.vector import FEATURE_NAMES
from tripparity.session import delete_path, scratch_path

LEAST_GAIN = 1e-7
NODE_COLUMNS = ("treeID int, id int, prediction double, cover double, leftChild int, rightChild int, featureIndex int, "
                "threshold double, numCategories int")


@dataclass(frozen=True)
class BoostingConfig:
    rounds: int = 300
    rate: float = 0.05
    leaves: int = 31
    least_rows: int = 20  # of a leaf
    bins: int = 255


@dataclass
class Node:
    """A node by its path of 0 (left) and 1 (right); ``split`` is (feature, bin, rows on the left), None if there is none."""

    rows: int
    examined: bool = False
    gain: float = 0.0
    split: tuple[int, int, int] | None = None
    value: float = 0.0


@dataclass
class BoostedTrees:
    init: float
    edges: list[list[float]]
    columns: tuple[str, ...] = FEATURE_NAMES
    trees: list[dict[str, Node]] = field(default_factory=list)  # nodes of the grown tree; leaves have no split

    def node_rows(self) -> list[tuple]:
        """Rows of NODE_COLUMNS, ids in order of length and path."""
        out = []
        for number, nodes in enumerate(self.trees):
            ids = {path: i for i, path in enumerate(sorted(nodes, key=lambda p: (len(p), p)))}
            for path, i in ids.items():
                node = nodes[path]
                inner = node.split is not None
                out.append((number, i, node.value, float(node.rows), ids[path + "0"] if inner else -1, ids[path + "1"] if inner else -1,
                            node.split[0] if inner else -1, self.edges[node.split[0]][node.split[1]] if inner else 0.0, None))
        return out

    def node_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.node_rows(), NODE_COLUMNS)

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """``df`` with the model's score of its feature columns; not a number goes right at every split."""
        init = self.init
        tables = []
        for _, part in pd.DataFrame(self.node_rows(), columns=[c.split()[0] for c in NODE_COLUMNS.split(", ")]).groupby("treeID"):
            tables.append(tuple(part[c].to_numpy() for c in ("leftChild", "rightChild", "featureIndex", "threshold", "prediction")))

        @F.pandas_udf("double")
        def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for part in parts:
                x = np.column_stack([np.asarray(c, dtype=float) for c in part])
                total, rows = np.full(len(x), init), np.arange(len(x))
                for left, right, feature, threshold, value in tables:
                    at = np.zeros(len(x), np.int64)
                    while (left[at] >= 0).any():
                        go = x[rows, feature[at]] <= threshold[at]
                        at = np.where(left[at] >= 0, np.where(go, left[at], right[at]), at)
                    total += value[at]
                yield pd.Series(total)

        return df.withColumn(output, run(*[F.col(c).cast("double") for c in self.columns]))


# ----------------------------------------------------------------------------- growth

def best_first(nodes: dict[str, Node], leaves: int) -> dict[str, Node]:
    """The tree that takes the split of greatest gain until it has ``leaves`` leaves (ties: the smaller path).

    Leaves without a histogram yet count as unsplit; children of taken splits are entered into ``nodes``.
    """
    tree = {"": nodes[""]}
    open_ = {""}
    while len(open_) < leaves:
        ready = [p for p in open_ if nodes[p].split is not None]
        if not ready:
            break
        path = min(ready, key=lambda p: (-nodes[p].gain, p))
        left = nodes[path].split[2]
        open_.remove(path)
        for side, rows in (("0", left), ("1", nodes[path].rows - left)):
            tree[path + side] = nodes.setdefault(path + side, Node(rows))
            open_.add(path + side)
    return tree


def _case(tree: dict[str, Node], leaf, path: str = "") -> str:
    """SQL text that walks the tree over the bins b0, b1, ... and gives ``leaf(path)``."""
    if path + "0" not in tree:
        return leaf(path)
    f, b, _ = tree[path].split
    return f"CASE WHEN b{f} <= {b} THEN {_case(tree, leaf, path + '0')} ELSE {_case(tree, leaf, path + '1')} END"


def best_splits(rows: DataFrame, n_features: int, least_rows: int) -> DataFrame:
    """Per ``node`` of (node, g, b0, ...): the split with the greatest gain (ties: smaller feature, then bin).

    Gains are differences of gradient sum squared over rows; windows hold one node's bins of one feature.
    """
    bins = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"b{f}").alias("bin")) for f in range(n_features)])
    sums = rows.select("node", "g", F.explode(bins).alias("at")).groupBy("node", "at.f", "at.bin") \
        .agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("g").alias("s"))
    upto = Window.partitionBy("node", "f").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("node", "f")
    sides = sums.select("node", "f", "bin", F.sum("n").over(upto).alias("n0"), F.sum("s").over(upto).alias("s0"),
                        F.sum("n").over(whole).alias("n"), F.sum("s").over(whole).alias("s")) \
        .where((F.col("n0") >= least_rows) & (F.col("n") - F.col("n0") >= least_rows))
    gained = sides.withColumn("gain", F.expr("s0 * s0 / n0 + (s - s0) * (s - s0) / (n - n0) - s * s / n"))
    return gained.where(F.col("gain") > LEAST_GAIN).groupBy("node").agg(
        F.max(F.struct("gain", (-F.col("f")).alias("f"), (-F.col("bin")).alias("bin"), F.col("n0").cast("long").alias("n0"))).alias("best"))


def grow_tree(rows: DataFrame, n: int, n_features: int, config: BoostingConfig) -> dict[str, Node]:
    """Best-first tree over (g, b0, ...); leaf values stay 0."""
    nodes = {"": Node(n)}
    while True:
        tree = best_first(nodes, config.leaves)
        asked = sorted(p for p, node in tree.items() if not node.examined and p + "0" not in tree)
        if not asked:
            return {p: node if p + "0" in tree else Node(node.rows, True) for p, node in tree.items()}
        number = {p: i for i, p in enumerate(asked)}
        # Nodes with too few rows for two leaves need no histogram.
        node = _case(tree, lambda p: str(number[p]) if p in number and nodes[p].rows >= 2 * config.least_rows else "CAST(NULL AS INT)")
        placed = rows.withColumn("node", F.expr(node)).where("node IS NOT NULL")
        found = {r["node"]: r["best"] for r in best_splits(placed, n_features, config.least_rows).collect()}
        for p, i in number.items():
            nodes[p].examined = True
            if i in found:
                nodes[p].gain, nodes[p].split = found[i]["gain"], (-found[i]["f"], -found[i]["bin"], found[i]["n0"])


def medians(values: DataFrame, sizes: dict[int, int]) -> dict[int, float]:
    """Median of x in each group f of (f, x); ``sizes`` are the groups' rows."""
    ranks = {f: {(n - 1) // 2, n // 2} for f, n in sizes.items() if n}
    found = drift.select_ranks(values.withColumn("key", ordered_key("x")), ranks)
    return {f: (found[f, (n - 1) // 2] + found[f, n // 2]) / 2 for f, n in sizes.items() if n}


def _bin_case(column: str, edges: list[float], low: int = 0) -> str:
    """How many edges lie below the value, by halving; not a number lies above all."""
    if not edges:
        return str(low)
    half = len(edges) // 2
    return (f"CASE WHEN `{column}` <= {sql_double(edges[half])} THEN {_bin_case(column, edges[:half], low)} "
            f"ELSE {_bin_case(column, edges[half + 1:], low + half + 1)} END")


def fit_boosted(train: DataFrame, label: str = "fare_amount", config: BoostingConfig = BoostingConfig(),
                columns: tuple[str, ...] = FEATURE_NAMES) -> BoostedTrees:
    """Fits on every row of ``train``; null or non-finite labels or features raise, as does an empty table."""
    spark = train.sparkSession
    folder = scratch_path(spark, "boosting")
    given = train.select(*[F.col(c).cast("double").alias(f"x{f}") for f, c in enumerate(columns)], F.col(label).cast("double").alias("y"))
    given.write.parquet(f"{folder}/given")
    given = spark.read.schema(given.schema).parquet(f"{folder}/given")
    names = [f"x{f}" for f in range(len(columns))]
    bad = [F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in (*names, "y")]
    state = given.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(b).alias(f"bad{i}") for i, b in enumerate(bad)]).first()
    n = state["n"]
    if not n:
        raise ValueError("boosting needs at least one row")
    if any(state[f"bad{i}"] for i in range(len(bad))):
        raise ValueError("boosting needs finite labels and features: " + ", ".join(
            c for i, c in enumerate((*columns, label)) if state[f"bad{i}"]))

    ranks = {i * n // config.bins for i in range(1, config.bins)}
    cut = drift.order_statistics(given, tuple(names), {f: ranks for f in range(len(names))})
    edges = [sorted({cut[f, r] + 0.0 for r in ranks}) for f in range(len(names))]
    init = medians(given.select(F.lit(0).alias("f"), F.col("y").alias("x")), {0: n})[0]
    model = BoostedTrees(init, edges, columns)

    binned = given.select("y", *[F.expr(_bin_case(f"x{f}", e)).alias(f"b{f}") for f, e in enumerate(edges)], F.lit(init).alias("score"))
    binned.write.parquet(f"{folder}/0")
    rows = spark.read.schema(binned.schema).parquet(f"{folder}/0")
    for number in range(1, config.rounds + 1):
        now = rows.select("*", (F.col("y") - F.col("score")).alias("left"))
        tree = grow_tree(now.withColumn("g", -F.signum("left")), n, len(columns), config)
        leaves = sorted(p for p in tree if p + "0" not in tree)
        place = F.expr(_case(tree, lambda p: str(leaves.index(p))))
        middle = medians(now.select(place.alias("f"), F.col("left").alias("x")), {i: tree[p].rows for i, p in enumerate(leaves)})
        for i, p in enumerate(leaves):
            tree[p].value = config.rate * middle.get(i, 0.0)
        model.trees.append(tree)
        step = F.expr(_case(tree, lambda p: sql_double(tree[p].value)))
        rows.withColumn("score", F.col("score") + step).write.parquet(f"{folder}/{number}")
        delete_path(spark, f"{folder}/{number - 1}")
        rows = spark.read.schema(binned.schema).parquet(f"{folder}/{number}")
    delete_path(spark, folder)
    return model
