"""Per-row SHAP contributions for the fare model, and global importance.

Tree ensembles (random forest, boosted trees) get exact path-dependent TreeSHAP. Each leaf of each
tree contributes a product game over the distinct features on its path: with ``z_j`` the share of
training cover that follows the path's conditions on feature j and ``o_j(x)`` whether x satisfies
them, ``v(S) = value * prod_{j in S} o_j * prod_{j not in S} z_j``. Its Shapley values depend on x only
through the d bits o_j, so a task computes them once per leaf for all 2^d patterns (d <= 9) and reads
a row's pattern off per-feature interval vectors: one look-up a leaf, however deep the tree, and once for all
rows that a tree's thresholds do not tell apart. The leaf
table is derived from the model a bounded block at a time and shipped to tasks; rows are explained in
large Arrow batches by ``mapInPandas``, so work scales with partitions.

Linear models get the closed form ``coef * (x - mean(x))`` as plain column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.regression import (GBTRegressionModel, LinearRegressionModel,
                                   RandomForestRegressionModel)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tripparity.operators.boosting import BoostedTrees
from tripparity.operators.vector import FEATURE_NAMES
from tripparity.session import scratch_path, ship_package

SHAP_PREFIX = "shap_"
BLOCK_NODES = 500_000  # of trees explained at once: at most half are leaves, under 100 MB of leaf table

# Six representative trips, the default sample for global importance.
REFERENCE_TRIPS = (
    (1.2, 1, 48, 68, 8, 0, 1, 0, 1),
    (4.5, 2, 132, 236, 13, 0, 1, 0, 0),
    (12.0, 1, 138, 161, 17, 4, 6, 0, 1),
    (0.8, 4, 79, 232, 23, 5, 12, 1, 0),
    (25.0, 1, 132, 1, 6, 2, 7, 0, 0),
    (3.0, 3, 161, 234, 19, 6, 3, 1, 0),
)


def reference_trips(spark: SparkSession) -> DataFrame:
    schema = ", ".join(f"{n} double" for n in FEATURE_NAMES)
    return spark.createDataFrame([tuple(float(v) for v in row) for row in REFERENCE_TRIPS], schema)


# ----------------------------------------------------------------------------- leaf-path table

@dataclass
class LeafGroup:
    """All leaves whose path tests exactly ``d`` distinct features."""
    d: int
    features: np.ndarray   # (L, d) int feature indices
    lower: np.ndarray      # (L, d) exclusive lower bounds
    upper: np.ndarray      # (L, d) inclusive upper bounds
    zero: np.ndarray       # (L, d) cover fraction following the path's conditions per feature
    value: np.ndarray      # (L,) tree weight x leaf prediction
    tree: np.ndarray | None = None  # (L,) the leaf's tree, if known

    def take(self, which) -> LeafGroup:
        rest = (self.features, self.lower, self.upper, self.zero, self.value)
        return LeafGroup(self.d, *(a[which] for a in rest), None if self.tree is None else self.tree[which])


@dataclass
class LeafTable:
    groups: list[LeafGroup]
    base_value: float
    n_features: int

    @property
    def leaves(self) -> int:
        return sum(len(g.value) for g in self.groups)


def _saved_trees(spark: SparkSession, model) -> DataFrame:
    """Node table of a tree ensemble, read back from the model's own persisted form."""
    if isinstance(model, BoostedTrees):
        return model.node_frame(spark)
    path = scratch_path(spark, "tree-model")
    model.write().overwrite().save(path)
    return spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", F.coalesce(F.try_element_at("nodeData.impurityStats", F.lit(1)),
                                                      F.col("nodeData.rawCount").cast("double")).alias("cover"),
        "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex",
        F.try_element_at("nodeData.split.leftCategoriesOrThreshold", F.lit(1)).alias("threshold"),
        "nodeData.split.numCategories")


def leaf_tables(spark: SparkSession, model, n_features: int = len(FEATURE_NAMES), block_nodes: int = BLOCK_NODES):
    """The ensemble's leaf tables, in blocks of about ``block_nodes`` nodes.

    Contributions of leaves add up, so a model of any size is explained exactly while a broadcast
    holds one block; the driver holds the nodes of a block of whole trees, or of one larger tree.
    """
    if isinstance(model, PipelineModel):
        model = model.stages[-1]
    saved = _saved_trees(spark, model)
    sizes = sorted((r["treeID"], r["count"]) for r in saved.groupBy("treeID").count().collect())
    blocks: list[list[int]] = [[]]
    held = 0
    for tree, nodes in sizes:
        if blocks[-1] and held + nodes > block_nodes:
            blocks.append([])
            held = 0
        blocks[-1].append(tree)
        held += nodes
    for number, block in enumerate(b for b in blocks if b):
        table = _leaves(saved.where(F.col("treeID").between(block[0], block[-1])), _tree_weights(model), n_features)
        if number == 0:
            table.base_value += getattr(model, "init", 0.0)
        yield from _cut(table, block_nodes)


def _cut(table: LeafTable, most: int):
    """Parts of at most ``most`` leaves; the first carries the base value."""
    parts = [LeafTable([], table.base_value, table.n_features)]
    for g in table.groups:
        at = 0
        while at < len(g.value):
            if parts[-1].leaves >= most:
                parts.append(LeafTable([], 0.0, table.n_features))
            take = slice(at, at + most - parts[-1].leaves)
            parts[-1].groups.append(g.take(take))
            at = take.stop
    return parts


def leaf_table(spark: SparkSession, model, n_features: int = len(FEATURE_NAMES)) -> LeafTable:
    """M10 preparation: one row per leaf with per-feature bounds and cover fractions, of all trees."""
    if isinstance(model, PipelineModel):
        model = model.stages[-1]
    return _leaves(_saved_trees(spark, model), _tree_weights(model), n_features)


def _tree_weights(model) -> list[float]:
    if isinstance(model, RandomForestRegressionModel):
        return [1.0 / model.getNumTrees] * model.getNumTrees
    if isinstance(model, GBTRegressionModel):
        return list(model.treeWeights)
    if isinstance(model, BoostedTrees):
        return [1.0] * len(model.trees)
    raise TypeError(f"TreeSHAP needs a tree ensemble, got {type(model).__name__}")


def _leaves(saved: DataFrame, weights: list[float], n_features: int) -> LeafTable:
    """Walks all trees of the node table together, one level at a time."""
    nodes = saved.orderBy("treeID", "id").toPandas()
    if (nodes["numCategories"].fillna(0) > 0).any():
        raise ValueError("categorical splits are not supported")
    tree, node = nodes["treeID"].to_numpy(np.int64), nodes["id"].to_numpy(np.int64)
    prediction, cover = nodes["prediction"].to_numpy(float), nodes["cover"].to_numpy(float)
    stride = int(node.max(initial=0)) + 1
    keys = tree * stride + node  # sorted
    left, right = (np.searchsorted(keys, tree * stride + nodes[c].to_numpy(np.int64)) for c in ("leftChild", "rightChild"))
    split = nodes["leftChild"].to_numpy(np.int64) >= 0
    feature, threshold = nodes["featureIndex"].fillna(0).to_numpy(np.int64), nodes["threshold"].to_numpy(float)

    at = np.flatnonzero(node == 0)
    start = (len(at), n_features)
    lower, upper, zero, used = np.full(start, -np.inf), np.full(start, np.inf), np.ones(start), np.zeros(start, bool)
    base, found = 0.0, []
    roots = dict(zip(tree[at].tolist(), cover[at].tolist()))
    while len(at):
        ends = ~split[at]
        leaf = at[ends]
        value = np.array([weights[t] for t in tree[leaf]]) * prediction[leaf]
        base += float(sum(value * cover[leaf] / np.array([roots[t] for t in tree[leaf]])))
        found.append((lower[ends], upper[ends], zero[ends], used[ends], value, tree[leaf]))
        at, lower, upper, zero, used = (v[~ends] for v in (at, lower, upper, zero, used))
        sides = []
        for child, goes_left in ((left[at], True), (right[at], False)):
            low, high, z, u = lower.copy(), upper.copy(), zero.copy(), used.copy()
            rows, f = np.arange(len(at)), feature[at]
            if goes_left:
                high[rows, f] = np.minimum(high[rows, f], threshold[at])
            else:
                low[rows, f] = np.maximum(low[rows, f], threshold[at])
            z[rows, f] *= np.divide(cover[child], cover[at], out=np.zeros(len(at)), where=cover[at] > 0)
            u[rows, f] = True
            sides.append((child, low, high, z, u))
        at, lower, upper, zero, used = (np.concatenate(pair) for pair in zip(*sides))

    lower, upper, zero, used, value, owner = (np.concatenate(part) for part in zip(*found)) if found else (
        lower, upper, zero, used, np.zeros(0), np.zeros(0, np.int64))
    groups = []
    for d in range(1, n_features + 1):  # a tree of one leaf only shifts the base value
        mine = used.sum(axis=1) == d
        if mine.any():
            features = np.nonzero(used[mine])[1].reshape(-1, d)
            pick = [np.take_along_axis(a[mine], features, axis=1) for a in (lower, upper, zero)]
            groups.append(LeafGroup(d, features, *pick, value[mine], owner[mine]))
    return LeafTable(groups, base, n_features)


# ----------------------------------------------------------------------------- Shapley kernel

def pattern_tables(zero: np.ndarray, value: np.ndarray) -> np.ndarray:
    """(L, 2^d, d): every leaf's contributions for every pattern of fulfilled path features.

    The Shapley weight of k features before i is the integral of u^k (1-u)^(d-1-k), so the weighted sum
    over all orders is the integral over u of prod_{j != i} (z_j (1-u) + o_j u): a polynomial of degree
    d - 1, which Gauss-Legendre nodes integrate exactly. Bit j of the pattern is o_j.
    """
    n_leaves, d = zero.shape
    nodes, weights = np.polynomial.legendre.leggauss((d + 1) // 2)
    u, weights = (nodes + 1) / 2, weights / 2
    miss = zero[:, :, None] * (1 - u)  # (L, d, nodes)
    out = np.empty((n_leaves, 2 ** d, d))
    for i in range(d):
        product = np.ones((n_leaves, 1, len(u)))
        for j in range(d):
            if j != i:
                product = np.concatenate([product * miss[:, None, j], product * (miss[:, None, j] + u)], axis=1)
        rest = ((product @ weights) * value[:, None]).reshape(n_leaves, 2 ** (d - 1 - i), 2 ** i)
        by_bit = out.reshape(n_leaves, 2 ** (d - 1 - i), 2, 2 ** i, d)
        by_bit[:, :, 0, :, i] = -zero[:, i, None, None] * rest
        by_bit[:, :, 1, :, i] = (1 - zero[:, i, None, None]) * rest
    return out


def interval_bits(group: LeafGroup, n_features: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(feature, edges, bits): bits[r] holds, for every leaf, the pattern bit that values in the r-th
    interval between the edges (the upper one included) set."""
    out = []
    for f in range(n_features):
        leaf, place = np.nonzero(group.features == f)
        if not len(leaf):
            continue
        low, high = group.lower[leaf, place], group.upper[leaf, place]
        edges = np.unique(np.concatenate([low, high]))
        edges = edges[np.isfinite(edges)]
        first, last = np.searchsorted(edges, low, side="right"), np.searchsorted(edges, high, side="left")
        r = np.arange(len(edges) + 1)[:, None]
        bits = np.zeros((len(edges) + 1, len(group.value)), np.int16)
        bits[:, leaf] = ((r >= first) & (r <= last)).astype(np.int16) << place.astype(np.int16)
        out.append((f, edges, bits))
    return out


def _look_up(table: LeafTable, x: np.ndarray, leaves: int, cells: int) -> np.ndarray:
    """Contributions of all leaves, row by row.

    A chunk of leaves at a time: the row's intervals give each leaf's pattern, the pattern its row in
    the leaf's table, so a row costs one look-up a leaf. Not a number goes right at every split, as in
    the model: it sorts behind every edge, where only unbounded leaves are fulfilled.
    """
    phi = np.zeros((len(x), table.n_features))
    for whole in table.groups:
        if whole.d > 12:
            raise ValueError("a leaf's table has 2^d rows; at most 12 features on a path")
        for start in range(0, len(whole.value), leaves):
            take = slice(start, start + leaves)
            g = whole.take(take)
            size = 2 ** g.d
            tables = np.zeros((len(g.value), size, table.n_features))
            np.put_along_axis(tables, np.broadcast_to(g.features[:, None, :], (len(g.value), size, g.d)), pattern_tables(g.zero, g.value), axis=2)
            tables = tables.reshape(-1, table.n_features)
            offsets = np.arange(len(g.value)) * size
            vectors = interval_bits(g, table.n_features)
            places = [np.searchsorted(edges, x[:, f]) for f, edges, _ in vectors]
            step = max(1, cells // (len(g.value) * table.n_features))
            for at in range(0, len(x), step):
                pattern = sum(bits[place[at:at + step]] for (_, _, bits), place in zip(vectors, places))
                phi[at:at + step] += tables[pattern + offsets].sum(axis=1)
    return phi


def _edges(groups: list[LeafGroup], f: int) -> np.ndarray:
    bounds = [a[g.features == f] for g in groups for a in (g.lower, g.upper)]
    edges = np.unique(np.concatenate(bounds)) if bounds else np.zeros(0)
    return edges[np.isfinite(edges)]


def shap_values(table: LeafTable, x: np.ndarray, leaves: int = 256, cells: int = 1_000_000) -> np.ndarray:
    """Contributions (n, n_features) for rows ``x`` (n, n_features); base value not included.

    A tree's contributions depend on a row only through the cell that its thresholds put the row in. Where many rows share
    a tree's cells one row of each is explained and the others get its values; all other trees are looked up row by row.
    """
    if not len(x) or any(g.tree is None for g in table.groups):
        return _look_up(table, x, leaves, cells)
    phi, apart = np.zeros((len(x), table.n_features)), []
    edges = [_edges(table.groups, f) for f in range(table.n_features)]
    codes = [np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)]
    for tree in np.unique(np.concatenate([g.tree for g in table.groups])) if table.groups else ():
        own = LeafTable([g.take(mine) for g in table.groups if (mine := g.tree == tree).any()], 0.0, table.n_features)
        cell, size = np.zeros(len(x), np.int64), 1
        for f, (all_, code) in enumerate(zip(edges, codes)):
            mine = _edges(own.groups, f)
            if len(mine) and size <= CELLS_OF_A_TREE:
                cell += (size * np.searchsorted(mine, np.r_[-np.inf, all_], side="right"))[code]
                size *= len(mine) + 1
        if size > CELLS_OF_A_TREE:
            apart.append(tree)
            continue
        first = np.full(size, -1, np.int64)
        first[cell] = np.arange(len(x))
        rows = first[first >= 0]
        if 2 * len(rows) > len(x):
            apart.append(tree)
            continue
        first[first >= 0] = np.arange(len(rows))
        phi += _look_up(own, x[rows], leaves, cells)[first[cell]]
    rest = [g.take(mine) for g in table.groups if (mine := np.isin(g.tree, apart)).any()]
    return phi + _look_up(LeafTable(rest, 0.0, table.n_features), x, leaves, cells) if rest else phi


CELLS_OF_A_TREE = 1 << 20  # for which rows are brought together
ROWS_AT_ONCE = 1 << 16  # rows that share the pattern tables of a block


def explain_trees(df: DataFrame, model, keep: tuple[str, ...] = (), prefix: str = "",
                  block_nodes: int = BLOCK_NODES, partitions: int | None = None) -> DataFrame:
    """Keep columns, the nine feature values, ``base_value``, the explained prediction
    (base + sum of contributions) and one ``shap_<feature>`` column per feature.

    The model is applied block by block; between blocks the sums so far are written to the shared
    folder. ``partitions`` spreads the rows over that many tasks; unless given, rows in fewer parts than
    there are cores are dealt to all cores, as a row costs a look-up a leaf.
    """
    spark = df.sparkSession
    ship_package(spark)
    rows = df.select(*keep, *[F.col(f"{prefix}{n}").cast("double").alias(n) for n in FEATURE_NAMES])
    cores = spark.sparkContext.defaultParallelism
    if not partitions and rows.rdd.getNumPartitions() < cores:
        partitions = cores
    rows = rows.repartition(partitions) if partitions else rows
    sums = ["base_value", "predicted_fare_amount", *[f"{SHAP_PREFIX}{n}" for n in FEATURE_NAMES]]
    schema = StructType([f for f in rows.schema.fields if f.name not in FEATURE_NAMES]
                        + [StructField(c, DoubleType()) for c in (*FEATURE_NAMES, *sums)])
    rows = rows.select("*", *[F.lit(0.0).alias(c) for c in sums])
    for number, table in enumerate(leaf_tables(spark, model, block_nodes=block_nodes)):
        if number:
            path = scratch_path(spark, "explained")
            rows.write.parquet(path)
            rows = spark.read.schema(schema).parquet(path)
        rows = rows.mapInPandas(_adder(spark.sparkContext.broadcast(table)), schema)
    return rows


def _gathered(batches):
    """Arrow batches put together, so that many rows share the tables built for them."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        held.append(pdf)
        if sum(map(len, held)) >= ROWS_AT_ONCE:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def _adder(shipped):
    """Adds one block's base value and contributions to the sums of every row."""

    def run(batches):
        leaves = shipped.value
        for pdf in _gathered(batches):
            phi = shap_values(leaves, pdf[list(FEATURE_NAMES)].to_numpy(dtype=np.float64))
            pdf["base_value"] += leaves.base_value
            pdf["predicted_fare_amount"] += leaves.base_value + phi.sum(axis=1)
            for i, name in enumerate(FEATURE_NAMES):
                pdf[f"{SHAP_PREFIX}{name}"] += phi[:, i]
            yield pdf

    return run


# ----------------------------------------------------------------------------- linear

def explain_linear(df: DataFrame, model, means: dict[str, float], keep: tuple[str, ...] = (),
                   prefix: str = "") -> DataFrame:
    """M13 for a fitted linear model."""
    if isinstance(model, PipelineModel):
        model = model.stages[-1]
    if not isinstance(model, LinearRegressionModel):
        raise TypeError("explain_linear needs a LinearRegressionModel")
    coefficients = {n: float(c) for n, c in zip(FEATURE_NAMES, model.coefficients)}
    return explain_coefficients(df, coefficients, float(model.intercept), means, keep, prefix)


def explain_coefficients(df: DataFrame, coefficients: dict[str, float], intercept: float,
                         means: dict[str, float], keep: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """Contributions ``coef_j * (x_j - mean_j)``; base = intercept + sum coef_j * mean_j."""
    coef = [float(coefficients.get(n, 0.0)) for n in FEATURE_NAMES]
    base = float(intercept) + sum(c * means[n] for c, n in zip(coef, FEATURE_NAMES))
    x = {n: F.col(f"{prefix}{n}").cast("double") for n in FEATURE_NAMES}
    contribs = {n: (F.lit(c) * (x[n] - F.lit(means[n]))) if c != 0.0 else F.lit(0.0)
                for c, n in zip(coef, FEATURE_NAMES)}
    total = F.lit(base)
    for c in contribs.values():
        total = total + c
    return df.select(*keep, *[x[n].alias(n) for n in FEATURE_NAMES], F.lit(base).alias("base_value"),
                     total.alias("predicted_fare_amount"),
                     *[contribs[n].alias(f"{SHAP_PREFIX}{n}") for n in FEATURE_NAMES])


def explain(df: DataFrame, model, means: dict[str, float] | None = None, keep: tuple[str, ...] = (),
            prefix: str = "") -> DataFrame:
    """Dispatch on the model type."""
    inner = model.stages[-1] if isinstance(model, PipelineModel) else model
    if isinstance(inner, LinearRegressionModel):
        if means is None:
            raise ValueError("linear explanations need the training means")
        return explain_linear(df, inner, means, keep, prefix)
    return explain_trees(df, model, keep, prefix)


# ----------------------------------------------------------------------------- views and A13

def contributions_long(explained: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """D10 as rows: (keep..., feature, value, shap_value) in feature order."""
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value"),
                              F.col(f"{SHAP_PREFIX}{n}").alias("shap_value")) for n in FEATURE_NAMES])
    return explained.select(*keep, "base_value", "predicted_fare_amount", F.inline(rows))


def global_importance(explained: DataFrame, group_by: tuple[str, ...] = ()) -> DataFrame:
    """Mean absolute contribution per feature, one aggregate then a 9-row unpivot."""
    aggs = [F.avg(F.abs(F.col(f"{SHAP_PREFIX}{n}"))).alias(f"i{k}") for k, n in enumerate(FEATURE_NAMES)]
    aggs.append(F.count(F.lit(1)).alias("rows"))
    wide = explained.groupBy(*group_by).agg(*aggs) if group_by else explained.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"i{k}").alias("importance"))
                     for k, n in enumerate(FEATURE_NAMES)])
    return wide.select(*group_by, "rows", F.inline(rows))


def importance_map(importance: DataFrame) -> DataFrame:
    """The D11 shape: one ``map<feature, importance>`` per group."""
    return importance.groupBy(*[c for c in importance.columns if c not in ("feature", "importance", "rows")]) \
        .agg(F.map_from_entries(F.collect_list(F.struct("feature", "importance"))).alias("feature_importance"))
