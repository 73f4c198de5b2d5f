"""TreeSHAP: additivity against MLlib predictions and brute-force Shapley values; linear SHAP."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tripparity.operators import explain, models
from tripparity.operators.vector import FEATURE_NAMES
from tripparity.plans import catalog

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def table(spark):
    return models.feature_frame(catalog.training_table(spark, SF_SMALL), keep=("trip_id",)).cache()


def _tree_nodes(spark, model):
    trees = {}
    for r in explain._saved_trees(spark, model).collect():
        trees.setdefault(r["treeID"], {})[r["id"]] = (r["prediction"], r["cover"], r["leftChild"], r["rightChild"], r["featureIndex"], r["threshold"])
    return trees


def _polynomial_values(table, x):
    """Contributions leaf by leaf and row by row, from the coefficients of prod_j (z_j + o_j t) without factor i."""
    phi = np.zeros((len(x), table.n_features))
    for g in table.groups:
        weights = [math.factorial(k) * math.factorial(g.d - 1 - k) / math.factorial(g.d) for k in range(g.d)]
        for features, low, high, zero, value in zip(g.features, g.lower, g.upper, g.zero, g.value):
            for r, row in enumerate(x):
                ones = [float(not v <= a and (v <= b or b == math.inf)) for v, a, b in zip(row[features], low, high)]
                for i, f in enumerate(features):
                    poly = np.array([1.0])
                    for j in range(g.d):
                        if j != i:
                            poly = np.convolve(poly, [zero[j], ones[j]])
                    phi[r, f] += value * (ones[i] - zero[i]) * (poly @ weights)
    return phi


@pytest.mark.parametrize("seed", range(4))
def test_pattern_tables_equal_the_polynomials(seed):
    """Random leaves with 1 to 9 features, empty branches, shared edges, values on edges and no numbers."""
    rng = np.random.default_rng(seed)
    groups = []
    for d in range(1, 10):
        features = np.array([np.sort(rng.permutation(9)[:d]) for _ in range(7)])
        lower, upper = rng.integers(0, 4, (7, d)).astype(float), rng.integers(4, 8, (7, d)).astype(float)
        lower[rng.random((7, d)) < 0.4], upper[rng.random((7, d)) < 0.4] = -np.inf, np.inf
        zero = np.where(rng.random((7, d)) < 0.1, 0.0, rng.random((7, d)))
        groups.append(explain.LeafGroup(d, features, lower, upper, zero, rng.normal(size=7)))
    table = explain.LeafTable(groups, 0.0, 9)
    x = rng.integers(-1, 9, (30, 9)).astype(float)
    x[rng.random(x.shape) < 0.05] = np.nan
    want = _polynomial_values(table, x)
    assert np.abs(explain.shap_values(table, x) - want).max() < 1e-12
    assert np.abs(explain.shap_values(table, x, leaves=3, cells=100) - want).max() < 1e-12
    parts = explain._cut(table, 5)
    assert len(parts) == 13 and all(p.leaves <= 5 for p in parts)
    assert np.abs(sum(explain.shap_values(p, x) for p in parts) - want).max() < 1e-12


def _brute_force(spark, model, x):
    inner = model.stages[-1]
    trees = _tree_nodes(spark, inner)
    weights = list(inner.treeWeights)
    if "Forest" in type(inner).__name__:
        weights = [1 / len(trees)] * len(trees)

    def expected(nodes, s, node=0):
        pred, cover, left, right, feat, thr = nodes[node]
        if left < 0:
            return pred
        if feat in s:
            return expected(nodes, s, left if x[feat] <= thr else right)
        return (nodes[left][1] * expected(nodes, s, left) + nodes[right][1] * expected(nodes, s, right)) / cover

    def value(s):
        return sum(w * expected(trees[t], s) for t, w in zip(sorted(trees), weights))

    p = len(FEATURE_NAMES)
    phi = np.zeros(p)
    for i in range(p):
        others = [k for k in range(p) if k != i]
        for r in range(p):
            for s in itertools.combinations(others, r):
                w = math.factorial(r) * math.factorial(p - r - 1) / math.factorial(p)
                phi[i] += w * (value(set(s) | {i}) - value(set(s)))
    return phi, value(set())


@pytest.mark.parametrize("make", [
    lambda: GBTRegressor(labelCol="fare_amount", maxIter=8, maxDepth=3, lossType="absolute", stepSize=0.1, seed=3),
    lambda: RandomForestRegressor(labelCol="fare_amount", numTrees=4, maxDepth=4, seed=3),
])
def test_tree_shap_is_exact(spark, table, make):
    model = Pipeline(stages=[models.assembler(), make()]).fit(table)
    explained = explain.explain_trees(table, model, keep=("trip_id",))
    joined = explained.join(model.transform(table).select("trip_id", "prediction"), "trip_id").toPandas()
    assert np.abs(joined.predicted_fare_amount - joined.prediction).max() < 1e-9
    for _, row in joined.head(2).iterrows():
        x = row[list(FEATURE_NAMES)].to_numpy(float)
        phi, base = _brute_force(spark, model, x)
        ours = row[[f"shap_{n}" for n in FEATURE_NAMES]].to_numpy(float)
        assert np.allclose(ours, phi, atol=1e-9)
        assert row.base_value == pytest.approx(base)


@pytest.mark.parametrize("make", [
    lambda: GBTRegressor(labelCol="fare_amount", maxIter=6, maxDepth=4, stepSize=0.1, seed=3),
    lambda: RandomForestRegressor(labelCol="fare_amount", numTrees=5, maxDepth=30, maxBins=512, seed=3),
])
def test_models_of_any_size_are_explained_block_by_block(spark, table, make):
    model = Pipeline(stages=[models.assembler(), make()]).fit(table)
    some = table.limit(40)
    whole = explain.explain_trees(some, model, keep=("trip_id",)).toPandas().set_index("trip_id").sort_index()
    parts = explain.explain_trees(some, model, keep=("trip_id",), block_nodes=50).toPandas().set_index("trip_id").sort_index()
    assert len(list(explain.leaf_tables(spark, model, block_nodes=50))) >= 5
    assert np.abs(whole.to_numpy() - parts.to_numpy()).max() < 1e-9


def test_contributions_add_up_for_values_that_are_not_numbers(spark, table):
    model = Pipeline(stages=[models.assembler(), GBTRegressor(labelCol="fare_amount", maxIter=8, maxDepth=4, seed=3)]).fit(table)
    broken = table.limit(60)
    for i, name in enumerate(FEATURE_NAMES):
        broken = broken.withColumn(name, F.when(F.col("trip_id") % 9 == i, F.lit(float("nan"))).otherwise(F.col(name)))
    explained = explain.explain_trees(broken, model, keep=("trip_id",))
    joined = explained.join(model.transform(broken).select("trip_id", "prediction"), "trip_id").toPandas()
    assert joined[list(FEATURE_NAMES)].isna().any().any()
    assert np.abs(joined.predicted_fare_amount - joined.prediction).max() < 1e-9


def test_contribution_grows_with_distance_and_importance(spark, table):
    model = Pipeline(stages=[models.assembler(), GBTRegressor(labelCol="fare_amount", maxIter=10, maxDepth=3,
                                                             seed=1)]).fit(table)
    trips = explain.reference_trips(spark)
    near = trips.withColumn("trip_distance_miles", F.lit(1.0))
    far = trips.withColumn("trip_distance_miles", F.lit(20.0))
    a = explain.explain_trees(near, model).agg(F.avg("shap_trip_distance_miles")).first()[0]
    b = explain.explain_trees(far, model).agg(F.avg("shap_trip_distance_miles")).first()[0]
    assert b > a
    imp = {r.feature: r.importance for r in explain.global_importance(explain.explain_trees(table, model)).collect()}
    assert all(v >= 0 for v in imp.values())
    assert imp["trip_distance_miles"] > imp["passenger_count"]


def test_linear_contributions_are_additive(spark, table):
    means = {n: 1.0 for n in FEATURE_NAMES}
    ex = explain.explain_coefficients(table, {"trip_distance_miles": 2.5}, 3.0, means).toPandas()
    assert np.allclose(ex.predicted_fare_amount, 3.0 + 2.5 * ex.trip_distance_miles)
    assert np.allclose(ex.base_value + ex[[f"shap_{n}" for n in FEATURE_NAMES]].sum(axis=1),
                       ex.predicted_fare_amount)


def test_rows_that_a_tree_does_not_tell_apart_share_its_values(spark, table, monkeypatch):
    model = Pipeline(stages=[models.assembler(), GBTRegressor(labelCol="fare_amount", maxIter=6, maxDepth=4, seed=3)]).fit(table)
    leaves = explain.leaf_table(spark, model)
    x = np.tile(np.array(table.select(*FEATURE_NAMES).collect(), float), (4, 1))
    x[::97, 0], x[1::89, 3] = np.nan, np.inf
    rows, look_up = [], explain._look_up
    monkeypatch.setattr(explain, "_look_up", lambda t, some, *a: rows.append(len(some)) or look_up(t, some, *a))
    together = explain.shap_values(leaves, x)
    assert len(rows) == 6 and max(rows) < len(x) / 2  # one look-up a tree, for some of the rows
    assert np.abs(together - look_up(leaves, x, 256, 1_000_000)).max() < 1e-12
    monkeypatch.setattr(explain, "CELLS_OF_A_TREE", 1)
    assert np.abs(explain.shap_values(leaves, x) - together).max() < 1e-12
