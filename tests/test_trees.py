"""Forests and boosted trees grown on binned blocks: against MLlib's learners and brute force."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tripparity.operators import explain, models, trees
from tripparity.operators.vector import FEATURE_NAMES
from tripparity.plans import catalog
from tripparity.session import scratch_path

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def table(spark):
    """Whole miles and quarters of dollars: few values, and sums without rounding."""
    rows = models.feature_frame(catalog.training_table(spark, SF_SMALL), keep=("trip_id",))
    return rows.withColumn("trip_distance_miles", F.round("trip_distance_miles", 0)).withColumn("fare_amount", F.floor(F.col("fare_amount") * 4) / 4) \
        .repartition(3, "trip_id").sortWithinPartitions("trip_id").cache()


def _fitted(spark, table, estimator):
    data = trees.binned(table, FEATURE_NAMES, "fare_amount", estimator.getMaxBins())
    try:
        return trees.fit(spark, data, estimator)
    finally:
        trees.release(spark, data)


@pytest.mark.parametrize("pair_cells", [0, 1 << 30])
def test_boosted_trees_equal_mllibs(spark, table, monkeypatch, pair_cells):
    monkeypatch.setattr(trees.grow_boosted, "__defaults__", (pair_cells,))
    estimator = GBTRegressor(labelCol="fare_amount", lossType="absolute", maxIter=7, stepSize=0.05, maxDepth=4, minInstancesPerNode=20,
                             maxBins=1024, featureSubsetStrategy="all", seed=42)
    ours = _fitted(spark, table, estimator)
    given = Pipeline(stages=[models.assembler(), estimator]).fit(table).stages[-1]
    assert ours.toDebugString.split("\n")[1:] == given.toDebugString.split("\n")[1:]
    assert list(ours.treeWeights) == list(given.treeWeights) and ours.getOrDefault("lossType") == "absolute"


def test_a_forest_does_not_depend_on_where_nodes_are_grown(spark, table):
    """Nodes split by histograms over all blocks and nodes grown by one task give one tree, that of the whole bag in memory."""
    data = trees.binned(table, FEATURE_NAMES, "fare_amount", 1024)
    blocks = sorted(data.blocks.collect(), key=lambda b: b[0])
    codes, y = np.concatenate([b[1] for b in blocks], axis=1), np.concatenate([b[2] for b in blocks])
    whole = []
    for t in range(3):
        w = np.concatenate([trees.bag(7, b[0], t, len(b[2])) for b in blocks]).astype(float)
        whole.append(trees.grow(codes[:, w > 0], w[w > 0], y[w > 0], 1, data.sizes, 6, 1))
    for node_rows in (1 << 17, 200, 0):
        for one, other in zip(trees.grow_forest(data, 3, 6, 1, 7, node_rows), whole):
            a, b = trees.pruned(one), trees.pruned(other)
            assert np.array_equal(a["feature"], b["feature"]) and np.array_equal(a["child"], b["child"]) and np.array_equal(a["sums"], b["sums"])
            inner = a["child"] >= 0
            assert inner.sum() > 20 and np.array_equal(a["cut"][inner], b["cut"][inner])
    trees.release(spark, data)


def test_a_forest_is_as_good_as_mllibs_and_can_be_explained(spark, table):
    estimator = RandomForestRegressor(labelCol="fare_amount", numTrees=20, maxDepth=6, maxBins=64, featureSubsetStrategy="all", seed=3)
    train, held = table.where("trip_id % 5 > 0"), table.where("trip_id % 5 = 0")
    ours = PipelineModel([models.assembler(), _fitted(spark, train, estimator)])
    given = Pipeline(stages=[models.assembler(), estimator]).fit(train)
    errors = [m.transform(held).agg(F.avg(F.abs(F.col("prediction") - F.col("fare_amount")))).first()[0] for m in (ours, given)]
    assert errors[0] < 1.1 * errors[1]
    path = scratch_path(spark, "test-forest")
    ours.write().save(path)
    again = PipelineModel.load(path).transform(held).select("prediction").collect()
    assert again == ours.transform(held).select("prediction").collect()
    row = explain.explain_trees(held.limit(5), ours).first()
    assert row.predicted_fare_amount == pytest.approx(ours.transform(held.where(" AND ".join(f"{n} = {row[n]}" for n in FEATURE_NAMES))).first().prediction)


def test_thresholds_are_exact_order_statistics(spark):
    rng = np.random.default_rng(1)
    x = np.stack([np.round(rng.normal(size=3000), 2), rng.integers(0, 5, 3000), np.zeros(3000), -np.exp(9 * rng.normal(size=3000))])
    blocks = spark.sparkContext.parallelize([x[:, i:i + 700] for i in range(0, 3000, 700)], 5)
    ranks = [0, 1, 17, 1500, 2999]
    for got, values in zip(trees.order_statistics(blocks, 4, ranks), x):
        assert np.array_equal(got, np.sort(values)[ranks])
    cuts = trees.thresholds(blocks, 4, 3000, 16)
    assert cuts[1].tolist() == [0.5, 1.5, 2.5, 3.5] and len(cuts[2]) == 0
    for f in (0, 3):
        ends = np.unique(np.sort(x[f])[[-(-i * 3000 // 16) - 1 for i in range(1, 16)]])
        values = np.unique(x[f])
        assert np.array_equal(cuts[f], (ends + values[np.searchsorted(values, ends) + 1]) / 2)


def test_not_finite_values_and_other_settings_raise(spark, table):
    for column in ("fare_amount", "pickup_hour"):
        with pytest.raises(ValueError, match="finite"):
            trees.binned(table.withColumn(column, F.when(F.col("trip_id") % 50 != 7, F.col(column)).otherwise(float("nan"))), FEATURE_NAMES, "fare_amount", 64)
    with pytest.raises(ValueError, match="all features"):
        trees.fit(spark, None, RandomForestRegressor(featureSubsetStrategy="sqrt"))


def test_explanations_use_all_cores(spark, table):
    estimator = GBTRegressor(labelCol="fare_amount", lossType="absolute", maxIter=2, maxDepth=2, featureSubsetStrategy="all", maxBins=1024)
    model = _fitted(spark, table, estimator)
    rows = table.coalesce(1)
    out = explain.explain_trees(rows, model, keep=("trip_id",))
    assert out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert out.count() == out.select("trip_id").distinct().count() == table.count()
