"""Best-first L1 boosting against a plain NumPy version and its own scores and explanations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripparity.operators import boosting as B
from tripparity.operators import explain, models
from tripparity.operators.vector import FEATURE_NAMES
from tripparity.plans import catalog

from conftest import SF_SMALL


def plain_scores(x, y, c):
    """Rows' scores after every round, grown one split at a time."""
    n = len(y)
    ordered = np.sort(x, axis=0)
    edges = [np.unique(ordered[[i * n // c.bins for i in range(1, c.bins)], f]) for f in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)])
    score = np.full(n, np.median(y))
    for _ in range(c.rounds):
        g = -np.sign(y - score)
        leaves = {"": np.arange(n)}

        def best(rows):
            out = None
            for f in range(x.shape[1]):
                for b in np.unique(bins[rows, f]):
                    left = bins[rows, f] <= b
                    n0, n1 = left.sum(), (~left).sum()
                    if min(n0, n1) >= c.least_rows:
                        s0, s = g[rows[left]].sum(), g[rows].sum()
                        gain = s0 * s0 / n0 + (s - s0) * (s - s0) / n1 - s * s / len(rows)
                        if gain > B.LEAST_GAIN and (out is None or gain > out[0]):
                            out = (gain, f, b)
            return out

        known = {"": best(leaves[""])}
        while len(leaves) < c.leaves:
            ready = sorted((-known[p][0], p) for p in leaves if known[p])
            if not ready:
                break
            path = ready[0][1]
            rows = leaves.pop(path)
            left = bins[rows, known[path][1]] <= known[path][2]
            for side, part in (("0", rows[left]), ("1", rows[~left])):
                leaves[path + side] = part
                known[path + side] = best(part)
        step = np.zeros(n)
        for rows in leaves.values():
            step[rows] = c.rate * np.median((y - score)[rows])
        score = score + step
    return score


@pytest.fixture(scope="module")
def table(spark):
    return models.feature_frame(catalog.training_table(spark, SF_SMALL), keep=("trip_id",)).cache()


@pytest.mark.parametrize("config", [B.BoostingConfig(rounds=3, leaves=6, rate=0.3, bins=32),
                                    B.BoostingConfig(rounds=1, leaves=31, least_rows=5)])
def test_equals_a_plain_version(spark, table, config):
    model = B.fit_boosted(table, config=config)
    pdf = model.transform(table).toPandas()
    x, y = pdf[list(FEATURE_NAMES)].to_numpy(float), pdf["fare_amount"].to_numpy()
    assert len(model.trees) == config.rounds and all(sum(p + "0" not in t for p in t) <= config.leaves for t in model.trees)
    assert np.abs(pdf["prediction"] - plain_scores(x, y, config)).max() < 1e-9


def test_explanations_add_up(spark, table):
    model = B.fit_boosted(table, config=B.BoostingConfig(rounds=2, leaves=8, rate=0.5))
    scored = model.transform(table).select("trip_id", "prediction")
    both = explain.explain_trees(table, model, keep=("trip_id",)).join(scored, "trip_id").toPandas()
    assert np.abs(both.predicted_fare_amount - both.prediction).max() < 1e-9
    parts = both[[f"shap_{n}" for n in FEATURE_NAMES]].sum(axis=1) + both.base_value
    assert np.abs(parts - both.prediction).max() < 1e-9


def test_constant_and_bad_tables(spark):
    same = spark.createDataFrame([(1.0, 2.0, 5.0)] * 50, "a double, b double, fare_amount double")
    model = B.fit_boosted(same, columns=("a", "b"), config=B.BoostingConfig(rounds=2))
    assert [r["prediction"] for r in model.transform(same.limit(1)).collect()] == [5.0]
    with pytest.raises(ValueError, match="at least one row"):
        B.fit_boosted(same.limit(0), columns=("a", "b"))
    with pytest.raises(ValueError, match="finite labels and features: b$"):
        B.fit_boosted(same.withColumn("b", F.lit(None).cast("double")), columns=("a", "b"))
