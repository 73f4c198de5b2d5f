"""Smaller public helpers: JSON stats reader, importance map, feature views, linear SHAP, strict scoring."""

import json
import math

import numpy as np
import pytest

from tripparity import session
from tripparity.operators import explain, metrics, models, vector
from tripparity.operators.vector import FEATURE_NAMES
from tripparity.plans import catalog, jobs
from tripparity.sources import artifacts

from conftest import SF_SMALL


def test_bare_token_json_stats_reader():
    text = json.dumps({"trip_distance_miles": {"mean": 1.0, "std": 0.5, "min": 0.1, "max": 9.0,
                                               "bin_edges": [-math.inf, 2.0, math.inf],
                                               "bin_proportions": [0.4, 0.6]}})
    assert "-Infinity" in text
    stats = artifacts.reference_stats_from_json_text(text)
    assert stats["trip_distance_miles"].bin_edges == (-math.inf, 2.0, math.inf)
    with pytest.raises(ValueError):
        artifacts.reference_stats_from_json_text(text.replace("[0.4, 0.6]", "[1.0]"))
    with pytest.raises(ValueError):
        artifacts.reference_stats_from_json_text(text.replace('"std"', '"deviation"'))


def test_documents_are_read_whole(spark, tmp_path):
    """Metadata and statistics written over several lines, as other tools do."""
    (tmp_path / "metadata").mkdir()
    (tmp_path / "metadata" / "part.txt").write_text(json.dumps({"model_name": "x", "metrics": {"r2": 1}}, indent=2))
    assert artifacts.load_metadata(spark, str(tmp_path))["metrics"] == {"r2": 1}
    entry = {"mean": 1, "std": 1, "min": 0, "max": 2, "bin_edges": [-math.inf, math.inf], "bin_proportions": [1.0]}
    (tmp_path / "stats.json").write_text(json.dumps({"pickup_month": entry}, indent=2))
    assert artifacts.load_reference_stats_json(spark, str(tmp_path / "stats.json"))["pickup_month"].bin_proportions == (1.0,)
    assert artifacts.load_reference_stats_json(spark, str(tmp_path / "none.json")) is None


def test_metrics_of_constant_labels(spark):
    rows = [("a", 5.0, 5.0), ("a", 5.0, 5.0), ("b", 5.0, 4.0), ("b", 5.0, 5.0), ("c", 1.0, 2.0), ("d", 1.0, 1.0), ("d", 3.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, fare_amount double, prediction double")
    found = {r.g: r.r2_score for r in metrics.regression_metrics(df, group_by=("g",)).collect()}
    assert found == {"a": 1.0, "b": 0.0, "c": None, "d": 1.0}


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(RuntimeError):
        session.checkpoint_root(Cluster())


def test_feature_views(spark):
    table = catalog.training_table(spark, SF_SMALL)
    assert tuple(vector.ordered_features(table).columns) == FEATURE_NAMES
    doubles = vector.as_double_features(table)
    assert all(dict(doubles.dtypes)[n] == "double" for n in FEATURE_NAMES)


@pytest.fixture(scope="module")
def ridge(spark):
    table = catalog.training_table(spark, SF_SMALL)
    result = models.compare_models(table, models.TrainingConfig(), candidates=("ridge",))[0]
    return table, result.model


def test_fitted_linear_contributions_are_additive(spark, ridge):
    table, model = ridge
    means = jobs.training_means(table)
    ex = explain.explain(table, model, means, keep=("trip_id",))
    joined = ex.join(models.score(table, model).select("trip_id", "predicted_fare_amount")
                     .withColumnRenamed("predicted_fare_amount", "p"), "trip_id").toPandas()
    assert np.allclose(joined.predicted_fare_amount, joined.p)
    imp = explain.importance_map(explain.global_importance(ex)).first().feature_importance
    assert set(imp) == set(FEATURE_NAMES) and imp["pickup_month"] == 0.0
    with pytest.raises(ValueError):
        explain.explain(table, model, None)


def test_strict_scoring_raises_on_non_finite(spark, ridge):
    _, model = ridge
    row = tuple([float("nan")] + [1.0] * 8)
    df = spark.createDataFrame([row], ", ".join(f"{n} double" for n in FEATURE_NAMES))
    assert models.score(df, model).first().prediction_finite is False
    with pytest.raises(Exception):
        models.score(df, model, strict=True).collect()
