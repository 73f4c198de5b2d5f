"""Candidates, metrics, selection, artifacts and the end-to-end training job."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripparity.operators import metrics, models
from tripparity.operators.vector import FEATURE_NAMES
from tripparity.plans import catalog, jobs
from tripparity.session import scratch_path
from tripparity.sources import artifacts
from tripparity.sources.trips import load_trips, raw_trips_from_trips

from conftest import SF_SMALL

SMALL = models.TrainingConfig(n_estimators=5, forest_trees=5, forest_max_depth=4)


@pytest.fixture(scope="module")
def outcome(spark):
    raw = raw_trips_from_trips(load_trips(spark, SF_SMALL))
    return jobs.train_job(spark, raw, scratch_path(spark, "test-train"), SMALL)


def test_three_candidates_with_three_metrics(outcome):
    assert [r.name for r in outcome.results] == list(models.CANDIDATES)
    for r in outcome.results:
        assert set(r.metrics) == set(metrics.METRIC_NAMES)
        assert all(np.isfinite(v) for v in r.metrics.values())


def test_selects_minimum_rmse(outcome):
    assert outcome.best.metrics["root_mean_squared_error"] == min(
        r.metrics["root_mean_squared_error"] for r in outcome.results)


def test_artifacts_are_written(spark, outcome):
    directory = outcome.model_path.rsplit("/", 1)[0]
    meta = artifacts.load_metadata(spark, directory)
    assert meta["feature_names"] == list(FEATURE_NAMES) and meta["training_rows"] == outcome.training_rows
    assert meta["model_name"] == outcome.best.name
    comparison = artifacts.load_comparison(spark, f"{directory}/{artifacts.COMPARISON_DIR}").collect()
    assert comparison[0].candidate == outcome.best.name and comparison[0].selected
    rmse = [r.root_mean_squared_error for r in comparison]
    assert rmse == sorted(rmse)
    runs = artifacts.search_runs(spark, f"{directory}/{jobs.RUNS_DIR}")
    assert runs.count() == 3
    winner = artifacts.search_runs(spark, f"{directory}/{jobs.RUNS_DIR}", selected=True).collect()
    assert len(winner) == 1 and winner[0].model_path is not None
    assert artifacts.search_runs(spark, f"{directory}/{jobs.RUNS_DIR}", candidate="ridge").count() == 1
    model = artifacts.load_model(spark, directory)
    assert model.stages[-1].__class__.__name__ == outcome.best.model_type
    assert artifacts.load_reference_stats(spark, f"{directory}/{artifacts.REFERENCE_DIR}") == outcome.reference


def test_missing_model_and_metadata(spark):
    with pytest.raises(FileNotFoundError):
        artifacts.load_model(spark, scratch_path(spark, "nothing"))
    assert artifacts.load_metadata(spark, scratch_path(spark, "nothing")) == {}


def test_too_few_rows(spark):
    few = catalog.training_table(spark, SF_SMALL).limit(10)
    with pytest.raises(ValueError, match="20 valid rows"):
        models.compare_models(few, SMALL)


def test_all_invalid_raises(spark):
    raw = raw_trips_from_trips(load_trips(spark, SF_SMALL)).withColumn("fare_amount", F.lit(-1.0))
    with pytest.raises(ValueError):
        jobs.train_job(spark, raw, scratch_path(spark, "test-invalid"), SMALL)


def test_ridge_matches_closed_form(spark):
    table = catalog.training_table(spark, SF_SMALL)
    split = metrics.with_split(table, "trip_id")
    result = models.compare_models(table, SMALL, candidates=("ridge",))[0]
    train = split.where("NOT is_validation").toPandas()
    x = train[list(FEATURE_NAMES)].to_numpy(float)
    y = train["fare_amount"].to_numpy(float)
    xc, yc = x - x.mean(0), y - y.mean()
    coef = np.linalg.solve(xc.T @ xc + 1.0 * np.eye(x.shape[1]), xc.T @ yc)
    assert np.allclose(result.model.stages[-1].coefficients.toArray(), coef, rtol=1e-5, atol=1e-6)


def test_split_is_stable_and_about_a_fifth(spark):
    table = metrics.with_split(catalog.training_table(spark, SF_SMALL), "trip_id")
    a = {r.trip_id for r in table.where("is_validation").collect()}
    b = {r.trip_id for r in metrics.with_split(catalog.training_table(spark, SF_SMALL).repartition(5),
                                                 "trip_id").where("is_validation").collect()}
    assert a == b and 0.15 < len(a) / table.count() < 0.25


def test_metrics_match_numpy(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 1.0), (4.0, 4.5), (8.0, 7.0)], "fare_amount double, prediction double")
    row = metrics.regression_metrics(df).first()
    y, p = np.array([1.0, 2, 4, 8]), np.array([1.5, 1.0, 4.5, 7.0])
    assert row.mean_absolute_error == pytest.approx(np.abs(y - p).mean())
    assert row.root_mean_squared_error == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    assert row.r2_score == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_scoring_flags_non_finite(spark, outcome):
    df = spark.createDataFrame([tuple([1.0] * 9)], ", ".join(f"{n} double" for n in FEATURE_NAMES))
    scored = models.score(df, outcome.best.model).first()
    assert scored.prediction_finite and np.isfinite(scored.predicted_fare_amount)


def test_exact_split_holds_out_exactly_a_fifth(spark):
    import hashlib
    for n in (1, 4, 5, 6, 503):
        keys = spark.range(n).withColumnRenamed("id", "trip_id")
        by_mark = sorted(range(n), key=lambda k: hashlib.md5(str(k).encode()).hexdigest()[:15])
        for parts in (1, 7):
            out = metrics.with_exact_split(keys.repartition(parts)).where("is_validation").collect()
            assert {r.trip_id for r in out} == set(by_mark[:-(-n // 5)])
    repeated = spark.createDataFrame([(k,) for k in [1, 2, 3, None] * 50], "trip_id long")
    sides = metrics.with_exact_split(repeated).distinct().groupBy("trip_id").count().collect()
    assert len(sides) == 4 and all(r["count"] == 1 for r in sides)  # one key, one side
    assert metrics.with_exact_split(repeated.limit(0)).count() == 0
    table = catalog.training_table(spark, SF_SMALL)
    rows = table.count()
    exact = models.compare_models(table, replace(SMALL, exact_split=True), candidates=("ridge",))[0]
    assert exact.params["training_rows"] == str(rows - -(-rows // 5))


def test_fits_read_one_part_a_core(spark, tmp_path, monkeypatch):
    """Trips in a single file train on all cores, a part holds its rows in order of the key."""
    seen = []
    monkeypatch.setattr(models, "compare_models", lambda features, *a: seen.append(features) or (_ for _ in ()).throw(InterruptedError))
    raw = raw_trips_from_trips(load_trips(spark, SF_SMALL)).coalesce(1)
    with pytest.raises(InterruptedError):
        jobs.train_job(spark, raw, f"{tmp_path}/out")
    parts = [[r["trip_id"] for r in part] for part in seen[0].select("trip_id").rdd.glom().collect()]
    assert len(parts) == spark.sparkContext.defaultParallelism and max(map(len, parts)) < 2 * sum(map(len, parts)) / len(parts)
    assert all(part == sorted(part) for part in parts) and sum(map(len, parts)) == 809
