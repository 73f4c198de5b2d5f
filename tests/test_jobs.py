"""Jobs: raw scan (S1-S3), scoring responses (E1), drift job (E4), model info (E5)."""

import glob

import pandas as pd
import pytest

from tripparity.operators import drift, explain, models
from tripparity.operators.vector import FEATURE_NAMES
from tripparity.plans import jobs
from tripparity.session import scratch_path
from tripparity.sources.requests import requests_from_trips
from tripparity.sources.trips import RAW_COLUMNS, first_rows, load_raw_trips, load_trips, raw_trips_from_trips

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def raw_path(spark):
    path = scratch_path(spark, "raw-trips")
    raw_trips_from_trips(load_trips(spark, SF_SMALL)).write.parquet(path)
    return path


def test_raw_scan_projects_and_limits(spark, raw_path):
    df = load_raw_trips(spark, raw_path)
    assert tuple(df.columns) == RAW_COLUMNS
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "trip_id" not in plan.split("ReadSchema:")[-1]  # column pruning reached the scan
    first = load_raw_trips(spark, raw_path, row_limit=10, order_by=("trip_id",))
    assert [r.trip_id for r in first.collect()] == list(range(10))
    with pytest.raises(ValueError):
        load_raw_trips(spark, raw_path, row_limit=0)
    with pytest.raises(FileNotFoundError):
        load_raw_trips(spark, raw_path + "-missing")


@pytest.mark.parametrize("n", [1, 9, 10, 11, 35, 69, 70, 500])
def test_first_rows_are_the_first_in_file_order(spark, n):
    """Equal to pandas' head over the files by path; files after the last row needed are not opened."""
    path = scratch_path(spark, "many-files")
    spark.range(0, 70, 1, 7).selectExpr("(id * 37) % 70 AS v").write.parquet(path)
    spark.range(0).selectExpr("id AS v").write.mode("append").parquet(path)
    files = sorted(glob.glob(path.removeprefix("file:") + "/*.parquet"))
    want = pd.concat([pd.read_parquet(f) for f in files]).head(n)["v"]
    df = first_rows(spark.read.parquet(path), n)
    assert sorted(r.v for r in df.collect()) == sorted(want)
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    scan.executeColumnar().count()
    read = scan.metrics().apply("numFiles").value()
    assert read <= -(-min(n, 70) // 10) + 2  # empty files may lie between


def test_range_checks_reach_the_scan(spark, raw_path):
    from tripparity.operators import contracts
    valid = contracts.valid_trips(contracts.coerce_raw(load_raw_trips(spark, raw_path)))
    plan = valid._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(tpep_pickup_datetime)" in plan


@pytest.fixture(scope="module")
def trained(spark):
    raw = raw_trips_from_trips(load_trips(spark, SF_SMALL))
    config = models.TrainingConfig(n_estimators=5, forest_trees=5, forest_max_depth=4)
    directory = scratch_path(spark, "jobs-train")
    return directory, jobs.train_job(spark, raw, directory, config)


def test_score_requests_responses(spark, trained):
    directory, outcome = trained
    responses, rejected = jobs.score_requests(requests_from_trips(load_trips(spark, SF_SMALL)),
                                              outcome.best.model, outcome.best.name)
    row = responses.first()
    assert row.model_name == outcome.best.name and row.prediction_finite
    assert row.parity.total_features == 9
    assert set(row.training_features.asDict()) == set(row.serving_features.asDict())
    assert responses.count() + rejected.count() == load_trips(spark, SF_SMALL).count()


def test_drift_job_and_model_info(spark, trained):
    directory, outcome = trained
    responses, _ = jobs.score_requests(requests_from_trips(load_trips(spark, SF_SMALL)), outcome.best.model)
    features, overall = jobs.drift_job(spark, jobs.served_log(responses), directory)
    report = overall.first()
    assert report.reference_available and report.sample_count == drift.DEFAULT_BUFFER_SIZE
    assert features.count() == 9
    info = jobs.model_info(spark, directory).first()
    assert info.model_name == outcome.best.name and len(info.feature_names) == 9
    features, overall = jobs.drift_job(spark, jobs.served_log(responses), scratch_path(spark, "no-model"))
    assert overall.first().status == "unavailable"


def test_serving_records_every_accepted_vector_once(spark, trained, tmp_path):
    requests = requests_from_trips(load_trips(spark, SF_SMALL)).limit(200).cache()
    log = f"{tmp_path}/served"
    for batch in ("a", "b", "a"):  # a batch recorded again replaces itself
        responses, rejected = jobs.serve_job(spark, requests, trained[1].best.model, log, batch)
    ok = responses.select("request_id").collect()
    assert spark.read.parquet(log).count() == 2 * len(ok) and len(ok) + rejected.count() == 200


def test_default_sample_explains_the_selected_model(spark, trained):
    """Global importance of the winner over the six default trips."""
    explained = explain.explain(explain.reference_trips(spark), trained[1].best.model,
                                {n: 1.0 for n in FEATURE_NAMES})
    rows = explain.global_importance(explained).collect()
    assert {r.feature for r in rows} == set(FEATURE_NAMES) and all(r.rows == 6 and r.importance >= 0 for r in rows)


def test_global_importance_of_a_saved_model(spark, trained):
    """The job on the folder equals the pieces; a sample of one's own takes any rows; no model is an error."""
    directory, outcome = trained
    means = {n: outcome.reference[n].mean for n in FEATURE_NAMES}
    for sample in (None, spark.read.parquet(f"{directory}/{jobs.TRAINING_FEATURES_DIR}")):
        rows = jobs.global_importance(spark, directory, sample).collect()
        whole = explain.reference_trips(spark) if sample is None else sample
        want = explain.global_importance(explain.explain(whole, outcome.best.model, means)).collect()
        assert {r.feature: r.importance for r in rows} == pytest.approx({r.feature: r.importance for r in want})
        assert {(r.model_name, r.rows) for r in rows} == {(outcome.best.name, whole.count())} and len(rows) == 9
    with pytest.raises(FileNotFoundError):
        jobs.global_importance(spark, scratch_path(spark, "no-model"))


def test_scratch_paths_live_under_the_checkpoint_dir(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(root.rstrip("/"))
