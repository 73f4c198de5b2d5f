"""End-to-end jobs: training (M7), scoring (E1), explaining (E2, E3), drift (E4), model info (E5).

Every job reads tables and writes tables; lineage is cut by writing to the output folder (a shared
file system on a cluster), never by local checkpoints.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripparity.operators import contracts, drift, explain, models, pairs, parity
from tripparity.operators.shared import training_features
from tripparity.operators.vector import FEATURE_NAMES
from tripparity.sources import artifacts

TRAINING_FEATURES_DIR = "training_features"
RUNS_DIR = "runs"


@dataclass
class TrainingOutcome:
    results: list[models.CandidateResult]
    best: models.CandidateResult
    training_rows: int
    reference: drift.ReferenceStats
    model_path: str


def train_job(spark: SparkSession, raw: DataFrame, output_dir: str,
              config: models.TrainingConfig | None = None, key: str = "trip_id") -> TrainingOutcome:
    """M7: validate -> features -> compare -> select -> log runs -> save model, comparison, stats.

    The feature table is written to ``output_dir`` first: it is an artifact, it cuts the lineage
    for the three fits and the statistics, and it survives executor loss. The fits read it in as many
    parts as there are cores, dealt and sorted by ``key``, however few files or row groups hold the trips.
    """
    config = config or models.TrainingConfig()
    out = output_dir.rstrip("/")
    valid = contracts.valid_trips(contracts.coerce_raw(raw, key_columns=(key,)))
    training_features(valid, keep=(key,)).write.mode("overwrite").parquet(f"{out}/{TRAINING_FEATURES_DIR}")
    features = spark.read.parquet(f"{out}/{TRAINING_FEATURES_DIR}")
    rows = features.count()
    dealt = features.repartition(spark.sparkContext.defaultParallelism, key).sortWithinPartitions(key)
    if rows == 0:
        raise contracts.ContractError("validation left no trip to train on")
    results = models.compare_models(dealt, config, key)
    best = models.select_best_model(results)
    model_path = artifacts.save_model(spark, best, out, config, rows)
    artifacts.log_runs(spark, results, best.name, rows, f"{out}/{RUNS_DIR}", model_path)
    artifacts.save_comparison(spark, results, best.name, f"{out}/{artifacts.COMPARISON_DIR}")
    reference = drift.compute_reference_stats(features, written=True)
    artifacts.save_reference_stats(spark, reference, f"{out}/{artifacts.REFERENCE_DIR}")
    return TrainingOutcome(results, best, rows, reference, model_path)


def training_means(features: DataFrame) -> dict[str, float]:
    """Feature means of the training table (the linear explainer's background)."""
    row = features.agg(*[F.avg(F.col(n).cast("double")).alias(n) for n in FEATURE_NAMES]).collect()[0]
    return {n: float(row[n]) for n in FEATURE_NAMES}


def score_requests(requests: DataFrame, model: PipelineModel, model_name: str = "model",
                   strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """E1 for a whole table: (responses, rejected).

    A response carries the prediction from the *serving* vector (M9), both vectors, the modes and
    the parity report, in the nested D9 shape. Nothing is shuffled.
    """
    served = pairs.serve_requests(requests)
    ok = pairs.accepted(served)
    scored = models.score(ok, model, prefix=pairs.SERVING_PREFIX, strict=strict)
    responses = pairs.with_vector_structs(parity.parity_report(scored)).select(
        "request_id", "predicted_fare_amount", "prediction_finite", F.lit(model_name).alias("model_name"),
        "feature_mode", F.col("skew_mode").alias("requested_skew_mode"), "applied_skew_mode",
        F.col("training").alias("training_features"), F.col("serving").alias("serving_features"),
        "parity", *[c for c in ("served_at",) if c in requests.columns])
    rejected = pairs.rejected(served).select("request_id", "rejection_reasons")
    return responses, rejected


def served_log(responses: DataFrame) -> DataFrame:
    """D15 rows to append to the served log: serving vectors with their serving time."""
    return responses.select("request_id", "served_at",
                            *[F.col(f"serving_features.{n}").alias(n) for n in FEATURE_NAMES])


def record_served(responses: DataFrame, log_path: str, batch: str) -> None:
    """Records the served vectors under the batch's own folder; recording a batch again replaces it."""
    served_log(responses).write.mode("overwrite").parquet(f"{log_path.rstrip('/')}/batch={batch}")


def serve_job(spark: SparkSession, requests: DataFrame, model: PipelineModel, log_path: str, batch: str,
              model_name: str = "model") -> tuple[DataFrame, DataFrame]:
    """Records every accepted request's serving vector in the log, then returns (responses, rejected)."""
    ok = pairs.accepted(pairs.serve_requests(requests))
    record_served(pairs.with_vector_structs(ok).withColumnRenamed("serving", "serving_features"), log_path, batch)
    return score_requests(requests, model, model_name)


def explain_requests(requests: DataFrame, model: PipelineModel,
                     means: dict[str, float] | None = None) -> DataFrame:
    """Explanations of the serving vectors of accepted requests (not recorded for drift)."""
    ok = pairs.accepted(pairs.serve_requests(requests))
    return explain.explain(ok, model, means, keep=("request_id", "feature_mode", "applied_skew_mode"),
                           prefix=pairs.SERVING_PREFIX)


def global_importance(spark: SparkSession, model_dir: str, sample: DataFrame | None = None) -> DataFrame:
    """Mean absolute contribution per feature of the model saved in ``model_dir``: model_name, rows, feature, importance.

    ``sample`` holds feature vectors under their contract names (any size; other columns are ignored);
    without one the six representative trips are explained. A linear model's background means are
    those of the reference statistics saved beside it. A missing model raises ``FileNotFoundError``.
    """
    model = artifacts.load_model(spark, model_dir)
    reference = artifacts.load_reference_stats(spark, f"{model_dir.rstrip('/')}/{artifacts.REFERENCE_DIR}")
    means = {n: reference[n].mean for n in FEATURE_NAMES} if reference else None
    explained = explain.explain(explain.reference_trips(spark) if sample is None else sample, model, means)
    name = artifacts.load_metadata(spark, model_dir).get("model_name", "model")
    return explain.global_importance(explained).withColumn("model_name", F.lit(name))


def drift_job(spark: SparkSession, served: DataFrame, model_dir: str,
              buffer_size: int = drift.DEFAULT_BUFFER_SIZE) -> tuple[DataFrame, DataFrame]:
    """The reference saved beside the model, the latest served rows, the drift report."""
    reference = artifacts.load_reference_stats(spark, f"{model_dir.rstrip('/')}/{artifacts.REFERENCE_DIR}")
    return drift.drift_report(drift.latest(served, buffer_size), reference)


def model_info(spark: SparkSession, model_dir: str) -> DataFrame:
    """E5: model name, feature names and metadata as one row."""
    import json
    meta = artifacts.load_metadata(spark, model_dir)
    return spark.createDataFrame(
        [(meta.get("model_name", "model"), list(FEATURE_NAMES), json.dumps(meta))],
        "model_name string, feature_names array<string>, metadata string")
