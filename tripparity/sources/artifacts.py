"""Artifact sinks and sources (S5-S12), all written with Spark to a (shared) folder.

Reference statistics are Parquet: their bin edges always hold +-infinity, which Spark's JSON writer
would quote. Comparison, metadata and runs are small tables written by Spark as JSON / Parquet.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DoubleType, IntegerType, LongType, MapType, StringType,
                               StructField, StructType)

from tripparity.operators.drift import FeatureReference, ReferenceStats, reference_frame, stats_from_frame
from tripparity.operators.metrics import SELECTION_METRIC
from tripparity.operators.models import CandidateResult, TrainingConfig, config_dict
from tripparity.operators.vector import FEATURE_NAMES
from tripparity.session import path_exists

MODEL_DIR = "model"
METADATA_DIR = "metadata"
COMPARISON_DIR = "model_comparison"
REFERENCE_DIR = "reference_stats"
PROJECT = "tripparity"

COMPARISON_SCHEMA = StructType([
    StructField("candidate", StringType(), False),
    StructField("candidate_order", IntegerType(), False),
    StructField("model_type", StringType(), False),
    StructField("mean_absolute_error", DoubleType(), False),
    StructField("root_mean_squared_error", DoubleType(), False),
    StructField("r2_score", DoubleType(), False),
    StructField("selected", BooleanType(), False),
    StructField("selection_metric", StringType(), False),
])

RUNS_SCHEMA = StructType([
    StructField("run_id", StringType(), False),
    StructField("experiment", StringType(), False),
    StructField("candidate", StringType(), False),
    StructField("params", MapType(StringType(), StringType()), False),
    StructField("training_rows", LongType(), False),
    StructField("metrics", MapType(StringType(), DoubleType()), False),
    StructField("selected", BooleanType(), False),
    StructField("model_path", StringType(), True),
    StructField("logged_at", StringType(), False),
])


# ----------------------------------------------------------------------------- S5 / S6

def save_reference_stats(spark: SparkSession, stats: ReferenceStats, path: str) -> None:
    reference_frame(spark, stats).coalesce(1).write.mode("overwrite").parquet(path)


def load_reference_stats(spark: SparkSession, path: str) -> ReferenceStats | None:
    """The saved statistics, or None if the folder has none."""
    if not path_exists(spark, path):
        return None
    return stats_from_frame(spark.read.parquet(path))


REFERENCE_NUMBERS = {"mean": "mean", "std": "std", "min": "minimum", "max": "maximum"}


def reference_stats_from_json_text(text: str) -> ReferenceStats:
    """Statistics in their JSON form (one object per feature; infinities as bare tokens).

    A feature without a number, without edges or with another number of proportions than bins is refused.
    """
    stats: ReferenceStats = {}
    for name, entry in json.loads(text).items():
        missing = [k for k in (*REFERENCE_NUMBERS, "bin_edges", "bin_proportions") if k not in entry]
        if missing:
            raise ValueError(f"statistics of {name} lack {missing}")
        lists = {k: tuple(map(float, entry[k])) for k in ("bin_edges", "bin_proportions")}
        if len(lists["bin_proportions"]) != len(lists["bin_edges"]) - 1:
            raise ValueError(f"statistics of {name} need one proportion for every bin")
        stats[name] = FeatureReference(**{field: float(entry[k]) for k, field in REFERENCE_NUMBERS.items()}, **lists)
    return stats


def load_reference_stats_json(spark: SparkSession, path: str) -> ReferenceStats | None:
    """The JSON form read whole from a file or folder; None if there is none."""
    if not path_exists(spark, path):
        return None
    documents = [r.value for r in spark.read.text(path, wholetext=True).collect() if r.value.strip()]
    return reference_stats_from_json_text(documents[0]) if documents else None


# ----------------------------------------------------------------------------- S7

def comparison_frame(spark: SparkSession, results: list[CandidateResult], selected: str) -> DataFrame:
    rows = [(r.name, r.order, r.model_type, r.metrics["mean_absolute_error"],
             r.metrics["root_mean_squared_error"], r.metrics["r2_score"], r.name == selected,
             SELECTION_METRIC) for r in results]
    frame = spark.createDataFrame(rows, COMPARISON_SCHEMA)
    return frame.orderBy(F.col(SELECTION_METRIC).asc(), F.col("candidate_order").asc())


def save_comparison(spark: SparkSession, results: list[CandidateResult], selected: str, path: str) -> None:
    comparison_frame(spark, results, selected).coalesce(1).write.mode("overwrite").json(path)


def load_comparison(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMPARISON_SCHEMA).json(path).orderBy(SELECTION_METRIC, "candidate_order")


# ----------------------------------------------------------------------------- S8 - S10

def save_model(spark: SparkSession, best: CandidateResult, directory: str, config: TrainingConfig,
               training_rows: int) -> str:
    model_path = f"{directory.rstrip('/')}/{MODEL_DIR}"
    best.model.write().overwrite().save(model_path)
    metadata = {
        "project": PROJECT,
        "model_name": best.name,
        "model_type": best.model_type,
        "feature_names": list(FEATURE_NAMES),
        "training_rows": int(training_rows),
        "trained_at": datetime.now(timezone.utc).astimezone().isoformat(),
        "training_config": config_dict(config),
        "metrics": best.metrics,
    }
    spark.createDataFrame([(json.dumps(metadata),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(f"{directory.rstrip('/')}/{METADATA_DIR}")
    return model_path


def load_model(spark: SparkSession, directory: str) -> PipelineModel:
    """Missing -> FileNotFoundError."""
    model_path = f"{directory.rstrip('/')}/{MODEL_DIR}"
    if not path_exists(spark, model_path):
        raise FileNotFoundError(f"no saved model in {model_path}")
    return PipelineModel.load(model_path)


def load_metadata(spark: SparkSession, directory: str) -> dict:
    """The metadata document; missing or not an object -> {}."""
    path = f"{directory.rstrip('/')}/{METADATA_DIR}"
    if not path_exists(spark, path):
        return {}
    documents = [r.value for r in spark.read.text(path, wholetext=True).collect() if r.value.strip()]
    try:
        loaded = json.loads(documents[0]) if documents else {}
    except json.JSONDecodeError:
        return {}
    return loaded if isinstance(loaded, dict) else {}


# ----------------------------------------------------------------------------- S11 / S12

def runs_frame(spark: SparkSession, results: list[CandidateResult], selected: str, training_rows: int,
               model_path: str | None, experiment: str = "fare-model") -> DataFrame:
    now = datetime.now(timezone.utc).isoformat()
    rows = [(uuid.uuid4().hex, experiment, r.name, {"candidate": r.name, **r.params}, int(training_rows),
             dict(r.metrics), r.name == selected, model_path if r.name == selected else None, now)
            for r in results]
    return spark.createDataFrame(rows, RUNS_SCHEMA)


def log_runs(spark: SparkSession, results: list[CandidateResult], selected: str, training_rows: int,
             runs_path: str, model_path: str | None) -> None:
    """One run per candidate appended to the runs table; the model only on the winner."""
    runs_frame(spark, results, selected, training_rows, model_path).coalesce(1) \
        .write.mode("append").parquet(runs_path)


def search_runs(spark: SparkSession, runs_path: str, candidate: str | None = None,
                selected: bool | None = None) -> DataFrame:
    """Runs filtered by candidate and/or the selected tag."""
    runs = spark.read.schema(RUNS_SCHEMA).parquet(runs_path)
    if candidate is not None:
        runs = runs.where(F.col("candidate") == candidate)
    if selected is not None:
        runs = runs.where(F.col("selected") == F.lit(selected))
    return runs
