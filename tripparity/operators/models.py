"""M2-M9: three MLlib regressors compared on one stable split, selection, scoring.

Roles follow the reference (a ridge regression, a random forest, an L1 boosted ensemble); the
learners' rules are MLlib's, so numbers are "same role, not same values". The two tree ensembles are
grown by :mod:`tripparity.operators.trees` into MLlib's models. The split is a deterministic
hash of the trip key, the same for all three fits.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripparity.functions.numeric import is_finite
from tripparity.operators import trees
from tripparity.operators.metrics import METRIC_NAMES, regression_metrics, with_exact_split, with_split
from tripparity.operators.vector import FEATURE_NAMES

# Fixed values of training.
MINIMUM_TRAINING_ROWS = 20
RANDOM_FOREST_N_ESTIMATORS = 200
LABEL = "fare_amount"
CANDIDATES = ("ridge", "random_forest", "gradient_boosted_trees")


@dataclass(frozen=True)
class TrainingConfig:
    validation_size: float = 0.2
    random_state: int = 42
    n_estimators: int = 300
    learning_rate: float = 0.05
    num_leaves: int = 31
    min_child_samples: int = 20
    ridge_alpha: float = 1.0
    forest_trees: int = RANDOM_FOREST_N_ESTIMATORS
    # MLlib trees are at most 30 deep. Boosted depth follows num_leaves (31 -> 5).
    forest_max_depth: int = 30
    max_bins: int = 512  # every one of 263 zones can be a threshold
    exact_split: bool = False  # hold out exactly ceil(validation_size * rows) instead of one hash bucket
    # Per-task memory for MLlib's split statistics; every concurrent task holds this much, so it
    # must fit executor memory / cores.
    max_memory_mb: int = 256

    @property
    def validation_buckets(self) -> int:
        return max(2, round(1 / self.validation_size))

    @property
    def boosted_max_depth(self) -> int:
        return max(1, math.ceil(math.log2(self.num_leaves + 1)))


@dataclass
class CandidateResult:
    name: str
    order: int
    model: PipelineModel
    metrics: dict[str, float]
    params: dict[str, str] = field(default_factory=dict)

    @property
    def model_type(self) -> str:
        return type(self.model.stages[-1]).__name__


def assembler() -> VectorAssembler:
    """Features in contract order. Invalid values are passed to the model ("keep"), so a bad
    input surfaces as a non-finite prediction (flagged, or an error under ``strict``); training
    tables are contract-checked before they get here."""
    return VectorAssembler(inputCols=list(FEATURE_NAMES), outputCol="features", handleInvalid="keep")


def feature_frame(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Features as doubles plus kept columns (label included when present)."""
    extra = [c for c in keep if c in df.columns]
    label = [F.col(LABEL).cast("double").alias(LABEL)] if LABEL in df.columns and LABEL not in keep else []
    return df.select(*extra, *[F.col(n).cast("double").alias(n) for n in FEATURE_NAMES], *label)


def build_candidates(config: TrainingConfig, label_std: float, train_rows: int) -> dict[str, object]:
    """M2-M4. Ridge: MLlib scales the L2 term by the label's std, so ``alpha * std / n`` matches a
    closed-form ridge with penalty ``alpha`` on an unstandardised design."""
    reg = config.ridge_alpha * label_std / max(train_rows, 1)
    return {
        "ridge": LinearRegression(labelCol=LABEL, regParam=reg, elasticNetParam=0.0,
                                  standardization=False, solver="normal", fitIntercept=True),
        "random_forest": RandomForestRegressor(labelCol=LABEL, numTrees=config.forest_trees,
                                               featureSubsetStrategy="all",
                                               maxDepth=config.forest_max_depth, maxBins=config.max_bins,
                                               maxMemoryInMB=config.max_memory_mb, seed=config.random_state),
        "gradient_boosted_trees": GBTRegressor(labelCol=LABEL, lossType="absolute",
                                               maxIter=config.n_estimators, stepSize=config.learning_rate,
                                               maxDepth=config.boosted_max_depth,
                                               minInstancesPerNode=config.min_child_samples,
                                               maxBins=config.max_bins, maxMemoryInMB=config.max_memory_mb,
                                               seed=config.random_state),
    }


def compare_models(features: DataFrame, config: TrainingConfig | None = None, key: str = "trip_id",
                   candidates: tuple[str, ...] = CANDIDATES) -> list[CandidateResult]:
    """M5: fit every candidate on the same split and score MAE/RMSE/R^2 on the held-out part.

    ``features`` is read by the ridge fit and put into bins for the other two, better a written table, as in the training job.
    """
    config = config or TrainingConfig()
    split = with_exact_split if config.exact_split else with_split
    data = split(feature_frame(features, keep=(key,)), key, config.validation_buckets)
    stats = data.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(LABEL).isNull()).alias("nulls"),
                     F.count_if(~F.col("is_validation")).alias("train_n"),
                     F.stddev_pop(F.when(~F.col("is_validation"), F.col(LABEL))).alias("train_std")
                     ).collect()[0]
    if stats["nulls"]:
        raise ValueError("the target must not contain nulls")
    if stats["n"] < MINIMUM_TRAINING_ROWS:
        raise ValueError(f"{MINIMUM_TRAINING_ROWS} valid rows are the least to train on, found {stats['n']}")
    train = data.where(~F.col("is_validation"))
    validation = data.where(F.col("is_validation"))
    built = build_candidates(config, float(stats["train_std"] or 0.0), int(stats["train_n"]))
    results, binned = [], None
    for order, name in enumerate(candidates):
        estimator = built[name]
        if name == "ridge":
            model = Pipeline(stages=[assembler(), estimator]).fit(train)
        else:
            binned = binned or trees.binned(train, FEATURE_NAMES, LABEL, config.max_bins)
            model = PipelineModel([assembler(), trees.fit(train.sparkSession, binned, estimator)])
        row = regression_metrics(model.transform(validation)).collect()[0]
        metrics = {m: float(row[m]) for m in METRIC_NAMES}
        params = {p.name: str(v) for p, v in estimator.extractParamMap().items()}
        params["training_rows"] = str(stats["train_n"])
        results.append(CandidateResult(name, order, model, metrics, params))
    if binned:
        trees.release(train.sparkSession, binned)
    return results


def select_best_model(results: list[CandidateResult], metric: str = "root_mean_squared_error"
                      ) -> CandidateResult:
    """M6: lowest metric, first candidate wins ties."""
    if not results:
        raise ValueError("no candidate to choose from")
    return min(results, key=lambda r: (r.metrics[metric], r.order))


def config_dict(config: TrainingConfig) -> dict[str, float]:
    return {k: float(v) for k, v in asdict(config).items()}


# ----------------------------------------------------------------------------- scoring (M8, M9)

def score(df: DataFrame, model: PipelineModel, prefix: str = "", strict: bool = False,
          output: str = "predicted_fare_amount") -> DataFrame:
    """M8: one prediction per row from the (optionally prefixed) feature columns.

    Non-finite predictions are flagged in ``prediction_finite``; with ``strict`` they raise.
    """
    if prefix:
        # Input columns named like features (e.g. raw request fields) are set aside meanwhile.
        clash = [c for c in df.columns if c in FEATURE_NAMES]
        base = df.select(*[F.col(c).alias(f"__orig_{c}") if c in clash else F.col(c) for c in df.columns])
        inputs = base.select("*", *[F.col(f"{prefix}{n}").cast("double").alias(n) for n in FEATURE_NAMES])
    else:
        clash = []
        inputs = df.select(*[c for c in df.columns if c not in FEATURE_NAMES],
                           *[F.col(n).cast("double").alias(n) for n in FEATURE_NAMES])
    scored = model.transform(inputs).withColumnRenamed("prediction", output).drop("features")
    if prefix:
        scored = scored.drop(*FEATURE_NAMES)
        for c in clash:
            scored = scored.withColumnRenamed(f"__orig_{c}", c)
    finite = is_finite(F.col(output))
    if strict:
        scored = scored.withColumn(output, F.when(finite, F.col(output)).otherwise(
            F.raise_error(F.lit("prediction is not a finite number"))))
    return scored.withColumn("prediction_finite", finite)


def linear_score(distance: Column, intercept: float = 3.0, slope: float = 2.5) -> Column:
    """The deterministic test scorer ``3.0 + 2.5 * distance`` as a column."""
    return F.lit(intercept) + F.lit(slope) * distance.cast("double")
