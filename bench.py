"""Benchmark of the headline jobs.

Runs each query over the tables in ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line. Every query is executed in full through Spark's
``noop`` sink (all rows computed, nothing collected). Each query runs ``$BENCH_REPEAT`` times
(default 2); the first run pays code generation and JIT, the reported time is the fastest run and
the first-run times are reported separately. ``BENCH_TRAIN=1`` adds the full training job.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tripparity.operators import explain, models  # noqa: E402
from tripparity.plans import catalog  # noqa: E402
from tripparity.session import build_session  # noqa: E402

HEADLINE = (
    "trips_violation_counts",
    "features_training",
    "requests_rejected",
    "parity_report_counts",
    "parity_mismatches",
    "parity_rollup",
    "parity_tables_joined",
    "ref_stats_proportions",
    "drift_report_features",
    "drift_by_group",
    "metrics_by_skew",
    "linear_contributions",
    "stream_parity_scored",
    "stream_drift_windows",
    "tree_train",
    "tree_score",
    "tree_explain",
)

# Queries that are also run on the events REPLICAS times over, to show rows per second at both sizes.
SCALED = ("features_training", "parity_report_counts", "ref_stats_proportions", "drift_by_group")
REPLICAS = int(os.environ.get("BENCH_REPLICAS", "20"))


class Trees:
    """Boosted trees (20 rounds) over all trips: training, scoring and explaining, timed one by one."""

    model = None

    @classmethod
    def tree_train(cls, spark, sf_dir):
        config = models.TrainingConfig(n_estimators=20)
        table = catalog.training_table(spark, sf_dir)
        cls.model = models.compare_models(table, config, candidates=("gradient_boosted_trees",))[0].model
        return table.limit(1)

    @classmethod
    def tree_score(cls, spark, sf_dir):
        return models.score(catalog.training_table(spark, sf_dir), cls.model)

    @classmethod
    def tree_explain(cls, spark, sf_dir):
        table = catalog.training_table(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism)
        return explain.explain_trees(table, cls.model, keep=("trip_id",))


def _replicated(spark, sf_dir: str) -> str:
    """A folder whose events are the given ones REPLICAS times, ids continued."""
    folder = tempfile.mkdtemp(prefix="bench-replicas-")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    step = events.agg(F.max("event_id")).first()[0] + 1
    copies = events.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(REPLICAS - 1))))
    copies.withColumn("event_id", F.col("event_id") + F.col("copy") * step).drop("copy") \
        .repartition(spark.sparkContext.defaultParallelism).write.parquet(f"{folder}/events.parquet")
    return folder


def _run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    df = (getattr(Trees, name, None) or catalog.all_queries()[name])(spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "2")))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, app_name="tripparity-bench",
                          extra={"spark.driver.memory": "16g"})
    names = list(HEADLINE)
    if os.environ.get("BENCH_TRAIN") == "1":
        names.append("model_comparison")
    best, first = {}, {}
    for name in names:
        times = [_run(spark, name, sf_dir) for _ in range(repeat if name != "model_comparison" else 1)]
        first[name] = round(times[0], 3)
        best[name] = round(min(times), 3)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    large = _replicated(spark, sf_dir)
    scaled = {}
    for name in SCALED:
        seconds = min(_run(spark, name, large) for _ in range(repeat))
        scaled[name] = {"rows_per_s": round(rows / best[name]) if name in best else None,
                        f"rows_per_s_x{REPLICAS}": round(rows * REPLICAS / seconds), "seconds": round(seconds, 3)}
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "sum_of_query_seconds", "value": round(sum(best.values()), 3), "unit": "sec",
                      "queries": best, "first_run": first, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": int(cpus), "scaled": scaled}))
    spark.stop()


if __name__ == "__main__":
    main()
