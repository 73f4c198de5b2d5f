"""The batch operators, unchanged, over Structured Streaming.

R1 streams requests through validation, feature pairs, parity and scoring (stateless, append).
R2 keeps a served log and a rolling last-N drift report with ``foreachBatch``; both writes are keyed
   by the batch id, so a replayed batch overwrites its own output instead of duplicating it.
R3 computes drift per event-time window with a watermark: one stateful aggregation (count, means,
   bin counts), PSI as a projection afterwards.
R4 writes rejected requests to a second sink of the same ``foreachBatch``; wire JSON streams (R1) have one too.
Checkpoints live under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pyspark.sql.types import TimestampNTZType, TimestampType

from tripparity.functions.arrays import bin_counts, bin_index_literal, psi_status
from tripparity.functions.time import utc_instant, utc_wall_clock
from tripparity.operators import drift, models, pairs, parity
from tripparity.operators.vector import FEATURE_NAMES
from tripparity.session import delete_path, path_exists
from tripparity.sources.requests import parse_json_requests, requests_from_trips
from tripparity.sources.trips import trips_from_events


def events_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream of ``events`` with the schema of the files already there.

    ``path`` is a folder of event files, or one file (streamed as its folder filtered to that name).
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if path.rstrip("/").endswith(".parquet"):
        folder, name = path.rstrip("/").rsplit("/", 1)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def requests_stream(spark: SparkSession, events_path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    return requests_from_trips(trips_from_events(events_stream(spark, events_path, max_files_per_trigger)))


Scorer = Callable[[DataFrame], DataFrame]


def linear_scorer(intercept: float = 3.0, slope: float = 2.5) -> Scorer:
    def run(df: DataFrame) -> DataFrame:
        return df.withColumn("predicted_fare_amount",
                             models.linear_score(F.col(f"{pairs.SERVING_PREFIX}trip_distance_miles"),
                                                 intercept, slope))
    return run


def model_scorer(model: PipelineModel) -> Scorer:
    def run(df: DataFrame) -> DataFrame:
        return models.score(df, model, prefix=pairs.SERVING_PREFIX)
    return run


def scored_parity(requests: DataFrame, scorer: Scorer) -> DataFrame:
    """R1 body (also used by batch): accepted requests with parity counts and a prediction."""
    return scored_served(pairs.serve_requests(requests), scorer)


def scored_served(served: DataFrame, scorer: Scorer) -> DataFrame:
    """The accepted ones of served requests, with parity counts and a prediction."""
    reported = parity.parity_report(pairs.accepted(served))
    time = [c for c in ("served_at",) if c in served.columns]
    flat = reported.select("request_id", *time, "feature_mode", "applied_skew_mode",
                           F.col("parity.matched_count").alias("matched_count"),
                           F.col("parity.mismatch_count").alias("mismatch_count"),
                           *[F.col(f"{pairs.SERVING_PREFIX}{n}") for n in FEATURE_NAMES])
    return scorer(flat)


def start_scored_parity(spark: SparkSession, events_path: str, sink_path: str, checkpoint: str,
                        scorer: Scorer, available_now: bool = True) -> StreamingQuery:
    """Stateless stream -> Parquet sink (append, exactly-once through the checkpoint)."""
    out = scored_parity(requests_stream(spark, events_path), scorer)
    writer = out.writeStream.format("parquet").option("path", sink_path) \
        .option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


WIRE_SCHEMA = "request_id long, value string"


def wire_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A stream of wire requests: a folder of Parquet files of (request_id, value = JSON document)."""
    reader = spark.readStream.schema(WIRE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def start_json_scoring(wire: DataFrame, sink_path: str, rejects_path: str, checkpoint: str, scorer: Scorer,
                       available_now: bool = True) -> StreamingQuery:
    """R1 + R4 from wire JSON: per micro-batch, scored requests to one sink, rejected ones with all their reasons to the other.

    ``wire`` is any stream with the columns of ``WIRE_SCHEMA`` (``wire_stream``, or keys and values of
    a log). Every request of a batch lands in exactly one of the two sinks, in the batch's own folder,
    which a replayed batch rewrites.
    """
    served = pairs.serve_requests(parse_json_requests(wire, id_column="request_id"))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for rows, path in ((scored_served(batch, scorer), sink_path),
                               (pairs.rejected(batch).select("request_id", "rejection_reasons"), rejects_path)):
                rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    writer = served.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def start_rolling_drift(spark: SparkSession, events_path: str, reference: drift.ReferenceStats,
                        served_log_path: str, reports_path: str, rejects_path: str, checkpoint: str,
                        buffer_size: int = drift.DEFAULT_BUFFER_SIZE,
                        available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """R2 + R4: per micro-batch, record served vectors and rejects, then report last-N drift.

    The last-N buffer is its own small table (``<served_log>_buffer``): batch k's buffer is the
    latest N of batch k-1's buffer plus batch k's rows, so each batch touches O(N + batch) rows
    however long the served log grows. Every batch writes and reads its own ``batch_id`` folders by
    name, so a replayed batch rewrites exactly its own output and nothing lists the others; the
    buffers before k-1 are dropped.
    """
    served = pairs.serve_requests(requests_stream(spark, events_path, max_files_per_trigger))
    buffer_path = served_log_path.rstrip("/") + "_buffer"

    def folder(path: str, batch_id: int) -> str:
        return f"{path.rstrip('/')}/batch_id={batch_id}"

    def replace_partition(df: DataFrame, path: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(folder(path, batch_id))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        batch = batch.persist()
        try:
            log = pairs.accepted(batch).select(
                "request_id", "served_at", *[F.col(f"{pairs.SERVING_PREFIX}{n}").alias(n) for n in FEATURE_NAMES])
            replace_partition(log, served_log_path, batch_id)
            replace_partition(pairs.rejected(batch).select("request_id", "rejection_reasons"), rejects_path,
                              batch_id)
            candidates = log
            if batch_id > 0 and path_exists(session, folder(buffer_path, batch_id - 1)):
                candidates = session.read.schema(log.schema).parquet(folder(buffer_path, batch_id - 1)).unionByName(log)
            replace_partition(drift.latest(candidates, buffer_size), buffer_path, batch_id)
            buffer = session.read.schema(log.schema).parquet(folder(buffer_path, batch_id))
            _, overall = drift.drift_report(buffer, reference)
            replace_partition(overall, reports_path, batch_id)
            delete_path(session, folder(buffer_path, batch_id - 2))
        finally:
            batch.unpersist()

    writer = served.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def windowed_drift(served: DataFrame, reference: drift.ReferenceStats, window: str = "1 day",
                   watermark: str = "1 day", slide: str | None = None, time_column: str = "served_at"
                   ) -> DataFrame:
    """PSI per event-time window. Rows later than the watermark are dropped by Spark.

    ``served`` holds the nine serving features as plain columns. The state per window is a fixed
    set of counters (1 + 9 sums + at most 90 bin counts), independent of the traffic volume.
    """
    if isinstance(served.schema[time_column].dataType, TimestampNTZType):
        served = served.withColumn(time_column, utc_instant(F.col(time_column)))
    w = F.window(time_column, window, slide) if slide else F.window(time_column, window)
    served = served.select(time_column, *[F.col(name).cast("double").alias(f"x{i}")
                                          for i, name in enumerate(FEATURE_NAMES)])
    served = served.select("*", *[bin_index_literal(f"x{i}", list(reference[name].bin_edges))
                                  .alias(f"b{i}") for i, name in enumerate(FEATURE_NAMES)])
    aggs = [F.count(F.lit(1)).alias("sample_count")]
    for i, name in enumerate(FEATURE_NAMES):
        aggs.append(F.avg(F.col(f"x{i}")).alias(f"mean{i}"))
        aggs += bin_counts(f"b{i}", len(reference[name].bin_edges) - 1, f"c{i}_")
    grouped = served.withWatermark(time_column, watermark).groupBy(w.alias("window")).agg(*aggs)
    return grouped


def _scored_windows(windows: DataFrame, reference: drift.ReferenceStats) -> DataFrame:
    psi = [drift.psi_expression(reference[name], f"c{i}_", "sample_count").alias(f"psi{i}")
           for i, name in enumerate(FEATURE_NAMES)]
    # Window bounds are reported as UTC wall clocks, like the input's served_at.
    return windows.select(utc_wall_clock(F.col("window.start"), TimestampType()).alias("window_start"),
                            utc_wall_clock(F.col("window.end"), TimestampType()).alias("window_end"),
                            "sample_count", *[F.col(f"mean{i}") for i in range(len(FEATURE_NAMES))], *psi)


def windowed_drift_features(windows: DataFrame, reference: drift.ReferenceStats,
                            min_samples: int = drift.MINIMUM_SAMPLES_FOR_DRIFT) -> DataFrame:
    """PSI rows (window_start, window_end, sample_count, feature, psi, status, current_mean).

    Windows with fewer than ``min_samples`` rows have none. PSI is projected into plain columns first
    and then unpivoted, which keeps the generator small.
    """
    scored = _scored_windows(windows, reference).where(F.col("sample_count") >= min_samples)
    rows = [F.struct(F.lit(name).alias("feature"), F.col(f"psi{i}").alias("psi"),
                     psi_status(F.col(f"psi{i}")).alias("status"), F.col(f"mean{i}").alias("current_mean"))
            for i, name in enumerate(FEATURE_NAMES)]
    return scored.select("window_start", "window_end", "sample_count", F.inline(F.array(*rows)))


def windowed_drift_overall(windows: DataFrame, reference: drift.ReferenceStats,
                           min_samples: int = drift.MINIMUM_SAMPLES_FOR_DRIFT) -> DataFrame:
    """One row per window (window_start, window_end, sample_count, status): the worst feature's status,
    or insufficient_data under ``min_samples`` rows."""
    scored = _scored_windows(windows, reference)
    worst = drift.worst_status([psi_status(F.col(f"psi{i}")) for i in range(len(FEATURE_NAMES))])
    return scored.select("window_start", "window_end", "sample_count", F.when(
        F.col("sample_count") < min_samples, F.lit(drift.STATUS_INSUFFICIENT)).otherwise(worst).alias("status"))


def start_windowed_drift(spark: SparkSession, events_path: str, reference: drift.ReferenceStats,
                         sink_path: str, checkpoint: str, output_mode: str = "append",
                         window: str = "1 day", watermark: str = "1 day",
                         available_now: bool = True, overall: bool = False) -> StreamingQuery:
    """R3 as a running query. ``append`` emits each window once it closes (production);
    ``complete`` rewrites all windows every batch (bounded inputs and tests). The sink gets the
    features' rows, or with ``overall`` one status per window."""
    served = pairs.accepted(pairs.serve_requests(requests_stream(spark, events_path))).select(
        "served_at", *[F.col(f"{pairs.SERVING_PREFIX}{n}").alias(n) for n in FEATURE_NAMES])
    windows = windowed_drift(served, reference, window, watermark)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        result = (windowed_drift_overall if overall else windowed_drift_features)(batch, reference)
        if output_mode == "complete":
            result.write.mode("overwrite").parquet(sink_path)
        else:  # keyed by batch id, so a replayed batch replaces its own rows
            result.write.mode("overwrite").parquet(f"{sink_path.rstrip('/')}/batch_id={batch_id}")

    writer = windows.writeStream.outputMode(output_mode).foreachBatch(per_batch) \
        .option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
