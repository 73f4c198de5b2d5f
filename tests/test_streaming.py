"""Streaming results equal batch results."""

from pyspark.sql import functions as F

from tripparity.plans import catalog

from conftest import SF_SMALL


def _rows(df, cols):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def test_stream_parity_equals_batch(spark):
    stream = catalog.q_stream_parity_scored(spark, SF_SMALL)
    from tripparity.streaming.jobs import linear_scorer, scored_parity
    from tripparity.sources.requests import requests_from_trips
    from tripparity.sources.trips import load_trips
    batch = scored_parity(requests_from_trips(load_trips(spark, SF_SMALL)), linear_scorer())
    cols = ["request_id", "matched_count", "predicted_fare_amount"]
    assert _rows(stream, cols) == _rows(batch, cols)


def test_stream_windows_cover_every_served_row(spark):
    """Every window of at least 30 rows is reported with all its rows; smaller ones are not judged."""
    windows = catalog.q_stream_drift_windows(spark, SF_SMALL).where("feature = 'pickup_hour'")
    days = {r.day: r["count"] for r in catalog.served_log(spark, SF_SMALL).groupBy(
        F.date_trunc("day", "served_at").alias("day")).count().collect()}
    assert {r.window_start.replace(tzinfo=None): r.sample_count for r in windows.collect()} == \
        {d: n for d, n in ((d.replace(tzinfo=None), n) for d, n in days.items()) if n >= 30}
    assert any(n < 30 for n in days.values())


def test_stream_rolling_report_matches_batch(spark):
    assert catalog.q_stream_rolling_drift(spark, SF_SMALL).collect() == \
        catalog.q_drift_report_overall(spark, SF_SMALL).collect()


def test_rolling_buffer_stays_bounded_across_batches(spark):
    """Three micro-batches (one file each): the buffer never exceeds N rows and ends as the top N."""
    from tripparity.operators import drift
    from tripparity.session import scratch_path
    from tripparity.sources.trips import read_table
    from tripparity.streaming import jobs as streaming

    events = read_table(spark, SF_SMALL, "events")
    source = scratch_path(spark, "events-split")
    for i in range(3):  # three separate writes -> three files in one folder
        events.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(source)
    base = scratch_path(spark, "rolling")
    query = streaming.start_rolling_drift(spark, source, catalog.reference(spark, SF_SMALL), f"{base}/log",
                                          f"{base}/reports", f"{base}/rejects", f"{base}/ckpt",
                                          buffer_size=50, max_files_per_trigger=1)
    query.awaitTermination()
    buffers = spark.read.parquet(f"{base}/log_buffer")
    sizes = {r.batch_id: r["count"] for r in buffers.groupBy("batch_id").count().collect()}
    assert sorted(sizes) == [1, 2] and max(sizes.values()) <= 50  # the last two are kept
    expected = drift.latest(spark.read.parquet(f"{base}/log").drop("batch_id"), 50)
    got = buffers.where(F.col("batch_id") == max(sizes)).drop("batch_id")
    assert sorted(r.request_id for r in got.collect()) == sorted(r.request_id for r in expected.collect())
    assert spark.read.parquet(f"{base}/reports").select("batch_id").distinct().count() == 3


def test_windowed_drift_append_mode_emits_closed_windows_once(spark):
    """Production mode: each daily window is written once, after the watermark passes it."""
    from tripparity.session import scratch_path
    from tripparity.streaming import jobs as streaming

    sink, ckpt = scratch_path(spark, "win-append"), scratch_path(spark, "win-append-ckpt")
    query = streaming.start_windowed_drift(spark, f"{SF_SMALL}/events.parquet", catalog.reference(spark, SF_SMALL),
                                           sink, ckpt, output_mode="append")
    query.awaitTermination()
    appended = spark.read.parquet(sink)
    complete = catalog.q_stream_drift_windows(spark, SF_SMALL)
    starts = [r.window_start for r in appended.select("window_start").distinct().collect()]
    assert len(starts) == len(set(starts)) >= 1
    # every emitted window equals the complete-mode result for that window
    cols = ["window_start", "feature", "sample_count"]
    emitted = _rows(appended, cols)
    assert set(emitted) <= set(_rows(complete, cols))
    # the newest window stays open (held back by the watermark) in append mode
    assert max(starts) < max(r.window_start for r in complete.select("window_start").collect())


def test_windows_do_not_depend_on_the_session_time_zone(spark):
    cols = ["window_start", "feature", "sample_count", "psi"]
    utc = _rows(catalog.q_stream_drift_windows(spark, SF_SMALL), cols)
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        la = _rows(catalog.q_stream_drift_windows(spark, SF_SMALL), cols)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert utc == la


def test_stream_scoring_with_a_fitted_model_equals_batch(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import GBTRegressor

    from tripparity.operators import models
    from tripparity.session import scratch_path
    from tripparity.sources.requests import requests_from_trips
    from tripparity.sources.trips import load_trips
    from tripparity.streaming import jobs as streaming

    table = models.feature_frame(catalog.training_table(spark, SF_SMALL))
    model = Pipeline(stages=[models.assembler(), GBTRegressor(labelCol="fare_amount", maxIter=3, maxDepth=3)]).fit(table)
    sink, ckpt = scratch_path(spark, "stream-model"), scratch_path(spark, "stream-model-ckpt")
    query = streaming.start_scored_parity(spark, f"{SF_SMALL}/events.parquet", sink, ckpt,
                                         streaming.model_scorer(model))
    query.awaitTermination()
    stream = spark.read.parquet(sink)
    batch = streaming.scored_parity(requests_from_trips(load_trips(spark, SF_SMALL)), streaming.model_scorer(model))
    cols = ["request_id", "predicted_fare_amount", "prediction_finite"]
    assert _rows(stream, cols) == _rows(batch, cols)


def test_json_stream_puts_every_request_in_one_sink_and_restarts(spark):
    """Stopped after the first files and started again on the same checkpoint: nothing twice, nothing lost, equal to batch."""
    from tripparity.operators import pairs
    from tripparity.session import scratch_path
    from tripparity.sources.requests import parse_json_requests
    from tripparity.streaming import jobs as streaming

    wire = catalog.damaged_wire(spark, SF_SMALL)
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "[]"), (-4, "{}"), (None, "null")], streaming.WIRE_SCHEMA)
    base = scratch_path(spark, "json-restart")
    halves = [wire.where("request_id % 2 = 0").repartition(2), wire.where("request_id % 2 = 1").unionByName(extra).repartition(3)]
    for half in halves:
        half.write.mode("append").parquet(f"{base}/wire")
        streaming.start_json_scoring(streaming.wire_stream(spark, f"{base}/wire", 1), f"{base}/scored", f"{base}/rejects",
                                     f"{base}/ckpt", streaming.linear_scorer()).awaitTermination()
    scored, rejects = spark.read.parquet(f"{base}/scored"), spark.read.parquet(f"{base}/rejects")
    assert scored.select("batch_id").distinct().count() > 2
    batch = pairs.serve_requests(parse_json_requests(halves[0].unionByName(halves[1]), id_column="request_id"))
    cols = ["request_id", "matched_count", "predicted_fare_amount"]
    assert _rows(scored, cols) == _rows(streaming.scored_served(batch, streaming.linear_scorer()), cols)
    key = lambda df: sorted((str(r.request_id), *r.rejection_reasons) for r in df.collect())
    assert key(rejects) == key(pairs.rejected(batch)) and rejects.where("request_id < 0 OR request_id IS NULL").count() == 5
