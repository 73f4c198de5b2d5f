"""Reference statistics and PSI drift, cross-checked with NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tripparity.functions.numeric import ordered_key
from tripparity.operators import drift
from tripparity.operators.vector import FEATURE_NAMES
from tripparity.plans import catalog
from tripparity.session import scratch_path
from tripparity.sources import artifacts

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def training(spark):
    return catalog.training_table(spark, SF_SMALL).cache()


@pytest.fixture(scope="module")
def reference(training):
    return drift.compute_reference_stats(training)


def test_edges_are_pinned_and_proportions_sum_to_one(reference):
    for name in FEATURE_NAMES:
        stats = reference[name]
        assert stats.bin_edges[0] == -np.inf and stats.bin_edges[-1] == np.inf
        assert sum(stats.bin_proportions) == pytest.approx(1.0)
        assert len(stats.bin_proportions) == len(stats.bin_edges) - 1
    assert reference["pickup_month"].bin_edges == (-np.inf, np.inf)  # constant month: one bin


def test_matches_numpy(training, reference):
    pdf = training.toPandas()
    for name in FEATURE_NAMES:
        x = pdf[name].to_numpy(dtype="float64")
        edges = np.unique(np.round(np.quantile(x, np.linspace(0, 1, 11)), 9))
        edges = np.array([edges[0] - 0.5, edges[0] + 0.5]) if edges.size < 2 else edges
        edges[0], edges[-1] = -np.inf, np.inf
        counts, _ = np.histogram(x, bins=edges)
        stats = reference[name]
        assert np.allclose(stats.bin_edges, edges, rtol=0, atol=1e-9)
        assert np.allclose(stats.bin_proportions, counts / counts.sum())
        assert stats.mean == pytest.approx(x.mean()) and stats.std == pytest.approx(x.std())


def test_ordered_keys_are_the_bits_of_the_double(spark):
    rng = np.random.default_rng(0)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.0 ** -1022, np.nextafter(2.0 ** -1022, 0), 1.7976931348623157e308, np.inf, -np.inf]
    values += [v for k in range(-1074, 1024) for p in (2.0 ** k,) for v in (p, -p, np.nextafter(p, 0), np.nextafter(p, np.inf))]
    values += rng.integers(-2 ** 63, 2 ** 63 - 1, 3000).view(np.float64).tolist()
    values = [float(v) for v in values if not np.isnan(v)]
    found = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double").select("x", ordered_key("x").alias("k")).collect()
    assert [r["k"] for r in found[-2:]] == [None, None]
    for r in found[:-2]:
        bits = int(np.float64(abs(r["x"])).view(np.int64))
        assert r["k"] == (-1 - bits if r["x"] < 0 else bits)


@pytest.mark.parametrize("rows, partitions", [(5_000_000, 16), (11, 3), (1, 1)])
def test_deciles_of_distinct_doubles_equal_numpy(spark, rows, partitions):
    """Radix selection over values that are nearly all different, of both signs and many magnitudes."""
    frame = spark.range(0, rows, 1, partitions).select(
        F.expr("CASE WHEN id % 7 = 0 THEN NULL ELSE (cast(xxhash64(id) AS double) / 9.3e18) * power(10D, id % 9 - 4) END").alias("x"),
        F.expr("cast(id % 3 AS double)").alias("few"))
    if rows == 1:
        frame = frame.withColumn("x", F.lit(-2.5))
    stats = drift.compute_reference_stats(frame, columns=("x", "few"))
    pdf = frame.toPandas()
    for name in ("x", "few"):
        x = pdf[name].dropna().to_numpy()
        edges = np.unique(np.round(np.quantile(x, np.linspace(0, 1, 11)), 9))
        edges = np.array([-np.inf, *edges[1:-1], np.inf]) if edges.size > 1 else np.array([-np.inf, np.inf])
        assert np.array_equal(stats[name].bin_edges, edges)
        assert np.allclose(stats[name].bin_proportions, np.histogram(x, bins=edges)[0] / len(x), rtol=0, atol=1e-15)
        assert stats[name].mean == pytest.approx(x.mean()) and stats[name].std == pytest.approx(x.std())
        assert (stats[name].minimum, stats[name].maximum) == (x.min(), x.max())


def test_no_exchange_grows_with_the_values(spark, training):
    values = drift._values(training, FEATURE_NAMES)
    plan = drift._histogram(values, {0: {16384}}, 2)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    exchanges = [line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]
    assert len(exchanges) == 1 and "hashpartitioning(f#" in exchanges[0] and "x#" not in exchanges[0]
    assert plan.count("HashAggregate") == 2  # counted in the task before the exchange


@pytest.mark.parametrize("bad, said", [(float("nan"), "1 values are not finite"), (float("-inf"), "1 values are not finite"), (None, "no value")])
def test_columns_without_statistics_are_named(spark, bad, said):
    frame = spark.createDataFrame([(1.0, bad), (2.0, None)], "x double, y double")
    with pytest.raises(ValueError, match=f"y: {said}"):
        drift.compute_reference_stats(frame, columns=("x", "y"))
    with pytest.raises(ValueError, match="at least one row"):
        drift.compute_reference_stats(frame.limit(0), columns=("x",))


def test_psi_self_is_small_and_shift_is_significant(spark, training, reference):
    features, overall = drift.drift_report(training, reference)
    assert all(r.psi < 0.05 for r in features.collect())
    assert overall.first().status == "stable"
    shifted = training.withColumn("trip_distance_miles", F.col("trip_distance_miles") + 500)
    rows = {r.feature: r for r in drift.drift_report(shifted, reference)[0].collect()}
    assert rows["trip_distance_miles"].psi > 1 and rows["trip_distance_miles"].status == "significant"
    assert rows["passenger_count"].status == "stable"
    pdf = shifted.toPandas()
    stats = reference["trip_distance_miles"]
    counts, _ = np.histogram(pdf["trip_distance_miles"], bins=np.array(stats.bin_edges))
    now, then = (np.maximum(p, 1e-6) for p in (counts / counts.sum(), np.array(stats.bin_proportions)))
    assert rows["trip_distance_miles"].psi == pytest.approx(((now - then) * np.log(now / then)).sum())


def test_gates(spark, training, reference):
    small = drift.latest(training.withColumn("served_at", F.timestamp_seconds("trip_id")).withColumn(
        "request_id", F.col("trip_id")), 29)
    features, overall = drift.drift_report(small, reference)
    assert features.count() == 0
    assert overall.first().asDict() == {"status": "insufficient_data", "sample_count": 29,
                                        "reference_available": True}
    features, overall = drift.drift_report(training, None)
    assert features.count() == 0 and overall.first().status == "unavailable"


def test_save_and_load_round_trip(spark, reference):
    path = scratch_path(spark, "ref-stats")
    artifacts.save_reference_stats(spark, reference, path)
    assert artifacts.load_reference_stats(spark, path) == reference
    assert artifacts.load_reference_stats(spark, path + "-missing") is None


@pytest.mark.parametrize("n", [5, 500, 2000])
def test_latest_keeps_the_newest_rows(spark, n):
    log = catalog.served_log(spark, SF_SMALL).select("request_id", "served_at", "event_type").cache()
    rows = sorted(map(tuple, log.collect()), key=lambda r: (r[1], r[0]), reverse=True)
    assert sorted(map(tuple, drift.latest(log, n).collect())) == sorted(rows[:n])
    by_group = {}
    for r in rows:
        by_group.setdefault(r[2], []).append(r)
    want = [r for group in by_group.values() for r in group[:n]]
    assert sorted(map(tuple, drift.latest_per_group(log, "event_type", n, salts=4).collect())) == sorted(want)


@pytest.mark.parametrize("n", [500, 2000])
def test_a_hot_group_is_spread_whatever_the_buffer_size(spark, n):
    """Two ranks: by (group, salt) first, so no exchange deals all of a group's rows by the group alone."""
    limited = drift.latest_per_group(catalog.served_log(spark, SF_SMALL), "event_type", n)
    plan = limited._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 2 and sum("_salt" in line for line in exchanges) == 1


def test_exact_statistics_of_many_distinct_values(spark):
    x = np.random.default_rng(3).lognormal(size=1_200_000)
    frame = spark.createDataFrame(pd.DataFrame({"x": x})).repartition(8)
    stats = drift.compute_reference_stats(frame, columns=("x",))["x"]
    edges = np.quantile(x, np.linspace(0, 1, 11))
    counts, _ = np.histogram(x, bins=np.concatenate([[-np.inf], np.round(edges[1:-1], 9), [np.inf]]))
    assert np.allclose(stats.bin_edges[1:-1], edges[1:-1], rtol=0, atol=1e-9)
    assert np.allclose(stats.bin_proportions, counts / len(x), rtol=0, atol=1e-12)
    assert stats.mean == pytest.approx(x.mean()) and stats.std == pytest.approx(x.std())
    assert (stats.minimum, stats.maximum) == (x.min(), x.max())


def test_a_reference_without_all_proportions_is_refused(training, reference):
    short = dict(reference)
    stats = reference["trip_distance_miles"]
    short["trip_distance_miles"] = drift.FeatureReference(stats.mean, stats.std, stats.minimum, stats.maximum,
                                                          stats.bin_edges, stats.bin_proportions[:3])
    with pytest.raises(ValueError):
        drift.drift_report(training, short)


def test_reference_stats_do_not_depend_on_partitioning(training, reference):
    again = drift.compute_reference_stats(training.repartition(7))
    for name in FEATURE_NAMES:
        assert again[name].bin_edges == reference[name].bin_edges
        assert again[name].bin_proportions == reference[name].bin_proportions
        assert again[name].mean == pytest.approx(reference[name].mean, rel=1e-12)


def _log(spark, rows):
    names = ", ".join(f"{n} double" for n in FEATURE_NAMES)
    return spark.createDataFrame([(at, i, *[float(x + k) for k in range(9)]) for i, (at, x) in enumerate(rows)],
                                 f"served_at long, request_id long, {names}")


@pytest.mark.parametrize("n,segment,parts", [(1, 1, 3), (7, 7, 5), (40, 55, 4), (40, 1000, 1)])
def test_history_equals_the_report_after_every_row(spark, n, segment, parts):
    """Against the plain buffer, row by row; segments shorter than, as long as and longer than the log."""
    rng = np.random.default_rng(n)
    rows = [(int(t), int(x)) for t, x in zip(rng.integers(0, 30, 130), rng.integers(0, 12, 130))]
    log = _log(spark, rows)
    reference = drift.compute_reference_stats(_log(spark, [(0, i % 10) for i in range(200)]))
    out = drift.drift_history(log.repartition(parts), reference, n=n, min_samples=5, segment=segment).collect()
    assert len(out) == len(rows)
    found = {r["request_id"]: r for r in out}
    seen = []
    for at, i in sorted((at, i) for i, (at, _) in enumerate(rows)):
        seen = [*seen, rows[i][1]][-n:]
        assert found[i]["sample_count"] == len(seen) and found[i]["served_at"] == at
        worst = 0
        for f, name in enumerate(FEATURE_NAMES):
            ref = reference[name]
            counts = np.histogram(np.array(seen, float) + f, bins=np.array(ref.bin_edges))[0] / len(seen)
            now, then = np.maximum(counts, 1e-6), np.maximum(ref.bin_proportions, 1e-6)
            psi = float(((now - then) * np.log(now / then)).sum())
            if len(seen) >= 5:
                assert found[i][f"psi{f}"] == pytest.approx(psi, abs=1e-9)
            else:
                assert found[i][f"psi{f}"] is None
            worst = max(worst, psi)
        want = "insufficient_data" if len(seen) < 5 else "significant" if worst >= 0.25 else "moderate" if worst >= 0.1 else "stable"
        assert found[i]["status"] == want


def test_history_of_repeated_and_untimed_rows_and_no_rows(spark):
    log = _log(spark, [(None, 1), (None, 2), (5, 3)] + [(7, 4)] * 90)
    log = log.unionByName(log.where("request_id = 5"))  # one row repeated as it is
    reference = drift.compute_reference_stats(_log(spark, [(0, i % 10) for i in range(50)]))
    out = drift.drift_history(log, reference, n=10, segment=10).collect()
    assert len(out) == 94 and sorted(r["sample_count"] for r in out) == [*range(1, 10), *[10] * 85]
    assert {r["request_id"]: r["sample_count"] for r in out if r["sample_count"] < 4} == {0: 1, 1: 2, 2: 3}
    assert drift.drift_history(log.where("false"), reference).count() == 0
    with pytest.raises(ValueError):
        drift.drift_history(log, reference, n=11, segment=10)


def test_history_slides_in_segments(spark, reference, capsys):
    """No window over the whole log but the one over part sizes; the rows meet by segment."""
    drift.drift_history(catalog.served_log(spark, SF_SMALL), reference).explain()
    plan = capsys.readouterr().out
    assert "hashpartitioning(segment" in plan and plan.count("SinglePartition") == 1 and "Python" not in plan


def test_later_passes_read_open_columns_only(spark, monkeypatch):
    """A column of few values is settled by the first pass; odd sizes, signs and neighbours come out exactly."""
    asked, real = [], drift._values
    monkeypatch.setattr(drift, "_values", lambda features, columns: asked.append(columns) or real(features, columns))
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(-2 ** 63, 2 ** 63 - 1, 3000).view(np.float64), np.nextafter(3.0, [2, 4]), [3.0, 0.0, -0.0, 5e-324, -5e-324, np.inf, -np.inf],
                        3 + rng.random(500) * 1e-13, np.full(50, 7.25)])
    x = np.sort(x[~np.isnan(x)])
    frame = spark.createDataFrame([(float(v), float(i % 3)) for i, v in enumerate(rng.permutation(x))], "x double, few double").repartition(5)
    found = drift.order_statistics(frame, ("few", "x"), {0: {0, len(x) - 1}, 1: set(range(0, len(x), 7))})
    assert found.pop((0, 0)) == 0 and found.pop((0, len(x) - 1)) == 2
    assert found == {(1, r): x[r] for r in range(0, len(x), 7)}
    assert asked[0] == ("few", "x") and set(asked[1:]) == {("x",)} and len(asked) <= 6


def test_history_keeps_few_running_columns(spark, reference):
    """Ninety bins need no ninety running sums: three 17-bit counts share a long."""
    rows = spark.range(0, 40).select(F.col("id").alias("request_id"), F.expr("timestamp_seconds(id)").alias("served_at"),
                                     *[F.lit(1.0).alias(n) for n in FEATURE_NAMES])
    plan = drift.drift_history(rows, reference)._jdf.queryExecution().optimizedPlan().toString()
    bins = sum(len(r.bin_edges) - 1 for r in reference.values())
    assert plan.count(" AS r") <= bins // 3 + 1 and plan.count("lag(") <= bins // 3 + 1
