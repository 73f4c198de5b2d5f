"""Hard negatives against brute force in Python and SQL; the tree's bounds; edge rows."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tripparity.llm import hardneg as H

LEAST, MOST = -(1 << 63) + 1, (1 << 63) - 1
SCHEMA = "vec_id long, embedding array<double>, label int, row long, cell string, rank double"


def plain(rows, positives=5, negatives=3, modulus=50):
    valid = [(n, i, [math.floor(256 * x) for x in v], label) for n, (i, v, label) in enumerate(rows)
             if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, v, label in valid:
        if i % modulus:
            continue
        scored = [(-min(max(sum(a * b for a, b in zip(v, w)), LEAST), MOST), j, m, other == label) for m, j, w, other in valid if m != n]
        for p, positive, _, _ in sorted(s for s in scored if s[3])[:positives]:
            hard = sorted(s for s in scored if not s[3] and 50 * -p <= 100 * -s[0] <= 95 * -p)[:negatives]
            out += [(i, positive, r + 1, j, -p, -s) for r, (s, j, _, _) in enumerate(hard)]
    return sorted(out)


def edge_rows(seed):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.1, 1.5]) for _ in range(rng.choice([4, 13, 13, 13]))], rng.randrange(3)) for i in range(160)]
    rows += [(50, rows[50][1], 1), (None, rows[3][1], 1), (200, None, 1), (250, [float("nan")] * 13, 1), (202, [None] * 13, 0), (300, [], 2),
             (204, [float("inf")] + [0.0] * 12, 0), (205, rows[0][1], None), (-50, rows[5][1], 1)]
    return rows + [(400 + i, [0.5] * 13, i % 2) for i in range(80)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "x", 2.0) for i, v, label in rows], SCHEMA)


@pytest.mark.parametrize("block, query_block, cells", [(25, 2, 6), (1000, 1000, 64)])
def test_matches_brute_force_with_ties_and_bad_rows(spark, block, query_block, cells, monkeypatch):
    monkeypatch.setattr(H, "LEAF", 4)
    rows = edge_rows(block)
    out = H.mine(frame(spark, rows).repartition(5), F.col("vec_id") % 50 == 0, block=block, query_block=query_block, cells=cells)
    found = sorted(map(tuple, out.collect()))
    assert len(found) > 30 and found == plain(rows)


def test_large_components_empty_table_and_single_label(spark):
    rows = [(0, [1e9, 3.0], 1), (1, [1e9, 1.0], 1), (2, [0.7e9, 2.0], 0), (3, [-1e9, 5.0], 0), (50, [1e16, 1e16], 0), (4, [1e15, 1.0], 1)]
    assert sorted(map(tuple, H.mine(frame(spark, rows), F.col("vec_id") % 50 == 0).collect())) == plain(rows)
    assert H.mine(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert H.mine(frame(spark, [(0, [1.0], 1), (1, [1.0], 1)]), F.col("vec_id") % 50 == 0).count() == 0


def test_sql_agrees(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 16))
    rows = [(i, (centres[i % 4] + rng.normal(size=16)).tolist(), int(rng.integers(10)) if i % 31 else None) for i in range(600)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(f"select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ({H.OP12_SQL})").fetchall()
    got = H.op12_hard_negatives(spark, str(tmp_path)).collect()
    assert len(want) > 50 and sorted(map(tuple, got)) == sorted(want)


def test_clustered_vectors_leave_siblings_out():
    """Far clusters: the annulus of a query near its own cluster reaches few leaves, none is lost."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 8)) * 400
    data = np.floor(np.repeat(centres, 50, axis=0) + rng.normal(size=(2000, 8)) * 5).astype(np.int64)
    mass = float((data.astype(float) ** 2).sum(axis=1).max())
    points = data.astype(float)
    tree = H.build(points, H._lift(points, mass), np.arange(2000), leaf=20)
    at = np.arange(0, 2000, 97)
    labels = np.arange(2000) % 3
    search = H.Search((np.arange(2000), np.arange(2000), labels, data, tree),
                      (at, labels[at], data[at], np.full(len(at), LEAST), np.full(len(at), MOST)), True, 3, mass)
    found = search.run()
    single = H.Search((np.arange(2000), np.arange(2000), labels, data, tree),
                      (at[:1], labels[at[:1]], data[at[:1]], np.full(1, LEAST), np.full(1, MOST)), True, 3, mass)
    single.run()
    assert single.leaves < 60
    for i, q in enumerate(at):
        scores = data @ data[q]
        want = sorted((-int(scores[j]), j, j) for j in range(2000) if j != q and labels[j] == labels[q])[:3]
        assert found[i] == want


def test_equal_vectors_make_one_leaf():
    points = np.ones((1000, 3))
    assert isinstance(H.build(points, np.zeros(1000), np.arange(1000)), np.ndarray)


def test_query_blocks_never_broadcast(spark):
    """A block of queries stands once for every cell it meets; a broadcast of these fills the driver."""
    rows = frame(spark, edge_rows(5)).where("vec_id is not null and embedding is not null and label is not null").where("size(embedding) = 13") \
        .select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"),
                H.quantized(F.col("embedding"), H.SCALE).alias("v")).where("v is not null")
    index = H._Index(rows, 16, 8)
    asked = index.placed.where("id % 50 = 0").selectExpr("row", "0L entry", "id", "label", "v", f"{LEAST}L lo", f"{MOST}L hi", "cell")
    found = index.search(index.asked(asked, 4, False), True, 5)
    assert found.count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan[plan.index("MapInPandas"):].splitlines() if "Join" in line]
    assert "SortMergeJoin" in joins[0], joins


def test_narrow_keeps_numbers():
    for numbers, kind in (([], np.int8), ([-128, 127], np.int8), ([-129], np.int16), ([1 << 15], np.int32), ([LEAST, MOST], np.int64)):
        narrow = H._narrow(np.array(numbers, np.int64))
        assert narrow.dtype == kind and narrow.tolist() == numbers
