import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tripparity.llm import topk as T


def clamped(score):
    return min(max(score, -(1 << 63)), (1 << 63) - 1)


def plain(rows, top, is_query):
    valid = [(n, i, [math.floor(64 * x) for x in v]) for n, (i, v) in enumerate(rows)
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, v in valid:
        if is_query(i):
            best = sorted((-clamped(sum(a * b for a, b in zip(v, w))), j, m) for m, j, w in valid if m != n)[:top]
            out += [(i, r + 1, j, -s) for r, (s, j, _) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block, query_block", [(7, 3), (1000, 1000)])
def test_matches_brute_force_with_ties_and_bad_rows(spark, block, query_block):
    rng = random.Random(block)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.1, 1.5]) for _ in range(rng.choice([6, 19, 19, 19]))]) for i in range(150)]
    rows += [(40, rows[40][1]), (None, rows[3][1]), (200, None), (201, [float("nan")] * 19), (202, [None] * 19), (203, []),
             (204, [float("inf")] + [0.0] * 18), (220, [1e9] * 19), (-20, rows[5][1])]
    rows += [(300 + i, [0.5] * 19) for i in range(60)]
    df = spark.createDataFrame([(i, v, "x", 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, label string, block int, score double")
    out = T.top_k(df.repartition(5), F.col("vec_id") % 20 == 0, top=9, block=block, query_block=query_block)
    assert sorted(map(tuple, out.collect())) == plain(rows, 9, lambda i: i % 20 == 0)


def test_components_beyond_exact_doubles(spark):
    rows = [(0, [1e9, 3.0]), (1, [1e9, 1.0]), (2, [1e9, 2.0]), (3, [-1e9, 5.0]), (4, [1e16, 1e16]), (20, [1e16, 1e16])]
    out = T.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, top=5)
    assert sorted(map(tuple, out.collect())) == plain(rows, 5, lambda i: i % 20 == 0)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert T.top_k(none, F.col("vec_id") % 20 == 0).count() == 0
    one = spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<float>")
    assert T.top_k(one, F.col("vec_id") % 20 == 0).count() == 0


def test_query_matches_sql(spark):
    path = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    want = sorted(con.execute(T.OP10_SQL).fetchall())
    assert sorted(map(tuple, T.op10_exact_topk(spark, path).collect())) == want
