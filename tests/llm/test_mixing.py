import random
from collections import defaultdict

import numpy as np

from tripparity.llm import mixing as M


def plain_targets(sizes, weights=M.WEIGHTS, share=1.5, most=2.0):
    """Literal resharing: split by weight, fix what is above its cap, share the rest again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, target, budget = list(names), {}, share * sum(sizes.values())
    while left:
        total = sum(weight[n] for n in left)
        part = {n: budget * weight[n] / total for n in left}
        above = [n for n in left if part[n] > most * sizes[n]]
        if not above:
            return target | part
        for n in above:
            target[n] = most * sizes[n]
            budget -= target[n]
            left.remove(n)
    return target


def test_flight_keeps_totals_and_leaves_two():
    rng = random.Random(1)
    p, sizes = [rng.random() for _ in range(500)], [float(rng.randint(0, 900)) for _ in range(500)]
    out = M.flight(p, sizes, rng)
    assert sum(0 < x < 1 for x in out) <= 2
    assert abs(sum(out) - sum(p)) < 1e-5 and abs(np.dot(out, sizes) - np.dot(p, sizes)) < 1e-2
    same = M.flight([0.3] * 50, [7.0] * 50, rng)
    assert sum(0 < x < 1 for x in same) <= 1 and abs(sum(same) - 15) < 1e-6


def test_inclusion_probabilities_hold():
    sizes, p = [10.0, 200.0, 30.0, 45.0, 5.0, 80.0], [0.2, 0.5, 0.9, 0.35, 0.6, 0.75]
    total = np.zeros(6)
    for seed in range(4000):
        rng = random.Random(seed)
        total += M.landing(M.flight(p, sizes, rng), sizes, rng)
    assert np.abs(total / 4000 - p).max() < 0.04


def test_targets_match_literal_resharing(spark):
    rng = random.Random(3)
    sizes = {f"s{i}": rng.choice([0, 3, 50, 1000, 9000]) for i in range(17)} | {None: 40, "é": 5, "\U0001f600": 70, "～": 8}
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r["source"]: r["target"] for r in M.source_targets(table).collect()}
    want = plain_targets(sizes)
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-6 for k in want)


def test_mix_is_balanced_and_repeatable(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    first = M.mix(docs, ["doc_id", "source"], block=64).toPandas()
    again = M.mix(docs, ["doc_id", "source"], block=64).toPandas()
    assert dict(zip(first.doc_id, first.taken)) == dict(zip(again.doc_id, again.taken))
    assert (first.taken <= 2 * first["size"]).all() and len(first) == docs.count()
    by = first.groupby("source").agg(size=("size", "sum"), source_size=("source_size", "max"), target=("target", "max"),
                                     taken=("taken", "sum"), most=("size", "max"))
    assert (by["size"] == by.source_size).all()
    want = plain_targets(by.source_size.to_dict())
    assert all(abs(by.target[k] - want[k]) < 1e-6 for k in want)
    assert (abs(by.taken - by.target) <= np.maximum(0.03 * by.target, 10)).all()


def test_edge_rows(edge_docs, no_docs):
    out = M.mix(edge_docs, ["doc_id", "size"]).collect()
    assert len(out) == edge_docs.count()
    sizes = defaultdict(int)
    for r in edge_docs.collect():
        sizes[r["source"]] += len((r["text"] or "").split())
    assert {r["source_size"] for r in out} == set(sizes.values())
    assert M.mix(no_docs, ["doc_id"]).count() == 0
    mixed = M.mix_documents(edge_docs)
    assert mixed.columns == edge_docs.columns
    assert M.mix_documents(no_docs).count() == 0


def test_draw_goes_by_contents_and_not_by_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = sorted(r["doc_id"] for r in M.mix_documents(docs, block=64).select("doc_id").collect())
    for parts in (1, 7):
        assert sorted(r["doc_id"] for r in M.mix_documents(docs.repartition(parts), block=64).select("doc_id").collect()) == want


def test_rows_of_one_id_are_dealt_to_all_blocks(spark, monkeypatch):
    """A third of the rows share id and size; no block holds them all and the totals hold."""
    docs = spark.range(6000).selectExpr("if(id < 2000, 7, id) AS doc_id", "'one' AS source",
                                        "repeat('w ', if(id < 2000, 5, int(1 + id % 40))) AS text")
    other = docs.selectExpr("doc_id + 100000 AS doc_id", "'two' AS source", "text")
    seen = []
    written = M.materialize
    monkeypatch.setattr(M, "materialize", lambda df, name: seen.append((name, written(df, name))) or seen[-1][1])
    out = M.mix(docs.union(other), ["doc_id"], block=200).toPandas()
    rates = next(df for name, df in seen if name == "mix-rates")
    assert rates.groupBy("source", "block").count().agg({"count": "max"}).first()[0] < 400
    by = out.groupby("target").taken.sum()
    assert len(out) == 12000 and all(abs(taken - target) <= 0.01 * target for target, taken in by.items())
