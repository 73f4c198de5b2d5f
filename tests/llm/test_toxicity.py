"""The toxicity chain: evidence against plain counting, out-of-fold inputs, held-out accuracy, edge rows."""

import dataclasses
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripparity.llm import toxicity as T

SMALL = T.ChainConfig(buckets=1 << 12, sample_rows=500)


def made_up(n, seed):
    """Documents of ordinary words; toxic ones hold one of six telling words somewhere, whatever their length."""
    rng = random.Random(seed)
    ordinary, telling = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)], ["vile", "rotten", "foul", "nasty", "grim", "bile"]
    docs = []
    for i in range(n):
        words = [rng.choice(ordinary) for _ in range(rng.choice([5, 40, 400]))]
        toxic, quality = rng.random() < 0.15, rng.random() < 0.7
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(telling)
        if not quality:
            words += ["click", "here"]
        docs.append((i, " ".join(words), int(quality), int(toxic)))
    return docs


def test_word_odds_by_plain_counting():
    rows = [T.word_buckets(t, SMALL.buckets) for t in ("a b", "a c", "a b c", "d", "a b")]
    labels = np.array([1, 0, 1, 0, 0.0])
    config = dataclasses.replace(SMALL, least_docs=2)
    odds = T.word_odds(rows, labels, config)
    bucket = lambda w: T.word_buckets(w, SMALL.buckets)[0]
    for word, positive, negative in (("a", 2, 2), ("b", 2, 1), ("c", 1, 1)):
        want = math.log((positive + 2 * 2 / 5) / 2) - math.log((negative + 2 * 3 / 5) / 3)
        assert odds[bucket(word)] == pytest.approx(want)
    assert odds[bucket("d")] == 0 and np.count_nonzero(odds) == 3


def test_pooled_inputs_by_hand():
    odds = np.zeros(SMALL.buckets)
    row = np.arange(7)
    odds[:7] = [3, -1, 2, 0.5, 0, 1.5, -2]
    assert T.pooled(odds, row) == pytest.approx([3, 6.5, 7, 4, 4 / 7, 3 / math.sqrt(7), -1, math.log(8)])
    assert not T.pooled(odds, row[:0]).any()


def test_linear_model_reaches_its_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3)) * [1, 5, 0.1]
    y = (x @ [1, -0.2, 3] + rng.logistic(size=300) > 0).astype(float)
    w = T.fit_linear(x, y, SMALL)

    def loss(v):
        z = x @ v[:-1] + v[-1]
        return np.mean(np.log1p(np.exp(z)) - y * z) + 0.5 * SMALL.penalty * np.sum((v[:-1] * x.std(axis=0)) ** 2)
    assert all(loss(w) <= loss(w + d) + 1e-9 for d in 0.01 * np.vstack([np.eye(4), -np.eye(4)]))
    assert T._sigmoid(T.fit_linear(x, np.zeros(300), SMALL)[-1]) < 0.01 < 0.99 < T._sigmoid(T.fit_linear(x, np.ones(300), SMALL)[-1])


def test_later_models_see_out_of_fold_probabilities(monkeypatch):
    """Labels without any relation to the words: out of fold they cannot be told, in the fold they could."""
    rng = random.Random(1)
    rows = [np.array(sorted(rng.sample(range(4000), 30))) for _ in range(200)]
    labels = np.array([[rng.random() < 0.5, rng.random() < 0.5] for _ in range(200)], float)
    seen, real = [], T.fit_linear
    monkeypatch.setattr(T, "fit_linear", lambda x, y, c: seen.append((x, y)) or real(x, y, c))
    T.ToxicityChain(dataclasses.replace(SMALL, least_docs=1), ("a", "b")).fit(rows, labels)
    inputs, _ = seen[-1]
    assert inputs.shape == (200, T.POOLED + 1)
    fed = inputs[:, -1]
    assert abs(fed[labels[:, 0] == 1].mean() - fed[labels[:, 0] == 0].mean()) < 0.15


def test_one_telling_word_counts_in_long_texts(spark):
    train, new = made_up(900, 1), made_up(300, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in train], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in train], "doc_id long, quality int, toxic int")
    chain = T.fit_chain(docs, labels, config=dataclasses.replace(SMALL, buckets=1 << 16, sample_rows=900))
    marks = [(toxic, chain.predict(text)[-1] >= 0.5) for _, text, _, toxic in new]
    assert np.mean([m for t, m in marks if t]) > 0.9 and np.mean([m for t, m in marks if not t]) < 0.03


def test_held_out_documents(spark):
    """Recall of at least 0.85 at no more than 1 % false marks on the fold the chain never saw."""
    sf = "/root/testdata/sf0.1"
    found = T.op2_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null"), "doc_id")
    rates = {r["toxic"]: r["marked"] for r in found.groupBy("toxic").agg(F.avg("predicted").alias("marked")).collect()}
    assert rates[1] >= 0.85 and rates[0] <= 0.01


def test_edge_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (5, 0, 1), (5, 0, 1), (6, 1, 0), (7, None, 1), (8, 1, None), (9, 0, 1), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    chain = T.fit_chain(edge_docs, labels, config=SMALL)
    out = T.score_toxicity(edge_docs, chain).collect()
    assert len(out) == edge_docs.count() and out[0].asDict().keys() == {"doc_id", "held_out", "p_quality", "p_toxic", "predicted"}
    assert all(0 <= r["p_toxic"] <= 1 and r["predicted"] == int(r["p_toxic"] >= 0.5) for r in out)
    assert {r["p_toxic"] for r in out if r["doc_id"] in (1, 2, 3)} == {chain.predict(None)[-1]}
    assert T.score_toxicity(no_docs, chain).count() == 0
    untrained = T.fit_chain(no_docs, labels.limit(0), config=SMALL)
    assert [tuple(r)[2:] for r in T.score_toxicity(edge_docs, untrained).limit(2).collect()] == [(0.5, 0.5, 1)] * 2


def test_a_repeated_id_is_one_training_row(spark):
    train = made_up(60, 3)
    rows = [(i, t) for i, t, _, _ in train] + [(0, f"other text {k}") for k in range(400)]
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in train], "doc_id long, quality int, toxic int")
    seen = []
    real, T.ToxicityChain.fit = T.ToxicityChain.fit, lambda self, r, y: seen.append(len(r)) or self
    try:
        T.fit_chain(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), labels, config=SMALL)
    finally:
        T.ToxicityChain.fit = real
    assert seen == [sum(T.zlib.crc32(str(i).encode()) % 5 != 0 for i in range(60))]
