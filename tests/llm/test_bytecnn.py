import zlib
from dataclasses import replace

import numpy as np
import pytest

from tripparity.llm import bytecnn as B

SMALL = B.CnnConfig(chunk=64, hop=48, filters=8, hidden=6, steps=40, block=3)


def test_chunks_cover_every_byte():
    for length in (0, 1, 63, 64, 65, 112, 113, 1000):
        covered = np.zeros(max(length, 1), bool)
        for s in B.chunk_starts(length, SMALL):
            covered[s:s + SMALL.chunk] = True
        assert covered[:length].all()


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    model = B.ByteCnn(SMALL)
    model.start()
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    chunks, labels, weight = rng.integers(0, 256, (5, 64)), np.array([0, 1, 1, 0, 1.0]), np.ones(5)

    def loss():
        z = model.logits(chunks)
        return float((np.logaddexp(0, z) - labels * z).sum() / 5)

    grads = model._gradients(chunks, labels, weight)
    for name in ("out", "dense", "shift", "filters", "bytes"):
        flat, grad = model.weights[name].reshape(-1), grads[name].reshape(-1)
        for at in np.argsort(-np.abs(grad))[:3]:
            old = flat[at]
            flat[at] = old + 1e-6
            up = loss()
            flat[at] = old - 1e-6
            down = loss()
            flat[at] = old
            assert abs((up - down) / 2e-6 - grad[at]) < 1e-4


def test_document_gradients_match_differences():
    """Documents of one and more chunks, over several blocks of chunks."""
    rng = np.random.default_rng(1)
    model = B.ByteCnn(SMALL)
    model.start()
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    chunks, owners, labels = rng.integers(0, 256, (8, 64)), np.array([0, 0, 0, 1, 2, 2, 2, 2]), np.array([1.0, 0, 0])
    weight = np.array([0.5, 1.0, 2.0])

    def loss():
        z = np.bincount(owners, model.logits(chunks)) / np.bincount(owners)
        return float(((np.logaddexp(0, z) - labels * z) * weight).sum() / 3)

    grads = model._gradients(chunks, labels, weight, owners)
    for name in ("out", "dense", "shift", "filters", "bytes"):
        flat, grad = model.weights[name].reshape(-1), grads[name].reshape(-1)
        for at in np.argsort(-np.abs(grad))[:3]:
            old = flat[at]
            flat[at] = old + 1e-6
            up = loss()
            flat[at] = old - 1e-6
            down = loss()
            flat[at] = old
            assert abs((up - down) / 2e-6 - grad[at]) < 1e-4


def test_training_rows_are_whole_texts_one_an_id(spark):
    long = "word " * 5000
    docs = spark.createDataFrame([(i, long + str(i)) for i in range(20)] + [(3, f"copy {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    rows = B.training_rows(docs, labels, "doc_id", "text", "quality", SMALL)
    ids = [r["__id"] for r in rows]
    assert ids == [i for i in range(20) if zlib.crc32(str(i).encode()) % 5]
    assert all(r["text"] == long + str(r["__id"]) for r in rows if r["__id"] != 3)
    assert len(B.training_rows(docs, labels, "doc_id", "text", "quality", replace(SMALL, sample_rows=4))) == 4


def test_score_reads_whole_texts_block_by_block():
    model = B.ByteCnn(SMALL)
    model.start()
    texts = [b"x" * n for n in (0, 5, 64, 65, 700, 3, 2000)] + [bytes(range(256)) * 9]
    for text, score in zip(texts, model.score(iter(texts))):
        data = np.frombuffer(text, np.uint8)
        want = model.logits(B.cut(data, B.chunk_starts(len(data), SMALL), SMALL)).mean()
        assert score == pytest.approx(1 / (1 + np.exp(-want)), rel=1e-5)


def test_held_out_accuracy_and_fold(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    config = replace(B.CnnConfig(), steps=800)
    model = B.fit_quality(docs, labels, config=config)
    out = B.score_quality(docs, model).join(labels, "doc_id").collect()
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    clean = [r["predicted"] for r in out if r["held_out"] and r["quality"] == 1]
    junk = [r["predicted"] for r in out if r["held_out"] and r["quality"] == 0]
    assert np.mean(clean) > 0.9 and np.mean(junk) < 0.4


def test_edge_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 0), (7, 0, 0), (8, None, 1), (None, 1, 0), (99, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    model = B.fit_quality(edge_docs, labels, config=SMALL)
    out = B.score_quality(edge_docs, model).collect()
    assert len(out) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in out)
    kept = B.keep_quality(edge_docs, model)
    assert kept.columns == edge_docs.columns and kept.count() == sum(r["predicted"] for r in out)
    assert B.score_quality(no_docs, model).count() == 0
    unfitted = B.fit_quality(no_docs, labels.limit(0))
    assert {r["score"] for r in B.score_quality(edge_docs, unfitted).collect()} == {0.5}
