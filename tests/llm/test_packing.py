import random
import zlib

import numpy as np
import pytest

from tripparity.llm import packing as K


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(K.tokenizer_file())


def test_word_cache_gives_the_tokenizers_ids(reference):
    rng = random.Random(2)
    bits = ["Hello", "it's", "don't", " ", "\n", "\t", " ", "é", "É", "Σας", "ΑΣ", "İ", "漢字", "\U0001f600", "<|endoftext|>",
            "<|start", "oftext|>", "\x01", "\x1c", "12", "3.5", "!!", "'re", "́", "ß", "\r\n", "\x00", "‍", "...", "　"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + [None, "", " ", "\x01", "a \x01 b"]
    words = K.WordTokenizer(open(K.tokenizer_file(), encoding="utf-8").read(), cache_words=200)
    for lo in range(0, len(texts), 50):
        for text, ids in zip(texts[lo:lo + 50], words.ids(texts[lo:lo + 50])):
            assert np.frombuffer(ids, "<u4").tolist() == reference.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_price_is_the_best_knapsack():
    rng = np.random.default_rng(0)
    lengths, worth = np.array([3, 5, 7, 11]), rng.random(4)
    best, _ = K.price(lengths, worth, 30)
    plain = np.zeros(31)
    for c in range(1, 31):
        plain[c] = max([plain[c - 1]] + [plain[c - n] + w for n, w in zip(lengths, worth) if n <= c])
    assert np.allclose(best, plain)


@pytest.mark.parametrize("histogram", [{}, {1: 5}, {10: 1}, {10: 7, 1: 3}, {6: 40, 4: 40}, {7: 9, 5: 100, 3: 31, 2: 4}, {10: 3, 9: 2, 1: 50}])
def test_plan_places_every_piece(histogram):
    found = K.plan(histogram, 10)
    placed = {}
    for config in found:
        assert config.used() <= 10 and config.count > 0
        for n, k in config.contents:
            placed[n] = placed.get(n, 0) + k * config.count
    assert placed == histogram


def test_program_covers_no_length_twice_and_is_near_its_bound():
    rng = random.Random(4)
    lengths = np.array(range(1100, 2600, 7))
    counts = np.array([rng.randint(1, 3000) for _ in lengths], float)
    cover = np.zeros(len(lengths))
    amounts = 0.0
    for amount, found in K.solve_program(lengths, counts, 4096):
        cover[list(found)] += amount * np.array(list(found.values()))
        amounts += amount
        assert sum(int(lengths[j]) * k for j, k in found.items()) <= 4096
    assert (cover <= counts + 1e-6).all()
    assert amounts <= 1.03 * (cover * lengths).sum() / 4096


def test_plan_is_near_the_volume_bound():
    rng = random.Random(4)
    histogram = {}
    for _ in range(60000):
        n = min(4096, int(rng.lognormvariate(6.5, 1.0)) + 1)
        histogram[n] = histogram.get(n, 0) + 1
    bound = -(-sum(n * k for n, k in histogram.items()) // 4096)
    assert sum(c.count for c in K.plan(histogram, 4096)) <= bound + 0.002 * bound


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_documents_round_trip(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    packed = K.pack_documents(docs, capacity=512, with_ids=True)
    rows = packed.collect()
    check_packed(rows, 512)
    sequences = {r["sequence_id"]: r["ids"] for r in K.sequences(packed).collect()}
    got = {}
    for r in rows:
        ids = sequences[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], ids))
    for doc_id, text in texts.items():
        whole = reference.encode(text or "", add_special_tokens=False).ids + [1]
        want = [(i // 512, i, whole[i:i + 512]) for i in range(0, len(whole), 512)]
        assert sorted(got[doc_id]) == want


def test_edge_rows(edge_docs, no_docs):
    rows = K.pack_documents(edge_docs).collect()
    check_packed(rows, 4096)
    assert sum(r["piece"] == 0 for r in rows) == edge_docs.count()
    assert {r["length"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert K.pack_documents(no_docs).count() == 0
