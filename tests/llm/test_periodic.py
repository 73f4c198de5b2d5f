"""Periodic runs against a brute-force search over every period, digests of the query, edge rows."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tripparity.llm.periodic import WORD, collapse, collapse_documents, find_runs, op11_periodic_runs, with_runs


def brute_runs(words, least=24, repeats=3):
    n, found = len(words), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            start, length = i, end + q - i
            part = words[start:start + length]
            if length >= max(least, repeats * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                found.append((start, length, q))
            i = end
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_query(doc_id, text):
    words = re.findall(WORD, text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(kept).encode()).hexdigest())


pieces = st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=14), st.integers(1, 40))


@settings(max_examples=150, deadline=None)
@given(st.lists(pieces, min_size=1, max_size=5))
def test_runs_of_repeated_pieces(parts):
    words = [w for piece, times in parts for w in piece * min(times, 1 + 120 // len(piece))]
    assert find_runs(words) == brute_runs(words)


@pytest.mark.parametrize("seed", range(40))
def test_nested_and_cut_runs(seed):
    """Runs inside the period of longer runs, cut and damaged at random places."""
    rng = random.Random(seed)
    inner = [rng.choice("ab") for _ in range(rng.randint(1, 9))] * rng.randint(1, 12)
    outer = (inner + [rng.choice("abc") for _ in range(rng.randint(0, 20))]) * rng.randint(2, 6)
    words = (outer + ["x"]) * rng.randint(1, 4)
    for _ in range(rng.randint(0, 4)):
        words[rng.randrange(len(words))] = rng.choice("abx")
    words = words[rng.randint(0, 5):len(words) - rng.randint(0, 5)]
    assert find_runs(words) == brute_runs(words)


def test_limits_of_length_and_period():
    eight = [str(i) for i in range(8)]
    assert find_runs(eight * 3) == [(0, 24, 8)]
    assert find_runs((eight * 3)[:-1]) == []
    assert find_runs([str(i) for i in range(9)] * 3) == [(0, 27, 9)]
    assert find_runs(["a"] * 24) == [(0, 24, 1)] and find_runs(["a"] * 23) == []
    assert find_runs(["a", "b"] * 12 + ["c"]) == [(0, 24, 2)]
    assert find_runs([]) == []
    with pytest.raises(ValueError):
        find_runs(["a"], least=10)


@pytest.mark.parametrize("period", [1, 17, 1000])
def test_long_texts_take_no_square_of_the_length(period):
    words = [f"w{i}" for i in range(period)] * (200_000 // period)
    assert find_runs(words) == [(0, len(words), period)]
    cut = [w for block in range(3000) for w in ["a"] * 30 + [f"x{block}"]]
    assert len(find_runs(cut)) == 3000


def test_collapse_keeps_first_period():
    words = "x y".split() + ["p", "q", "r"] * 10 + ["end"]
    assert collapse(words, find_runs(words)) == "x y p q r end".split()


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(7)
    texts = [None, "", " \n\t", "one", "é ß x " * 30, "a " * 400, "same row " * 20, "same row " * 20]
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 90))) for _ in range(60)]
    texts += [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(20, 300))) for _ in range(200)]
    ids = [None, 1, 1, *range(3, len(texts))]
    rows = list(zip(ids, texts))
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    op11_periodic_runs(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out").drop("n_words").collect()
    order = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r)
    assert sum(r["n_runs"] for r in got) > 10
    assert sorted(map(tuple, got), key=order) == sorted((brute_query(i, t) for i, t in rows), key=order)


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a " * 30, 5, "r"), (2, "keep  this\n", 6, None)], "id int, body string, n_words int, runs string")
    out = with_runs(docs, "body", into="n_words")
    assert out.columns == ["id", "body", "runs", "n_words"]
    assert [(r["id"], r["runs"], r["n_words"]["n_words"]) for r in out.orderBy("id").collect()] == [(1, "r", 30), (2, None, 2)]
    kept = {r["id"]: r["body"] for r in collapse_documents(docs, "body").collect()}
    assert kept == {1: "a", 2: "keep  this\n"}
    assert collapse_documents(docs.where("id > 9"), "body").count() == 0
