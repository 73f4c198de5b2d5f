import random
import re

import numpy as np
import pytest
import xxhash

from tripparity.llm import simhash as S
from tripparity.llm.components import connected_components


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    rows = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in rows]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(values, budget):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for x in values:
        for y in values:
            if x < y and (x ^ y).bit_count() <= budget:
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


def clustered(rng, n):
    """Fingerprints with dense clumps, so that a trie node stays heavy far down."""
    centre = rng.getrandbits(64)
    out = {0, (1 << 64) - 1, centre}
    while len(out) < n:
        v = centre if rng.random() < 0.6 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 5)):
            v ^= 1 << rng.randrange(64)
        out.add(v)
    return sorted(out)


@pytest.mark.parametrize("text", [None, "", "One", "One TWO", "ÀB c D", "a b c d a b c", "x\x0by\x1cz w q r"])
def test_fingerprint_matches_definition(text):
    assert S.simhash(None if text is None else text.encode()) % (1 << 64) == plain_fingerprint(text)


def test_fingerprint_of_a_text_longer_than_a_block():
    text = " ".join(str(i % 977) for i in range(70000))
    words = text.split()
    h = np.array([xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(len(words) - 2)], np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))
    assert S.simhash(text.encode()) % (1 << 64) == want


@pytest.mark.parametrize("budget", [0, 1, 2, 4])
def test_walk_finds_exactly_the_near_pairs(budget):
    values = np.array(clustered(random.Random(budget), 400), np.uint64)
    i, j = S.walk_pairs(values, None, 0, 0, budget)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= budget
    want = {(a, b) for a, b in zip(*np.nonzero(near)) if a < b}
    assert len(i) == len(want) and set(zip(i.tolist(), j.tolist())) == want


@pytest.mark.parametrize("node_size", [3, 40, 100000])
def test_groups_match_brute_force(spark, node_size):
    values = clustered(random.Random(5), 300)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    found = S.group_table(spark.createDataFrame(signed, "fp long"), 2, node_size).collect()
    want = plain_groups(values, 2)
    by_root = {}
    for r in found:
        by_root.setdefault(r["root"], set()).add(r["fp"] % (1 << 64))
    by_want = {}
    for v, root in want.items():
        by_want.setdefault(root, set()).add(v)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_want.values()))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(-5, 7000), (3, 3)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len(found) == 201 + 300 + 2
    assert all(found[i] == 0 for i in range(201)) and all(found[1000 + i] == 1000 for i in range(300))
    assert found[7000] == found[-5] == -5


def test_edge_rows(spark, edge_docs, no_docs):
    out = S.near_duplicates(edge_docs).collect()
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert sorted((str(r["doc_id"]), int(r["fingerprint"], 16)) for r in out) == \
        sorted((str(i), plain_fingerprint(t)) for i, t in rows)
    zero = [r for r in out if r["fingerprint"] == "0" * 16]
    assert {r["doc_id"] for r in zero} >= {1, 2, 3} and {r["component_id"] for r in zero} == {1}
    assert {r["component_id"] for r in out if r["doc_id"] is None} == {6}
    assert S.near_duplicates(no_docs).count() == 0


def test_dropping_keeps_one_row_of_each_group(edge_docs, no_docs):
    kept = S.drop_near_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "5", "6", "7", "8", "9", "9"]
    assert S.drop_near_duplicates(no_docs).count() == 0
