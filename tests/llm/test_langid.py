import random
import zlib

import numpy as np
import pytest

from tripparity.llm import langid as L


def plain_profile(text, c):
    data = text.lower().encode()
    counts = np.zeros(c.buckets, np.int64)
    for n in c.orders:
        for i in range(len(data) - n + 1):
            key = 0
            for b in data[i:i + n]:
                key = (key * 0x01000193 & 0xFFFFFFFF) ^ b
            counts[(((key + n) * 0x9E3779B1 & 0xFFFFFFFF) >> 8) % c.buckets] += 1
    return counts


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_profiles_count_the_whole_text(block):
    c = L.LangConfig(block=block)
    for text in ("", "a", "ab", "Größe straße", "x" * 300, "the quick brown fox " * 9):
        assert (L.profile(text, c) == plain_profile(text, c)).all(), (text, block)


def test_machine_separates_separable_points():
    rng = np.random.default_rng(0)
    c = L.LangConfig(buckets=16)
    signs = np.where(np.arange(200) % 4 == 0, 1.0, -1.0)
    dense = np.abs(rng.normal(size=(200, 16))) * 0.1
    dense[signs > 0, 3] += 1
    dense[signs < 0, 9] += 1
    rows = [(np.arange(16), x / np.linalg.norm(x)) for x in dense]
    w = L.fit_machine(rows, signs, c)
    assert all((w[:-1] @ x + w[-1]) * s > 0 for (_, x), s in zip(rows, signs))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit_languages(docs)
    assert set(model.family_of.values()) == {"germanic", "romance"}
    langs = {r["doc_id"]: (r["lang"], r["text"]) for r in docs.select("doc_id", "lang", "text").collect()}
    out = L.identify_languages(docs, model).collect()
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r["lang_pred"] == langs[r["doc_id"]][0] for r in out if r["held_out"] and len(langs[r["doc_id"]][1]) > 40]
    assert np.mean(held) > 0.97


def test_more_languages_and_families(spark):
    rng = random.Random(1)
    sounds = {"en": "th he er on", "de": "sch ei ich ung", "nl": "ij oe aa een", "fr": "eau oi eux que", "xx": "zu qo kx vy", None: "ab"}
    rows = [(i, " ".join("".join(rng.choice(sounds[lang].split()) for _ in range(3)) for _ in range(30)), lang)
            for i, lang in enumerate(list(sounds) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit_languages(docs)
    assert model.family_of["xx"] == "=xx" and None not in model.family_of
    out = {r["doc_id"]: r["lang_pred"] for r in L.identify_languages(docs, model).collect()}
    assert np.mean([out[i] == lang for i, _, lang in rows if lang]) == 1.0


def test_edge_rows(edge_docs, no_docs):
    model = L.fit_languages(edge_docs)
    rows = edge_docs.collect()
    out = L.identify_languages(edge_docs, model).collect()
    assert len(out) == len(rows)
    assert {r["lang_pred"] for r in out if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert {r["lang_pred"] for r in out} <= {"und", "en", "de", "fr", "es"}
    unfitted = L.fit_languages(no_docs)
    assert {(r["lang_pred"], r["score"]) for r in L.identify_languages(edge_docs, unfitted).collect()} == {("und", 0.0)}
    assert L.identify_languages(no_docs, model).count() == 0


def test_training_reads_whole_texts_and_each_row_once(spark):
    """The telling words stand in the middle of long texts; one row makes up half of the table."""
    filler = "zzz " * 400
    rows = [(i, filler + ("schön größe " if i % 2 else "hello there ") * 40 + filler, "de" if i % 2 else "en") for i in range(80)]
    rows += [(81, "schön größe", "de")] * 80
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = L.fit_languages(docs, config=L.LangConfig(sample_rows=30))
    assert [model.predict(f"{filler}{word} {filler}")[0] for word in ("schön größe " * 9, "hello there " * 9)] == ["de", "en"]


def test_a_dirty_column_learns_the_largest_languages(spark):
    rows = [(i, f"abc def {i}", "en") for i in range(40)] + [(100 + i, f"wxyz uvw {i}", "fr") for i in range(40)]
    rows += [(200 + i, "noise", f"x{i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit_languages(docs, config=L.LangConfig(max_languages=2))
    assert set(model.family_of) == {"en", "fr"} and len(model.machines) == 1
