"""Each stage of the corpus pipeline against plain Python on its own input."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from .test_packing import check_packed
from .test_pii import plain_spans
from .test_simhash import plain_fingerprint, plain_groups
from tripparity.llm.common import materialize

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage, by name."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        found = materialize(stage(spark, docs, DIR), f"test-{name}")
        out[name] = (docs, found)
        docs = found
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_stages_in_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "personal_data",
                                                      "source_mixing", "best_fit_packing"]
    for name in list(stages)[:-1]:
        before, after = stages[name]
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_quality_keeps_unchanged_rows_and_clean_documents(spark, stages):
    before, after = map(rows, stages["quality_classifier"])
    key = lambda r: tuple(map(str, r.values()))
    assert not Counter(map(key, after)) - Counter(map(key, before))
    kept = {r["doc_id"] for r in after}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    seen = [r["doc_id"] for r in before if r["doc_id"] in labels]
    assert sum(i in kept for i in seen if labels[i] == 1) >= 0.95 * sum(labels[i] == 1 for i in seen)
    assert sum(i not in kept for i in seen if labels[i] == 0) >= 0.5 * sum(labels[i] == 0 for i in seen)


def test_near_dedup_keeps_the_smallest_of_each_group(stages):
    before, after = map(rows, stages["simhash_near_dedup"])
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in before}
    groups = plain_groups(sorted(set(prints.values())), 2)
    best = {}
    for doc_id, value in prints.items():
        best[groups[value]] = min(best.get(groups[value], doc_id), doc_id)
    assert sorted(r["doc_id"] for r in after) == sorted(best.values())


def test_personal_data_is_masked_and_nothing_else_changes(stages):
    before, after = ({r["doc_id"]: r for r in rows(df)} for df in stages["personal_data"])
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert not plain_spans(r["text"])
        assert {k: v for k, v in r.items() if k != "text"} == {k: v for k, v in before[i].items() if k != "text"}
        if not plain_spans(before[i]["text"]):
            assert r["text"] == before[i]["text"]


def test_mixing_repeats_whole_documents_near_the_targets(stages):
    before, after = map(rows, stages["source_mixing"])
    texts = {r["doc_id"]: r for r in before}
    copies = Counter(r["doc_id"] for r in after)
    assert max(copies.values()) <= 2 and all(r == texts[r["doc_id"]] for r in after)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for i, r in texts.items()}
    total = sum(size[i] * n for i, n in copies.items())
    assert abs(total - 1.5 * sum(size.values())) <= 0.1 * sum(size.values())


def test_packing_holds_every_document_once_per_copy(stages):
    before, after = map(rows, stages["best_fit_packing"])
    sequences = check_packed(after, 4096)
    assert Counter(r["doc_id"] for r in after if r["piece"] == 0) == Counter(r["doc_id"] for r in before)
    assert sequences <= -(-sum(r["length"] for r in after) // 4096) + 2


def test_run_applies_all_stages(spark, stages):
    assert rows(corpus_pipeline.run(spark, DIR))[0].keys() == rows(stages["best_fit_packing"][1])[0].keys()
