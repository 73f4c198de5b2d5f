import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tripparity.llm import pii as P

# The contract's patterns as given, for Python's engine.
GIVEN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(GIVEN):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == 0 or kind == 1 and all(int(x) <= 255 for x in m[0].split("."))
                    or kind == 2 and 16 <= len(digits) <= 19 and luhn(digits) or kind == 3 and 8 <= len(digits) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def listed(spans):
    return ",".join(f"{P.KINDS[k]}:{s}:{e}" for k, s, e in spans)


def check(rows):
    for text, row in rows:
        base = plain_spans(text)
        assert row["base_sha256"] == hashlib.sha256(listed(base).encode()).hexdigest(), repr(text)[:200]
        assert [row[f"n_{k}"] for k in P.KINDS[:4]] == [sum(x[0] == k for x in base) for k in range(4)]
        kept = [s for s in row["spans"].split(",") if s.split(":")[0] in P.KINDS[:4]]
        assert ",".join(kept) == listed(base) and len(re.findall("(generalize|remove):", row["spans"])) == row["n_terms"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    bits = ["a", "b", "@", "@", ".", ".", "-", "+", "1", "2", "0", "9", " ", "(", ")", "é", "_", "\n", "\U0001f600", "255.", "256.",
            "007", "4111111111111111", "4111 1111-1111 1111", "+1 234 567 8901", "x@y.zz"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(2500)]
    return out + [None, "", "a@b.c_d@e.f x@y.z", "1.2.3.4.5.6.7.8", "4111-1111-1111-1111 " * 300, "x@y.zz " * 700,
                  "a@" + "b." * 3000 + "c", "+1" * 500, "1 " * 3000, "1" * 3000, "a" * 3000]


def test_base_spans_match_the_given_patterns(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r for r in P.scan_personal_data(df).collect()}
    assert len(found) == len(texts)
    check([(t, found[i]) for i, t in enumerate(texts)])


def test_long_runs_need_no_recursion_and_no_square_time(spark):
    runs = ["a" * 200_000, "1" * 200_000, "1-" * 100_000, "a@" + "b." * 50_000, "+" * 100_000, "1." * 100_000, "a.b" * 50_000 + "@"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(runs)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_email"] for r in P.scan_personal_data(df).collect()}[3] == 1


def plain_terms(texts):
    """{document: {term: kind}} of the disclosing terms, by direct counting of every pair."""
    both, entity, docs_with, names, found = Counter(), Counter(), Counter(), set(), {}
    word, here = r"[^\W\d_]{2,}", []
    for text in texts:
        spans = sorted((s, e, k) for k, s, e in plain_spans(text))
        rest, at = "", 0
        for s, e, _ in spans:
            rest += text[at:s] + "," * (e - max(at, s))
            at = max(at, e)
        rest += text[at:]
        entities, terms = {f"{k}:{text[s:e].lower()}" for s, e, k in spans}, {w.lower() for w in re.findall(word, rest)}
        capital = {m.group().lower() for m in re.finditer(r"(?<=[^\W_] |[,;:] )[^\W\d_]+", rest) if m.group()[0].isupper() and len(m.group()) > 1}
        here.append((entities, terms))
        entity.update(entities)
        both.update((e, t) for e in entities for t in terms)
        names |= {(e, t) for e in entities for t in capital}
        docs_with.update({w.lower() for w in re.findall(word, text)})
    for i, (entities, terms) in enumerate(here):
        for e in entities:
            for t in terms:
                bits = -math.log2(both[e, t] / (docs_with[t] + (P.NAME_PRIOR if (e, t) in names else P.PRIOR)))
                if bits <= P.GENERALIZE_BITS:
                    kind = "remove" if bits <= P.REMOVE_BITS else "generalize"
                    found.setdefault(i, {})[t] = max(kind, found.get(i, {}).get(t, ""))
    return found


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    common = ["".join(rng.choice("aeioutrsnl") for _ in range(rng.randint(3, 7))) for _ in range(60)]
    texts = []
    for i in range(400):
        words = [rng.choice(common) for _ in range(30)]
        if i % 20 == 0:  # the same person, always beside the same rare words
            words[12:13] = ["chief", "Zamboni", "ann@corp.example", "ann@corp.example", "harbour"]
        elif i % 7 == 0:
            words[5:5] = [f"user{i}@mail.example"]
        texts.append(" ".join(words))
    # A one-off address with a rare name beside it, one far away behind another entity, a rare word written small.
    texts.append("we met Li Wuxing today " + "and " * 60 + "solo@one.example or +49 30 1234567 but " + "and " * 60 + "then, Qadir the zyxwv left")
    return texts


def test_disclosing_terms_match_direct_counts(spark, corpus):
    df = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string").repartition(5)
    rows = {r["doc_id"]: r for r in P.scan_personal_data(df).collect()}
    want = plain_terms(corpus)
    assert want[0]["zamboni"] == want[0]["harbour"] == "remove"
    assert {"li", "wuxing", "qadir"} <= want[400].keys() and not {"zyxwv", "and", "met", "then"} & want[400].keys()
    for i, text in enumerate(corpus):
        spans = [s.split(":") for s in rows[i]["spans"].split(",") if s]
        found = {(text[int(s):int(e)].lower(), k) for k, s, e in spans if k in P.KINDS[4:]}
        assert found == set(want.get(i, {}).items()), i
        assert rows[i]["n_terms"] == sum(k in P.KINDS[4:] for k, _, _ in spans)
    check([(t, rows[i]) for i, t in enumerate(corpus)])


def test_terms_are_marked_wherever_they_stand(spark):
    text = "Zamboni writes. we asked Zamboni twice: zamboni@x.example, zamboni again"
    df = spark.createDataFrame([(0, text), (1, "nothing here"), (2, "we asked twice again")], "doc_id long, text string")
    row = {r["doc_id"]: r for r in P.scan_personal_data(df).collect()}[0]
    marked = [text[int(s):int(e)] for k, s, e in (x.split(":") for x in row["spans"].split(",")) if k == "generalize"]
    assert marked.count("Zamboni") == 2 and marked.count("zamboni") == 1 and "asked" not in marked


def test_ordinary_data_has_disclosing_terms(spark):
    """On sf0.1 the method finds terms, in documents with entities alone."""
    found = P.op4_personal_data(spark, "/root/testdata/sf0.1")
    held = F.expr("n_email + n_ip + n_card + n_phone")
    got = found.agg(F.sum("n_terms").alias("terms"), F.sum(F.when(held == 0, F.col("n_terms"))).alias("elsewhere"), F.count_if(F.col("n_terms") > 0).alias("docs")).first()
    assert got["terms"] > 0 and got["elsewhere"] == 0 and got["docs"] > 10


def test_sanitized_texts_hold_no_personal_data(spark, texts, corpus):
    rows = [(i, t, "en", None, 3) for i, t in enumerate(texts + corpus)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    clean = P.sanitize(df)
    assert clean.columns == df.columns
    found = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert len(found) == len(rows)
    for i, text, *_ in rows:
        assert not plain_spans(found[i]), repr(found[i])[:200]
        if not plain_spans(text):
            assert found[i] == text
    assert "Zamboni" not in found[len(texts)] and "[REMOVED]" in found[len(texts)]


def test_edge_rows(edge_docs, no_docs):
    out = P.scan_personal_data(edge_docs)
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(r["doc_id"]) for r in edge_docs.collect())
    assert {r["doc_id"]: r["n_email"] for r in out.collect()}[8] == 1
    clean = P.sanitize(edge_docs)
    assert clean.columns == edge_docs.columns
    texts = sorted((str(r["doc_id"]), str(r["text"])) for r in clean.collect())
    assert texts == sorted((str(r["doc_id"]), str(r["text"]).replace("x@y.example", "[EMAIL]")) for r in edge_docs.collect())
    assert P.scan_personal_data(no_docs).count() == P.sanitize(no_docs).count() == 0


def test_only_data_frame_functions_are_used(spark, corpus):
    df = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string")
    plan = P.scan_personal_data(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
