"""Personal data: fixed patterns, and terms that disclose them, in DataFrame functions only.

The protected entities are the values that the patterns find. Documents of the whole corpus are counted
in which a term, an entity, and both occur. What a term leaves unknown about an entity is
-log2 P(entity | term) bits, with P = both / (documents of the term + prior). A term that leaves at most
a first threshold is generalised, below a second one removed, wherever it stands in the entity's
documents. The prior says how much a term may be chance: it is smaller for words written like names
(a capital inside a sentence), so that one document beside a one-off entity is enough for a rare name,
while an ordinary word needs two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripparity.llm.common import materialize, read_table
from tripparity.llm.quality_rules import let

KINDS = ("email", "ip", "card", "phone", "generalize", "remove")
# The contract's patterns, written so that matching needs neither recursion nor a second try at a
# later character of the same run: possessive repeats, and a start only where a run starts or the
# match before has ended. A card's run is cut to the lengths that can pass.
PATTERNS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TERM = r"\p{L}{2,}+"
NAME = r"(?<=[\p{L}\p{N},;:]\x20)\p{Lu}\p{L}++"
PRIOR, NAME_PRIOR = 2.0, 1.0  # documents
GENERALIZE_BITS, REMOVE_BITS = 1.0, 0.35
MARKS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", "[REMOVED]")
_CHUNK = 256


def running_starts(lengths: Column) -> Column:
    """Sum of the lengths before each element, in chunks so that long arrays stay cheap."""
    empty = F.array().cast("array<bigint>")

    def run(values: Column, at: Column) -> Column:
        return F.aggregate(values, F.struct(at.cast("long").alias("at"), empty.alias("out")),
                           lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
                           lambda acc: acc["out"])

    def chunked(values: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _CHUNK).cast("int")),
                             lambda c: F.slice(values, c * _CHUNK + 1, F.lit(_CHUNK)))

        def spread(parts: Column) -> Column:
            total = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, n: a + n))
            return let(run(total, F.lit(0)), lambda starts: F.flatten(F.transform(parts, lambda p, i: run(p, starts[i]))))

        return F.when(F.size(values) == 0, empty).otherwise(let(chunks, spread))

    return let(lengths, chunked)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, value), code points; empty if there is none."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")

    def located(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
        steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: g + F.length(m))
        return let(running_starts(steps), lambda before: let(gaps, lambda g: F.transform(found, lambda m, i: F.struct(
            (before[i] + g[i]).alias("start"), (before[i] + g[i] + F.length(m)).alias("end"), m.alias("value")))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
               lambda found: F.when(F.size(found) == 0, none).otherwise(located(found)))


def _luhn(value: Column) -> Column:
    def total(digits: Column) -> Column:
        doubled = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: let(
            digits.substr(-i, F.lit(1)).cast("int"), lambda d: F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)))
        return F.aggregate(doubled, F.lit(0), lambda a, d: a + d)

    return let(F.regexp_replace(value, "[ -]", ""), total) % 10 == 0


def _valid(kind: int, value: Column) -> Column:
    if kind == 1:
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == 2:
        return _luhn(value)
    if kind == 3:
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def may_hold(text: Column) -> Column:
    """Whether any pattern occurs in the text (before the checks on matches)."""
    hints = (text.contains("@"), text.contains("."), F.lit(True), text.contains("+"))
    found = F.lit(False)
    for hint, pattern in zip(hints, PATTERNS):
        found = found | (hint & text.rlike(pattern))
    return F.coalesce(found, F.lit(False))


def base_spans(text: Column) -> Column:
    """All pattern matches that pass their checks: (start, kind number, end, value) in order."""

    def of_kind(kind: int) -> Column:
        good = F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
        return F.transform(good, lambda m: F.struct(
            m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))

    return F.sort_array(F.concat(*[of_kind(kind) for kind in range(len(PATTERNS))]))


def of_kind_count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _blanked(text: Column, spans: Column) -> Column:
    """``text`` with commas in place of every character of the spans (in order): all other places stay."""
    empty = F.array().cast("array<string>")

    def step(acc: Column, s: Column) -> Column:
        start = F.greatest(acc["at"], s["start"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(
            F.substring(text, (acc["at"] + 1).cast("int"), (start - acc["at"]).cast("int")),
            F.repeat(F.lit(","), F.greatest(s["end"] - start, F.lit(0)).cast("int")))).alias("out"))

    return F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), step,
                       lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))


def document_terms(text: Column, pattern: str = TERM) -> Column:
    """The distinct terms of a text in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda w: F.lower(w)))


def _scanned(docs: DataFrame, text_col: str) -> DataFrame:
    """Documents in which a pattern occurs, numbered, with spans and the text beside them; columns renamed by place."""
    inner = {c: f"__in_{i}" for i, c in enumerate(docs.columns)}
    hits = docs.where(may_hold(F.col(text_col))).withColumnsRenamed(inner).withColumn("__row", F.monotonically_increasing_id())
    hits = materialize(hits.withColumn("__spans", base_spans(F.col(inner[text_col]))), "pii-hits")
    return materialize(hits.withColumn("__rest", _blanked(F.col(inner[text_col]), F.col("__spans"))), "pii-rest")


def disclosing_terms(held: DataFrame, entities: DataFrame, texts: DataFrame, prior: float = PRIOR, name_prior: float = NAME_PRIOR,
                     generalize_bits: float = GENERALIZE_BITS, remove_bits: float = REMOVE_BITS) -> DataFrame:
    """(row, term, kind) for the terms that disclose an entity of their document.

    ``held`` (row, term, name) and ``entities`` (row, entity) of the documents with entities, ``texts``
    (text of every document). Counts are of documents, over the whole corpus. As ``both`` is at most the
    entity's documents, terms of more documents than could pass are dropped before they meet entities;
    nothing else is: the result is that of judging every pair.
    """
    entities = materialize(entities.distinct(), "pii-entities")
    counts = materialize(entities.groupBy("entity").agg(F.count("*").alias("of_entity")), "pii-counts")
    entities = materialize(entities.join(counts, "entity"), "pii-entities")
    terms = texts.select(F.explode(document_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("of_term"))
    least = 2.0 ** -generalize_bits
    widest = counts.agg(F.max("of_entity")).first()[0] or 0
    # Counted before any join, so that words never meet the documents one by one; common ones meet none.
    terms = materialize(terms.where(F.col("of_term") + F.lit(min(prior, name_prior)) <= widest / least), "pii-terms")
    limits = entities.groupBy("row").agg(F.max("of_entity").alias("most"))
    rare = held.join(terms, "term").join(limits, "row").where(F.col("of_term") + F.lit(min(prior, name_prior)) <= F.col("most") / least) \
        .select("row", "term", "name", "of_term")
    pairs = materialize(rare.join(entities, "row").where(F.col("of_term") + F.lit(min(prior, name_prior)) <= F.col("of_entity") / least)
                        .select("row", "entity", "term", "name", "of_term"), "pii-pairs")
    judged = pairs.groupBy("entity", "term").agg(F.count("*").alias("both"), F.max("name").alias("name"), F.max("of_term").alias("of_term"))
    known = F.col("both") / (F.greatest("of_term", "both") + F.when(F.col("name"), F.lit(name_prior)).otherwise(F.lit(prior)))
    judged = materialize(judged.withColumn("bits", -F.log2(known)).where(F.col("bits") <= generalize_bits).select(
        "entity", "term", F.when(F.col("bits") <= remove_bits, F.lit(5)).otherwise(F.lit(4)).alias("kind")), "pii-judged")
    return pairs.join(judged, ["entity", "term"]).groupBy("row", "term").agg(F.max("kind").alias("kind"))


def _with_term_spans(docs: DataFrame, text_col: str, **thresholds) -> DataFrame:
    """``_scanned`` documents with ``__all``: base and term spans (start, kind, end) in order."""
    hits = _scanned(docs, text_col)
    entities = hits.select(F.col("__row").alias("row"), F.explode("__spans").alias("s")).select(
        "row", F.concat_ws(":", F.col("s.kind").cast("string"), F.lower("s.value")).alias("entity"))
    words = hits.where(F.size("__spans") > 0).select(F.col("__row").alias("row"), document_terms(F.col("__rest")).alias("words"),
                                                     document_terms(F.col("__rest"), NAME).alias("names"))
    held = words.select("row", "names", F.explode("words").alias("term")) \
        .select("row", "term", F.array_contains("names", F.col("term")).alias("name"))
    found = disclosing_terms(held, entities, docs.select(F.col(text_col).alias("text")), **thresholds)
    found = materialize(found.groupBy(F.col("row").alias("__row")).agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("__kinds")),
                        "pii-found")

    def placed(kinds: Column) -> Column:
        own = F.transform(matches(F.col("__rest"), TERM), lambda m: F.struct(
            m["start"].alias("start"), F.try_element_at(kinds, F.lower(m["value"])).alias("kind"), m["end"].alias("end")))
        return F.filter(own, lambda m: m["kind"].isNotNull())

    base = F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return hits.join(found, "__row", "left").withColumn("__all", F.when(
        F.col("__kinds").isNull(), base).otherwise(F.sort_array(F.concat(base, placed(F.col("__kinds"))))))


def _listed(spans: Column) -> Column:
    """kind:start:end by kind, then start."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms for every row.

    A null text is empty; texts are scanned whole; repeated rows and null ids stay, each copy counting
    as a document; an empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    hits = _with_term_spans(docs, "text", **thresholds)
    counts = [of_kind_count(F.col("__spans"), k).alias(f"n_{KINDS[k]}") for k in range(4)]
    found = hits.select(F.col("__in_0").alias("doc_id"), *counts, F.sha2(_listed(F.col("__spans")), 256).alias("base_sha256"),
                        _listed(F.col("__all")).alias("spans"), (F.size("__all") - F.size("__spans")).cast("long").alias("n_terms"))
    zero = F.lit(0).cast("long")
    clean = docs.where(~may_hold(F.col("text"))).select(
        "doc_id", *[zero.alias(f"n_{k}") for k in KINDS[:4]], F.sha2(F.lit(""), 256).alias("base_sha256"),
        F.lit("").alias("spans"), zero.alias("n_terms"))
    return found.unionByName(clean)


def _masked(text: Column, spans: Column) -> Column:
    """``text`` with marks in place of ``spans`` (start, kind, end, in order; overlaps join)."""
    marks = F.array(*[F.lit(m) for m in MARKS])

    def step(acc: Column, s: Column) -> Column:
        more = F.when(s["start"] >= acc["at"], F.array(
            F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), marks[s["kind"]])) \
            .otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], more).alias("out"))

    cut = F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")), step,
                      lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(cut)


def sanitize(docs: DataFrame, text_col: str = "text", **thresholds) -> DataFrame:
    """``docs`` with the same columns and rows, spans in ``text_col`` replaced by marks.

    Texts without a match (null texts too) stay as they are. Replacing a match can uncover another
    that a longer, failing one had swallowed; such texts are masked again until none is left (each
    time at least one run of digits or one @ goes).
    """
    hits = _with_term_spans(docs, text_col, **thresholds)
    inner = {c: f"__in_{i}" for i, c in enumerate(docs.columns)}
    own, name = list(inner.values()), inner[text_col]
    rows = materialize(hits.select(*own, "__all").withColumn(name, _masked(F.col(name), F.col("__all"))).drop("__all")
                       .withColumn("__spans", base_spans(F.col(name))), "pii-masked")
    done = rows.where(F.size("__spans") == 0).select(own)
    rows = rows.where(F.size("__spans") > 0)
    while not rows.isEmpty():
        rows = materialize(rows.withColumn(name, _masked(F.col(name), F.col("__spans")))
                           .withColumn("__spans", base_spans(F.col(name))), "pii-masked")
        done = done.unionByName(rows.where(F.size("__spans") == 0).select(own))
        rows = rows.where(F.size("__spans") > 0)
    clean = done.select([F.col(v).alias(k) for k, v in inner.items()])
    return clean.unionByName(docs.where(~may_hold(F.col(text_col))))


def op4_personal_data(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document, default thresholds."""
    return scan_personal_data(read_table(spark, sf_dir, "documents"))
