"""Mixing sources to target weights by cube-method balanced sampling.

Every document gets an expected number of copies, target / size of its source. The whole part is
taken for certain; the fractional part is an inclusion probability. The cube method then moves the
probabilities of a source through the null space of two constraints, the source's word total and its
document total, until each is 0 or 1. The flight runs in blocks of a bounded number of documents, the
at most two undecided documents of each block meet in further rounds, and only when a source is down
to one block are its last documents landed: the word total stays balanced, the document total is given up.
"""

from __future__ import annotations

import random
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

from tripparity.llm.common import materialize, read_table, ready, word_count

WEIGHTS = (5.0, 2.0, 1.0)  # by rank of the source's name, repeating
BUDGET_SHARE = 1.5
MAX_REPEAT = 2.0
BLOCK = 1000
HELD = 48  # documents of a source that settle its word total at the end
SEED = 20240601
_EPS = 1e-9
_HASHED = (StringType, BinaryType, BooleanType, NumericType, DateType, TimestampType, TimestampNTZType)


def _null_vector(sizes: list[float]) -> list[float]:
    """A direction that changes neither sum(p * size) nor sum(p) of three documents."""
    a, b, c = sizes
    if a == b == c:
        return [1.0, -1.0, 0.0]
    u = [b - c, c - a, a - b]
    top = max(abs(x) for x in u)
    return [x / top for x in u]


def _move(p: list[float], u: list[float], rng: random.Random) -> list[float]:
    """Moves p along +u or -u to the next wall of the unit cube, keeping its expectation."""
    ahead = min(((1 - x) / d if d > 0 else x / -d) for x, d in zip(p, u) if d)
    back = min((x / d if d > 0 else (1 - x) / -d) for x, d in zip(p, u) if d)
    step = ahead if rng.random() * (ahead + back) < back else -back
    moved = [x + step * d for x, d in zip(p, u)]
    return [0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x for x in moved]


def flight(probabilities: list[float], sizes: list[float], rng: random.Random) -> list[float]:
    """Flight phase: at most two probabilities stay strictly between 0 and 1."""
    p = [0.0 if x < _EPS else 1.0 if x > 1 - _EPS else float(x) for x in probabilities]
    hand: list[int] = []
    for i, x in enumerate(p):
        if not 0 < x < 1:
            continue
        hand.append(i)
        while len(hand) == 3:
            moved = _move([p[k] for k in hand], _null_vector([sizes[k] for k in hand]), rng)
            for k, v in zip(hand, moved):
                p[k] = v
            hand = [k for k in hand if 0 < p[k] < 1]
    while len(hand) == 2 and sizes[hand[0]] == sizes[hand[1]]:
        for k, v in zip(hand, _move([p[k] for k in hand], [1.0, -1.0], rng)):
            p[k] = v
        hand = [k for k in hand if 0 < p[k] < 1]
    return p


def landing(probabilities: list[float], sizes: list[float], rng: random.Random) -> list[float]:
    """Landing phase: gives up the document total and keeps the word total, largest documents first.

    Two undecided documents at a time move along (size of the other, -own size); a large one is
    settled against several small ones. What is left is one document, drawn by its probability.
    """
    p = list(probabilities)
    hand: list[int] = []
    for i in sorted((k for k, x in enumerate(p) if 0 < x < 1), key=lambda k: -sizes[k]):
        hand.append(i)
        while len(hand) == 2:
            a, b = (sizes[k] for k in hand)
            u = [b / (a + b), -a / (a + b)] if a + b else [1.0, -1.0]
            for k, v in zip(hand, _move([p[k] for k in hand], u, rng)):
                p[k] = v
            hand = [k for k in hand if 0 < p[k] < 1]
    for k in hand:
        p[k] = float(rng.random() < p[k])
    return p


def _fly(block: pd.DataFrame, seed: int, last: bool) -> pd.DataFrame:
    """One block's flight; a source's last block keeps about ``HELD``
    documents of all sizes, the smallest among them, for the landing."""
    block = block.sort_values(["size", "order", "row"], ascending=[False, True, True], kind="stable")
    rng = random.Random(f"{seed}:{block['source_key'].iloc[0]}:{block['block'].iloc[0]}:{len(block)}")
    sizes, p = [float(x) for x in block["size"]], [float(x) for x in block["p"]]
    if not last:
        return block.assign(p=flight(p, sizes, rng))
    every = max(3, len(p) // HELD)
    main = [i for i in range(len(p)) if i % every < every - 1 and i < len(p) - HELD // 4]
    for i, x in zip(main, flight([p[i] for i in main], [sizes[i] for i in main], rng)):
        p[i] = x
    return block.assign(p=landing(p, sizes, rng))


def source_targets(sizes: DataFrame, weights: Iterable[float] = WEIGHTS, budget_share: float = BUDGET_SHARE,
                   max_repeat: float = MAX_REPEAT) -> DataFrame:
    """Adds ``target`` to a table of (source, source_size), one row per source.

    Sources rank by code point, null last, and take the weights in turn. The budget is
    ``budget_share`` of all sizes; no target exceeds ``max_repeat`` times its source's size, and the
    excess goes to the other sources by weight until none is above. Only scalars reach the driver.
    """
    spark, weights = sizes.sparkSession, list(weights)
    ranked = sizes.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex() \
        .map(lambda x: (x[0]["source"], x[0]["source_size"], x[1]))
    table = spark.createDataFrame(ranked, "source string, source_size long, rank long")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = materialize(table.select("source", "source_size", weight.alias("weight"),
                                     (F.col("source_size") * max_repeat).alias("cap")), "mix-sources")
    budget = budget_share * float(table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level = 0.0
    while True:  # each pass caps at least one more source
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        row = table.agg(F.sum(F.when(full, F.col("cap"))).alias("held"),
                        F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        new = (budget - (row["held"] or 0.0)) / row["open"]
        if new <= level:
            break
        level = new
    return table.select("source", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, keep: list[str], source_col: str = "source", text_col: str = "text",
        weights: Iterable[float] = WEIGHTS, budget_share: float = BUDGET_SHARE, max_repeat: float = MAX_REPEAT,
        block: int = BLOCK, seed: int = SEED, draw: list[str] | None = None) -> DataFrame:
    """Copies of each document in a balanced sample: the ``keep`` columns (documents' names) under
    their own names, then size, source_size, target, copies, taken, and the row key ``__row``.

    The key is a running number written with the rows, unique also for repeated rows; the draw
    depends on the hash of the ``draw`` columns (the kept ones unless given), so reruns agree however
    the table is partitioned. Rows of one hash that are more than a block are dealt to all blocks of
    their source by their key: equal rows may then change places between runs. Null texts have size
    0; a null source is a source of its own; a document of size 0 follows its source's rate; sources
    of size 0 have target 0 and are not taken; an empty table gives an empty result.
    """
    spark = ready(docs.sparkSession)
    kept = {c: f"__in_{i}" for i, c in enumerate(keep)}
    drawn = F.xxhash64(*[F.col(c) for c in (keep if draw is None else draw)])
    rows = docs.select(*[F.col(c).alias(v) for c, v in kept.items()], F.col(source_col).cast("string").alias("source"),
                       word_count(F.col(text_col)).alias("size"), drawn.alias("order"))
    rows = materialize(rows.withColumns({"row": F.monotonically_increasing_id(),
                                         "order": F.xxhash64("order", "size")}), "mix-rows")
    often = materialize(rows.groupBy("order").count().where(F.col("count") > block).select("order", F.lit(True).alias("often")),
                        "mix-often")
    rows = rows.join(often, "order", "left")
    stats = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = source_targets(stats.select("source", "source_size"), weights, budget_share, max_repeat)
    targets = materialize(targets.join(stats.select(F.col("source").alias("__s"), "n"), F.col("source").eqNullSafe(F.col("__s")))
                          .select(F.col("source").alias("__s"), "source_size", "target", "n",
                                  F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias("rate")), "mix-targets")
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    whole = F.floor(F.col("rate") + _EPS)
    rows = materialize(rows.withColumns({
        "whole": whole.cast("int"), "p": F.greatest(F.col("rate") - whole, F.lit(0.0)),
        "source_key": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")),
        "block": F.pmod(F.when(F.col("often"), F.xxhash64("order", "row")).otherwise(F.col("order")),
                        F.ceil(F.col("n") / block)).cast("long"), "blocks": F.ceil(F.col("n") / block)}),
        "mix-rates")
    state = rows.where((F.col("p") > _EPS)).select("source_key", "row", "order", "size", "p", "block", "blocks")
    settled = None
    while True:
        last = state.agg(F.max("blocks")).first()[0]
        schema = state.schema
        flown = [state.where("blocks > 1").groupBy("source_key", "block").applyInPandas(lambda b: _fly(b, seed, False), schema),
                 state.where("blocks = 1").groupBy("source_key", "block").applyInPandas(lambda b: _fly(b, seed, True), schema)]
        done = materialize((flown[0].unionByName(flown[1]) if (last or 0) > 1 else flown[1]), "mix-flight")
        part = done.where("p = 0 or p = 1").select("row", F.col("p").cast("int").alias("extra"))
        settled = part if settled is None else settled.unionByName(part)
        if (last or 0) <= 1:
            break
        # Two undecided documents at most come from a block; the next round's blocks hold as many as the first's.
        blocks = F.ceil(F.col("blocks") * 2 / block)
        state = done.where("p > 0 and p < 1").withColumn("blocks", blocks) \
            .withColumn("block", F.pmod(F.col("block"), F.col("blocks")))
    taken = rows.join(settled, "row", "left").withColumn("copies", F.col("whole") + F.coalesce("extra", F.lit(0)))
    return taken.select(*[F.col(v).alias(c) for c, v in kept.items()], "size", "source_size", "target",
                        "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), F.col("row").alias("__row"))


def mix_documents(docs: DataFrame, source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mixed corpus itself: every column of ``docs``, each document as many times as it is taken.

    The draw goes by the contents of the row (columns of plain types), not by where it is stored.
    """
    inner = {c: f"__doc_{i}" for i, c in enumerate(docs.columns)}
    numbered = materialize(docs.withColumnsRenamed(inner).withColumn("__key", F.monotonically_increasing_id()), "mix-input")
    contents = [inner[f.name] for f in docs.schema if isinstance(f.dataType, _HASHED)]
    copies = mix(numbered, ["__key"], inner[source_col], inner[text_col], draw=contents, **options).where("copies > 0") \
        .select("__key", "copies")
    out = numbered.join(copies, "__key").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select([F.col(v).alias(k) for k, v in inner.items()])


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents, weights 5, 2, 1 by source, 150 % of all words, at most twice."""
    out = mix(read_table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")
