"""Hard negatives by a GNAT-style multiway hyperplane tree.

Every vector x gets one more coordinate, sqrt(M^2 - |x|^2) with M the greatest norm, and an anchor a
zero in its place. Then distance^2 = |a|^2 + M^2 - 2 a.x, so the scores asked for are an annulus
around the anchor. A node of the tree has split points; a vector belongs to the nearest of them, and
for every pair (i, j) the node keeps the range of distances from split point i to the vectors below j.
By the triangle inequality these ranges, shifted by the anchor's distance to i, bound the distances
of everything below j; a sibling whose bounds miss the anchor's annulus is eliminated. Leaves are
scored exactly in whole numbers.

The top node is built by Spark over all rows and splits them into cells, cells into blocks of a
bounded number of rows; below that, each block's tree is built and searched inside a task.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripparity.llm.common import materialize, read_table, ready
from tripparity.llm.topk import quantized

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
WINDOW = (50, 95)  # percent of the positive's score
ANCHOR_MODULUS = 50
BLOCK = 8192  # rows per block
QUERY_BLOCK = 2048
CELLS = 64  # split points of the top node at most
SAMPLE = 2048  # rows that the top node's split points are chosen from
SPLITS = 12
LEAF = 256
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_EXACT = float(1 << 52)
_MARGIN = 1e-6  # of the greatest distance; keeps rounded bounds on the safe side
_QUERY = "row long, entry long, id long, label long, v array<long>, lo long, hi long"


# ------------------------------------------------------------------ geometry

def _padded(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _narrow(whole: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest type that holds them; blocks are shuffled in it."""
    low, high = whole.min(initial=0), whole.max(initial=0)
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return whole.astype(kind)


def _lift(points: np.ndarray, mass: float) -> np.ndarray:
    """The coordinate that gives every vector the same norm."""
    return np.sqrt(np.maximum(mass - (points * points).sum(axis=1), 0.0))


def _between(a: np.ndarray, a_lift: np.ndarray, b: np.ndarray, b_lift: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T) + (a_lift[:, None] - b_lift) ** 2
    return np.sqrt(np.maximum(square, 0.0))


def _far_apart(points: np.ndarray, lift: np.ndarray, count: int) -> np.ndarray:
    """Places of up to ``count`` different points, each the farthest from those before it."""
    chosen = [0]
    gap = _between(points, lift, points[:1], lift[:1])[:, 0]
    while len(chosen) < count and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _between(points, lift, points[chosen[-1:]], lift[chosen[-1:]])[:, 0])
        gap[chosen] = 0
    return np.array(chosen)


def _ranges(distances: np.ndarray, owner: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance from split point i to the members of j, for every i and j."""
    low, high = np.full((count, count), np.inf), np.full((count, count), -np.inf)
    for j in range(count):
        mine = distances[owner == j]
        if len(mine):
            low[:, j], high[:, j] = mine.min(axis=0), mine.max(axis=0)
    return low, high


def may_hold(to_splits: np.ndarray, low: np.ndarray, high: np.ndarray, inner: np.ndarray, outer: np.ndarray,
             margin: float) -> np.ndarray:
    """queries x siblings: whether the sibling's distance bounds meet the query's annulus."""
    nearest = np.zeros((len(to_splits), low.shape[1]))
    farthest = np.full_like(nearest, np.inf)
    for i in range(low.shape[0]):
        d = to_splits[:, i, None]
        nearest = np.maximum(nearest, np.maximum(d - high[i], low[i] - d))
        farthest = np.minimum(farthest, d + high[i])
    return (nearest <= outer[:, None] + margin) & (farthest >= inner[:, None] - margin) & np.isfinite(low[0])


def annulus(norm: np.ndarray, mass: float, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance of rows that score from lo to hi; the ends of the long range bound nothing."""
    inner, outer = (np.sqrt(np.maximum(norm + mass - 2 * s.astype(float), 0.0)) for s in (hi, lo))
    return np.where(hi == HIGH, 0.0, inner), np.where(lo <= LOW + 1, np.inf, outer)


def build(points: np.ndarray, lift: np.ndarray, at: np.ndarray, splits: int = SPLITS, leaf: int = LEAF):
    """A leaf is an array of places, a node (split places, low, high, children)."""
    if len(at) <= leaf:
        return at
    chosen = at[_far_apart(points[at], lift[at], splits)]
    if len(chosen) < 2:
        return at  # equal vectors
    distances = _between(points[at], lift[at], points[chosen], lift[chosen])
    owner = distances.argmin(axis=1)
    low, high = _ranges(distances, owner, len(chosen))
    return chosen, low, high, [build(points, lift, at[owner == j], splits, leaf) for j in range(len(chosen))]


class Search:
    """Best ``k`` rows of one block for each query, by score, then id, then row.

    ``lo`` and ``hi`` bound a query's scores; ``lo`` rises to the k-th best score found.
    """

    def __init__(self, block, queries, same: bool, k: int, mass: float):
        self.rows, self.ids, self.labels, self.data, self.tree = block
        self.q_rows, self.q_labels, self.q, self.lo, self.hi = queries
        self.same, self.k, self.mass = same, k, mass
        self.points, self.vectors = self.data.astype(float), self.q.astype(float)
        self.lift = _lift(self.points, mass)
        self.norm = (self.vectors * self.vectors).sum(axis=1)
        self.margin = _MARGIN * (np.sqrt(mass) + np.sqrt(self.norm.max(initial=0.0)))
        self.floor = self.lo.copy()
        self.found: list[list[tuple[int, int, int, int]]] = [[] for _ in self.q_rows]  # (-score, id, row, place)
        self.leaves = 0

    def run(self) -> list[list[tuple[int, int, int, int]]]:
        widest = float(np.abs(self.points).max(initial=0)) * float(np.abs(self.vectors).max(initial=0))
        if widest * max(self.q.shape[1], 1) < _EXACT and self.mass < _EXACT:
            self._walk(self.tree, np.arange(len(self.q_rows)))
        else:
            self._plain()
        return self.found

    def _walk(self, node, asked: np.ndarray) -> None:
        if isinstance(node, np.ndarray):
            self.leaves += 1
            self._leaf(node, asked)
            return
        chosen, low, high, children = node
        square = self.norm[asked, None] + self.mass - 2 * (self.vectors[asked] @ self.points[chosen].T)
        to_splits = np.sqrt(np.maximum(square, 0.0))
        for j in np.argsort(to_splits.mean(axis=0)).tolist():
            ring = annulus(self.norm[asked], self.mass, self.floor[asked], self.hi[asked])  # floors rise on the way
            holds = may_hold(to_splits, low[:, j:j + 1], high[:, j:j + 1], *ring, self.margin)[:, 0]
            if holds.any():
                self._walk(children[j], asked[holds])

    def _leaf(self, at: np.ndarray, asked: np.ndarray) -> None:
        scores = (self.vectors[asked] @ self.points[at].T).astype(np.int64)
        fits = (scores >= self.floor[asked, None]) & (scores <= self.hi[asked, None])
        fits &= (self.labels[at] == self.q_labels[asked, None]) == self.same
        fits &= self.rows[at] != self.q_rows[asked, None]
        for i in np.flatnonzero(fits.any(axis=1)).tolist():
            hit = np.flatnonzero(fits[i])
            place, score = at[hit], scores[i, hit]
            best = np.lexsort((self.rows[place], self.ids[place], -score))[:self.k]
            self._offer(int(asked[i]), zip((-score[best]).tolist(), self.ids[place[best]].tolist(), self.rows[place[best]].tolist()))

    def _offer(self, query: int, candidates) -> None:
        kept = sorted([*self.found[query], *candidates])[:self.k]
        self.found[query] = kept
        if len(kept) == self.k:
            self.floor[query] = max(self.floor[query], -kept[-1][0])

    def _plain(self) -> None:
        """Components too large for exact doubles: whole-number sums, clamped to the long range."""
        data = self.data.astype(object)
        for i in range(len(self.q_rows)):
            scores = [min(max(int(s), int(LOW) + 1), int(HIGH)) for s in data @ self.q[i].astype(object)] if self.q.shape[1] else [0] * len(data)
            self._offer(i, [(-s, int(c), int(r)) for s, c, r, label in zip(scores, self.ids, self.rows, self.labels)
                            if self.lo[i] <= s <= self.hi[i] and (label == self.q_labels[i]) == self.same and r != self.q_rows[i]])


# ------------------------------------------------------------------ Spark jobs

class _Index:
    """All rows in cells of the top node and blocks of at most about ``block`` rows, each with its tree."""

    def __init__(self, rows: DataFrame, block: int, cells: int):
        shape = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(F.expr(
            "aggregate(v, 0D, (s, x) -> s + cast(x as double) * cast(x as double))")).alias("mass")).first()
        self.width, self.mass = int(shape["width"] or 0), float(shape["mass"] or 0.0)
        width, mass = self.width, self.mass
        wanted = max(1, min(cells, -(-shape["n"] // block)))
        share = min(1.0, (2.0 * SAMPLE + 50) / max(shape["n"], 1))
        order = F.xxhash64("row")
        sample = rows.where(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(order, "row").limit(SAMPLE).select("v").collect()
        points = _padded([r["v"] for r in sample], width).astype(float) if sample else np.zeros((1, width))
        chosen = points[_far_apart(points, _lift(points, mass), wanted)]
        chosen_lift = _lift(chosen, mass)
        count = len(chosen)

        @F.pandas_udf("struct<cell:int,d:array<double>>")
        def assign(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for part in parts:
                p = _padded(list(part), width).astype(float)
                d = _between(p, _lift(p, mass), chosen, chosen_lift)
                yield pd.DataFrame({"cell": d.argmin(axis=1).astype(np.int32), "d": list(d)})

        placed = materialize(rows.withColumn("at", assign("v")).select("*", "at.cell", "at.d").drop("at"), "hardneg-rows")
        bounds = placed.groupBy("cell").agg(F.count("*").alias("n"), *[f(F.col("d")[i]).alias(f"{name}{i}") for i in range(count)
                                                                       for name, f in (("low", F.min), ("high", F.max))]).collect()
        self.low, self.high = np.full((count, count), np.inf), np.full((count, count), -np.inf)
        parts = {}
        for r in bounds:  # at most CELLS rows
            parts[r["cell"]] = -(-r["n"] // block)
            for i in range(count):
                self.low[i, r["cell"]], self.high[i, r["cell"]] = r[f"low{i}"], r[f"high{i}"]
        self.splits = chosen
        self.parts = F.create_map(*[F.lit(x) for pair in (parts or {0: 1}).items() for x in pair])
        self.placed = placed.withColumn("part", F.pmod(F.xxhash64("row"), self.parts[F.col("cell")]).cast("int"))

        def pack(group: pd.DataFrame) -> pd.DataFrame:
            data = _padded(list(group["v"]), width)
            points = data.astype(float)
            tree = build(points, _lift(points, mass), np.arange(len(data))) if len(data) else np.arange(0)
            held = [group[c].to_numpy(np.int64) for c in ("row", "id", "label")]
            return pd.DataFrame({"cell": [group["cell"].iloc[0]], "part": [group["part"].iloc[0]],
                                 "block": [pickle.dumps((*held, _narrow(data), tree))]})

        self.blocks = materialize(self.placed.groupBy("cell", "part").applyInPandas(pack, "cell int, part int, block binary"), "hardneg-blocks")

    def asked(self, queries: DataFrame, size: int, home: bool) -> DataFrame:
        """Query blocks, one row per cell whose rows may lie in an annulus of the block's queries.

        ``home``: the queries' own cell alone. ``queries`` has the columns of _QUERY and cell.
        """
        width, mass, low, high, splits = self.width, self.mass, self.low, self.high, self.splits

        def pack(group: pd.DataFrame) -> pd.DataFrame:
            held = [group[c].to_numpy(np.int64) for c in ("row", "entry", "id", "label")]
            q, lo, hi = _padded(list(group["v"]), width), group["lo"].to_numpy(np.int64), group["hi"].to_numpy(np.int64)
            if home:
                cells = [int(group["cell"].iloc[0])]
            else:
                points = q.astype(float)
                norm = (points * points).sum(axis=1)
                to_splits = np.sqrt(np.maximum(norm[:, None] + mass - 2 * (points @ splits.T), 0.0))
                margin = _MARGIN * (np.sqrt(mass) + np.sqrt(norm.max(initial=0.0)))
                cells = np.flatnonzero(may_hold(to_splits, low, high, *annulus(norm, mass, lo, hi), margin).any(axis=0)).tolist()
            return pd.DataFrame({"queries": [pickle.dumps((*held, _narrow(q), lo, hi))], "cells": [cells]})

        counts = queries.groupBy("cell").agg(F.ceil(F.count("*") / size).alias("groups"))
        grouped = queries.join(F.broadcast(counts), "cell").withColumn("g", F.pmod(F.xxhash64("row", "entry"), "groups"))
        packed = grouped.groupBy("cell", "g").applyInPandas(pack, "queries binary, cells array<int>")
        return packed.select("queries", F.explode("cells").alias("cell"))

    def search(self, asked: DataFrame, same: bool, k: int, first_part: bool = False) -> DataFrame:
        """Best ``k`` of every (query block, data block) pair that meets: row, entry, id, score, found_id, found_row."""
        mass = self.mass

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for r in part.itertuples(index=False):
                    rows, entries, ids, labels, q, lo, hi = pickle.loads(r.queries)
                    found = Search(pickle.loads(r.block), (rows, labels, q, lo, hi), same, k, mass).run()
                    size = [len(f) for f in found]
                    flat = np.array([c for f in found for c in f], np.int64).reshape(-1, 3)
                    yield pd.DataFrame({"row": np.repeat(rows, size), "entry": np.repeat(entries, size), "id": np.repeat(ids, size),
                                        "score": -flat[:, 0], "found_id": flat[:, 1], "found_row": flat[:, 2]})

        blocks = self.blocks.where("part = 0") if first_part else self.blocks
        # A query block stands once for every cell it meets, which no estimate of its small input shows: never broadcast.
        return asked.join(blocks.select("cell", "block").hint("merge"), "cell").select("queries", "block").mapInPandas(
            run, "row long, entry long, id long, score long, found_id long, found_row long")


def _best(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by row, entry order by score desc, found_id, found_row)"))
    return ranked.where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | Column = "label",
         positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, scale: int = SCALE,
         block: int = BLOCK, query_block: int = QUERY_BLOCK, cells: int = CELLS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its ``positives`` best other rows of the same label, a pair's negatives
    the ``negatives`` best rows of other labels with window[0] * positive <= 100 * score <=
    window[1] * positive; scores are integer inner products, ties go to the smaller id (then to the
    earlier row). Rows with a null id, label or vector, or a null or non-finite component, take no
    part; an empty vector scores 0; shorter vectors count as filled up with zeros; scores beyond 64
    bits count as the greatest or least number; repeated rows are rows of their own and only an
    anchor's own row is left out; an empty table gives an empty result; other columns are ignored.
    """
    ready(vectors.sparkSession)
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantized(F.col(vector_col), scale).alias("v"),
                          label.cast("long").alias("label"), is_anchor.alias("anchor")) \
        .where("id is not null and v is not null and label is not null")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "hardneg-numbered")
    index = _Index(rows, block, cells)

    anchors = index.placed.where("anchor").select("row", "id", "label", "v", "cell")
    names = [c.split()[0] for c in _QUERY.split(", ")] + ["cell"]
    # First the anchor's own cell: what it finds there is the floor everywhere else.
    open_ended = anchors.withColumn("entry", F.lit(0).cast("long")).withColumn("lo", F.lit(int(LOW) + 1)).withColumn("hi", F.lit(int(HIGH)))
    near = index.search(index.asked(open_ended.select(names), query_block, True), True, positives, first_part=True)
    floors = near.groupBy("row").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= positives)
    floored = materialize(open_ended.join(floors.select("row", "floor"), "row", "left")
                          .withColumn("lo", F.coalesce("floor", "lo")).select(names), "hardneg-anchors")
    best = materialize(_best(index.search(index.asked(floored, query_block, False), True, positives), positives), "hardneg-positives")

    # floor and ceiling of whole numbers: 100 * score between window[0] and window[1] percent of the positive
    low, high = (F.col("positive_score").cast("decimal(38,0)") * F.lit(w) for w in window)
    pairs = anchors.join(best.select("row", F.col("rank").cast("long").alias("entry"), F.col("found_id").alias("positive_id"),
                                     F.col("score").alias("positive_score")), "row") \
        .withColumn("lo", F.ceil(low / 100).cast("long")).withColumn("hi", F.floor(high / 100).cast("long"))
    pairs = materialize(pairs, "hardneg-pairs")
    found = _best(index.search(index.asked(pairs.where("lo <= hi").select(names), query_block, False), False, negatives), negatives)
    return found.join(pairs.select("row", "entry", "positive_id", "positive_score"), ["row", "entry"]).select(
        F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def shifted_label() -> Column:
    """The contract's labels: rows with vec_id divisible by 7 get the next of ten."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Contract query: anchors are the rows with vec_id divisible by 50, against every row."""
    return mine(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % ANCHOR_MODULUS == 0, label_col=shifted_label())


OP12_SQL = """
WITH rows AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, c.r AS cr, c.vec_id AS vec_id, a.label = c.label AS same,
         CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM rows a JOIN rows c ON a.r <> c.r
  WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, cr) <= 5
), ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.ar, p.cr ORDER BY n.score DESC, n.vec_id, n.cr) AS INTEGER) AS rank
  FROM positives p JOIN scored n ON n.ar = p.ar AND NOT n.same
    AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""
