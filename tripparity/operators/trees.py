"""M3/M4: the forest and the L1 boosted trees of an MLlib estimator, grown on blocks of binned rows.

The estimators' parameters, split rule, stopping rules and leaf values hold (variance gain, first of
equal splits, equal sibling leaves merged; boosted trees are fitted to the sign of the residuals), and
the result is MLlib's own model class, written and read in its saved form. What differs is how the work is spread:

- Bins end at exact order statistics of all rows, or between all values if they are few (MLlib takes a
  sample of about 10,000 rows). The binned rows are dealt once and held as arrays of some 65,536 rows.
- A forest's nodes of more than ``NODE_ROWS`` rows are split by histograms that are summed up by a
  shuffle. The rows of every smaller node go to one task, which grows all that is below it. MLlib
  shuffles a histogram for each node and task down to the last level. Trees are grown some at a
  time, so that the rows on the way are at most ``CORE_BYTES`` a core, or one tree's.
- A boosted tree is grown two levels a job: each task counts its rows of all nodes of a level by
  pairs of bins, from which the level's splits and then the histograms of their sides follow; where
  these are many it counts by bins, a level a job. The scores so far stand beside the rows: renewed after some
  trees, the trees since are applied on the way, and checkpointed now and then.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripparity.session import delete_path, ensure_checkpoint_dir, scratch_path, ship_package

BLOCK_ROWS = 1 << 16
NODE_ROWS = 1 << 17  # of a bag below which one task grows the rest of the tree
CORE_BYTES = 32 << 20  # of bagged rows on their way at once, by core
CELLS = 1 << 22  # of histograms that a task holds at once below such a node
STATE_ROUNDS, CHECKPOINT_ROUNDS = 5, 25  # scores are kept, and cut from their history, after so many
PAIR_CELLS = 1 << 17  # of counts by pairs of bins that a boosting task sends at most
GATHERED_PARTS = 64  # partial histograms that the driver adds up by itself
NOISE = 1e-13  # of the squares: a smaller gain or variance is rounding


# ----------------------------------------------------------------------------- bins and blocks

@dataclass
class Binned:
    """``blocks`` holds (number, codes (features, rows), labels); ``cuts`` are a feature's thresholds in order."""

    blocks: RDD
    cuts: list[np.ndarray]
    rows: int

    @property
    def sizes(self) -> list[int]:
        return [len(c) + 1 for c in self.cuts]


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    held: list[np.ndarray] = []
    for pdf in batches:
        held.append(pdf.to_numpy(dtype=np.float64, na_value=np.nan))
        if sum(map(len, held)) >= BLOCK_ROWS:
            yield np.concatenate(held)
            held = []
    if held:
        yield np.concatenate(held)


def _added(parts: RDD) -> np.ndarray:
    """The sum of the tasks' arrays, counts in 64 bits."""
    if parts.getNumPartitions() > GATHERED_PARTS:
        return parts.map(lambda a: a.astype(np.result_type(a, np.int64))).treeReduce(np.add)
    return sum(a.astype(np.result_type(a, np.int64)) for a in parts.collect())


def _ordered(x: np.ndarray) -> np.ndarray:
    """64-bit keys in the order of the finite values."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 0, bits | np.uint64(1 << 63), ~bits)


def order_statistics(values: RDD, features: int, ranks: list[int]) -> list[np.ndarray]:
    """The values at the 0-based ``ranks`` of every row of the blocks (features, rows): eight passes that count a byte of the keys each,
    only below the bytes before that a wanted rank has."""
    prefix = [np.zeros(len(ranks), np.uint64) for _ in range(features)]
    left = [np.array(ranks, np.int64) for _ in range(features)]
    for shift in range(56, -8, -8):
        open_ = [np.unique(p) for p in prefix]

        def counted(blocks, shift=shift, open_=open_):
            total = [np.zeros(256 * len(o), np.int64) for o in open_]
            for x in blocks:
                for f, o in enumerate(open_):
                    key = _ordered(x[f]) >> np.uint64(shift)
                    above = key >> np.uint64(8)
                    at = np.minimum(np.searchsorted(o, above), len(o) - 1)
                    mine = o[at] == above
                    total[f] += np.bincount(256 * at[mine] + (key[mine] & np.uint64(255)).astype(np.int64), minlength=len(total[f]))
            yield np.concatenate(total)

        counts = _added(values.mapPartitions(counted))
        for f, o in enumerate(open_):
            mine, counts = counts[:256 * len(o)].reshape(-1, 256), counts[256 * len(o):]
            upto = np.cumsum(mine, axis=1)
            at = np.searchsorted(o, prefix[f])
            byte = (upto[at] <= left[f][:, None]).sum(axis=1)
            left[f] = left[f] - np.where(byte > 0, upto[at, byte - 1], 0)
            prefix[f] = (prefix[f] << np.uint64(8)) | byte.astype(np.uint64)
    top = np.uint64(1 << 63)
    return [np.where(p >= top, p ^ top, ~p).view(np.float64) for p in prefix]


def _between(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    middle = (low + high) / 2
    return np.where(middle < high, middle, low)


def thresholds(values: RDD, features: int, rows: int, bins: int) -> list[np.ndarray]:
    """Per feature its at most ``bins - 1`` thresholds (values up to one belong below it), from blocks (features, rows).

    With at most ``bins`` values there is one between any two neighbours; else one above each of the
    order statistics that end ``bins`` equal parts, halfway to the next value.
    """

    def distinct(blocks):
        seen: list[np.ndarray | None] = [np.zeros(0)] * features
        for x in blocks:
            for f in range(features):
                if seen[f] is not None:
                    seen[f] = np.union1d(seen[f], x[f])
                    seen[f] = seen[f] if len(seen[f]) <= bins else None
        yield from enumerate(seen)

    def either(a, b):
        both = None if a is None or b is None else np.union1d(a, b)
        return both if both is not None and len(both) <= bins else None

    found = dict(values.mapPartitions(distinct).reduceByKey(either).collect())
    many = [f for f in range(features) if found[f] is None]
    if many:
        some = values.map(lambda x: x[many])
        ends = [np.unique(e) for e in order_statistics(some, len(many), [-(-i * rows // bins) - 1 for i in range(1, bins)])]

        def above(blocks):
            least = [np.full(len(e) + 1, np.inf) for e in ends]
            for x in blocks:
                for f, e in enumerate(ends):
                    np.minimum.at(least[f], np.searchsorted(e, x[f]), x[f])
            yield least

        following = [np.min(parts, axis=0) for parts in zip(*values.map(lambda x: x[many]).mapPartitions(above).collect())]
    cuts = []
    for f in range(features):
        low, high = (found[f][:-1], found[f][1:]) if found[f] is not None else (ends[many.index(f)], following[many.index(f)][1:])
        cuts.append(_between(low, high)[np.isfinite(high)])
    return cuts


def binned(table: DataFrame, columns: tuple[str, ...], label: str, bins: int) -> Binned:
    """The table's rows in bins; ``blocks`` is persisted and checkpointed, for the caller to :func:`release`. Values that are not finite raise."""
    spark = table.sparkSession
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    features = len(columns)

    def packed(batches):
        for x in _gathered(batches):
            yield pd.DataFrame({"rows": [len(x)], "bad": [int((~np.isfinite(x)).any(axis=1).sum())], "data": [x.T.tobytes()]})

    given = table.select(*[F.col(c).cast("double").alias(c) for c in (*columns, label)]).mapInPandas(packed, "rows long, bad long, data binary")
    values = given.rdd.map(lambda r: (r["bad"], np.frombuffer(r["data"]).reshape(-1, r["rows"]))).persist(StorageLevel.MEMORY_AND_DISK)
    rows, bad = values.map(lambda v: np.array([v[1].shape[1], v[0]])).fold(np.zeros(2, np.int64), np.add).tolist()
    if bad or not rows:
        raise ValueError("trees need rows of finite labels and features")
    cuts = thresholds(values.map(lambda v: v[1][:features]), features, rows, bins)
    kind = np.dtype(np.uint8 if max(map(len, cuts)) < 256 else np.uint16)

    def coded(part, blocks):
        for i, (_, x) in enumerate(blocks):
            yield (part << 20) + i, np.stack([np.searchsorted(c, x[f]) for f, c in enumerate(cuts)]).astype(kind), x[-1]

    blocks = values.mapPartitionsWithIndex(coded).persist(StorageLevel.MEMORY_AND_DISK)
    blocks.checkpoint()  # else every job carries the plan that the rows come from
    blocks.count()
    values.unpersist()
    return Binned(blocks, cuts, rows)


def release(spark: SparkSession, data: Binned) -> None:
    data.blocks.unpersist()
    delete_path(spark, data.blocks.getCheckpointFile())


# ----------------------------------------------------------------------------- kernels

def histogram(codes: np.ndarray, node: np.ndarray, nodes: int, channels: list, sizes: list[int]) -> np.ndarray:
    """(channels, nodes, bins of all features): sums of the channels, None counts rows."""
    out = np.empty((len(channels), nodes, sum(sizes)))
    at = 0
    for f, size in enumerate(sizes):
        key = node * size + codes[f]
        for k, c in enumerate(channels):
            out[k, :, at:at + size] = np.bincount(key, c, nodes * size).reshape(nodes, size)
        at += size
    return out


def best_splits(sums: np.ndarray, squares: np.ndarray, sizes: list[int], least: int) -> tuple[np.ndarray, ...]:
    """Per node of a histogram of rows, labels, ...: feature (-1: none), last bin on the left, variance gain, left sums (channels, nodes).

    Of equal splits the one of the first feature and bin is taken; a side has at least ``least`` rows.
    """
    n, s = sums[0, :, :sizes[0]].sum(axis=1), sums[1, :, :sizes[0]].sum(axis=1)
    nodes = np.arange(len(n))
    feature, cut, left = np.full(len(n), -1), np.zeros(len(n), np.int64), np.zeros(sums.shape[:2])
    with np.errstate(divide="ignore", invalid="ignore"):
        base, best, at = s * s / n, NOISE * squares, 0
        for f, size in enumerate(sizes):
            if size > 1:
                upto = np.cumsum(sums[:, :, at:at + size], axis=2)[:, :, :-1]
                n0, s0 = upto[0], upto[1]
                n1, s1 = n[:, None] - n0, s[:, None] - s0
                gain = np.where((n0 >= least) & (n1 >= least), s0 * s0 / n0 + s1 * s1 / n1 - base[:, None], -np.inf)
                b = gain.argmax(axis=1)
                take = gain[nodes, b] > best
                best = np.where(take, gain[nodes, b], best)
                feature, cut = np.where(take, f, feature), np.where(take, b, cut)
                left = np.where(take, upto[:, nodes, b], left)
            at += size
        return feature, cut, np.where(feature < 0, -1.0, best / n), left


class Tree:
    """Nodes of a tree in order of creation; ``child`` is the left child's place, the right one's is next to it, -1 of a leaf."""

    def __init__(self, rows: float):
        self.id, self.feature, self.cut, self.gain, self.child = [1], [-1], [0], [-1.0], [-1]
        self.sums = [(rows, 0.0, 0.0)]  # rows, labels, their squares

    def split(self, place: int, feature: int, cut: int, gain: float, left: tuple, right: tuple) -> list[int]:
        """The places of the two new leaves."""
        self.feature[place], self.cut[place], self.gain[place], self.child[place] = feature, cut, gain, len(self.id)
        for side, sums in enumerate((left, right)):
            self.id.append(2 * self.id[place] + side)
            self.feature.append(-1)
            self.cut.append(0)
            self.gain.append(-1.0)
            self.child.append(-1)
            self.sums.append(sums)
        return [self.child[place], self.child[place] + 1]

    def level(self, place: int) -> int:
        return self.id[place].bit_length() - 1

    def walk(self) -> tuple:
        """Arrays by place for :func:`route`, in which a leaf leads to itself, and the steps to the last level."""
        child = np.array(self.child)
        leaf = child < 0
        return (np.where(leaf, 0, self.feature), np.where(leaf, np.iinfo(np.int64).max, self.cut),
                np.where(leaf, np.arange(len(child)), child), max(self.level(p) for p in range(len(self.id))))

    def table(self, places=None) -> dict[str, np.ndarray]:
        take = np.arange(len(self.id)) if places is None else np.array(places, np.int64)
        columns = {"id": np.array(self.id, np.int64), "feature": np.array(self.feature), "cut": np.array(self.cut, np.int64),
                   "gain": np.array(self.gain), "sums": np.array(self.sums, float).reshape(-1, 3)}
        return {k: v[take] for k, v in columns.items()}


def route(codes: np.ndarray, walk: tuple) -> np.ndarray:
    """The place of every row's leaf."""
    feature, cut, child, steps = walk
    at, rows = np.zeros(codes.shape[1], np.int64), np.arange(codes.shape[1])
    for _ in range(steps):
        at = child[at] + (codes[feature[at], rows] > cut[at])
    return at


def grow(codes: np.ndarray, w: np.ndarray, y: np.ndarray, start: int, sizes: list[int], depth: int, least: int) -> dict[str, np.ndarray]:
    """All nodes from node ``start`` down for rows of weight ``w``, a level at a time, as in :meth:`Tree.table`."""
    found, ids, node, wy = [], np.array([start], np.int64), np.zeros(len(y), np.int64), w * y
    level = start.bit_length() - 1
    width, channels = sum(sizes), 2
    while len(ids):
        sums = np.stack([np.bincount(node, c, len(ids)) for c in (w, wy, wy * y)], axis=1)
        feature, cut, gain = np.full(len(ids), -1), np.zeros(len(ids), np.int64), np.full(len(ids), -1.0)
        if level < depth:
            step = max(1, CELLS // (channels * width))
            for first in range(0, len(ids), step):
                span = slice(first, min(first + step, len(ids)))
                mine = slice(None) if len(ids) <= step else np.flatnonzero((node >= span.start) & (node < span.stop))
                part = histogram(codes[:, mine], node[mine] - first, span.stop - first, [w[mine], wy[mine]], sizes)
                feature[span], cut[span], gain[span], _ = best_splits(part, sums[span, 2], sizes, least)
        pure = sums[:, 2] - sums[:, 1] ** 2 / sums[:, 0] <= NOISE * sums[:, 2]
        feature[pure], gain[pure] = -1, -1.0
        found.append({"id": ids, "feature": feature, "cut": cut, "gain": gain, "sums": sums})
        split = feature >= 0
        if not split.all():
            stay = split[node]
            codes, w, wy, y, node = codes[:, stay], w[stay], wy[stay], y[stay], node[stay]
        right = codes[feature[node], np.arange(len(node))] > cut[node]
        node = 2 * (np.cumsum(split) - 1)[node] + right
        ids = np.stack([2 * ids[split], 2 * ids[split] + 1], axis=1).ravel()
        level += 1
    return {k: np.concatenate([t[k] for t in found]) for k in found[0]}


# ----------------------------------------------------------------------------- forest

def bag(seed: int, block: int, tree: int, rows: int) -> np.ndarray:
    """How often the tree's bootstrap sample takes each row of the block."""
    return np.random.default_rng([seed, block, tree]).poisson(1.0, rows)


def _split_large(data: Binned, tops: dict[int, Tree], seed: int, depth: int, least: int, node_rows: int) -> dict[int, list[int]]:
    """Splits the trees' nodes of more than ``node_rows`` rows; the places of the smaller ones are returned, to be grown on."""
    sizes, width = data.sizes, sum(data.sizes)
    large = {t: [0] for t, top in tops.items() if top.sums[0][0] > node_rows}
    small: dict[int, list[int]] = {t: [] if t in large else [0] for t in tops}
    while large:
        asked = {t: (tops[t].walk(), np.array(places)) for t, places in large.items()}

        def summed_up(blocks):
            sums = {t: np.zeros((3, len(places), width)) for t, (_, places) in asked.items()}
            for number, codes, y in blocks:
                for t, (walk, places) in asked.items():
                    w = bag(seed, number, t, len(y))
                    place = np.full(len(walk[0]), -1)
                    place[places] = np.arange(len(places))
                    rows = np.flatnonzero(w)
                    node = place[route(codes[:, rows], walk)]
                    rows, node = rows[node >= 0], node[node >= 0]
                    wy = w[rows] * y[rows]
                    sums[t] += histogram(codes[:, rows], node, len(places), [w[rows], wy, wy * y[rows]], sizes)
            yield from sums.items()

        def decided(sums):
            whole = sums[:, :, :sizes[0]].sum(axis=2)
            return *best_splits(sums, whole[2], sizes, least), whole

        summed = data.blocks.mapPartitions(summed_up).reduceByKey(np.add)
        for t, (feature, cut, gain, left, whole) in summed.mapValues(decided).collect():
            top, places = tops[t], large.pop(t)
            for i, place in enumerate(places):
                top.sums[place] = tuple(whole[:, i].tolist())
                rows, total, squares = top.sums[place]
                if feature[i] >= 0 and top.level(place) < depth and squares - total ** 2 / rows > NOISE * squares:
                    for new in top.split(place, int(feature[i]), int(cut[i]), float(gain[i]), tuple(left[:, i].tolist()), tuple((whole - left)[:, i].tolist())):
                        (large.setdefault(t, []) if top.sums[new][0] > node_rows else small[t]).append(new)
        summed.cleanShuffleDependencies(True)
    return small


def _grow_small(data: Binned, tops: dict[int, Tree], small: dict[int, list[int]], seed: int, depth: int, least: int) -> dict[int, dict]:
    """The whole trees, grown on from the leaves in ``small``, each by one task that gets its rows."""
    sizes, cores = data.sizes, data.blocks.context.defaultParallelism
    groups = sorted(((t, place) for t, places in small.items() for place in places), key=lambda g: -tops[g[0]].sums[g[1]][0])
    row = len(sizes) * (1 if max(sizes) <= 256 else 2) + 9
    held = sum(tops[t].sums[place][0] for t, place in groups) * row
    parts = int(max(1, min(len(groups), max(4 * cores, held // (CORE_BYTES // 2)))))
    number = {g: i for i, g in enumerate(groups)}  # the largest are dealt first
    starts = [tops[t].id[place] for t, place in groups]
    walks = {t: tops[t].walk() for t in small if small[t]}

    def dealt(blocks):
        for block, codes, y in blocks:
            for t, walk in walks.items():
                w = bag(seed, block, t, len(y))
                rows = np.flatnonzero(w)
                leaf = route(codes[:, rows], walk)
                order = np.argsort(leaf, kind="stable")
                for place, some in zip(*_runs(leaf[order], rows[order])):
                    if (t, place) in number:
                        yield number[t, place], (block, codes[:, some], w[some].astype(np.uint8), y[some])

    def grown(pairs):
        got: dict[int, list] = {}
        for group, rows in pairs:
            got.setdefault(group, []).append(rows)
        for group in list(got):
            rows = sorted(got.pop(group), key=lambda r: r[0])
            codes, w, y = (np.concatenate([r[k] for r in rows], axis=-1) for k in (1, 2, 3))
            yield group, grow(codes, w.astype(float), y, starts[group], sizes, depth, least)

    shuffled = data.blocks.mapPartitions(dealt).partitionBy(parts, lambda group: group)
    found = {t: [top.table([p for p in range(len(top.id)) if p not in small[t]])] for t, top in tops.items()}
    for group, table in shuffled.mapPartitions(grown).collect():
        found[groups[group][0]].append(table)
    shuffled.cleanShuffleDependencies(True)
    return {t: {k: np.concatenate([p[k] for p in tables]) for k in tables[0]} for t, tables in found.items()}


def _runs(keys: np.ndarray, values: np.ndarray) -> tuple[list, list]:
    """Distinct values of the sorted keys and the values of each."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[starts].tolist(), np.split(values, starts[1:]) if len(keys) else []


def grow_forest(data: Binned, trees: int, depth: int, least: int, seed: int, node_rows: int = NODE_ROWS) -> list[dict]:
    row = len(data.cuts) * (1 if max(data.sizes) <= 256 else 2) + 9
    at_once = int(max(1, CORE_BYTES * data.blocks.context.defaultParallelism // max(1, 0.64 * data.rows * row)))  # of a bag 1 - 1/e are distinct
    found = []
    for first in range(0, trees, at_once):
        tops = {t: Tree(float(data.rows)) for t in range(first, min(first + at_once, trees))}
        small = _split_large(data, tops, seed, depth, least, node_rows)
        grown = _grow_small(data, tops, small, seed, depth, least)
        found += [grown[t] for t in tops]
    return found


# ----------------------------------------------------------------------------- boosting

def _scored(blocks, trees: list[tuple]) -> Iterator[tuple]:
    """The blocks with the last trees' steps added to the scores."""
    for codes, y, score in blocks:
        for walk, step in trees:
            score = score + step[route(codes, walk)]
        yield codes, y, score


def _label_sums(blocks, walk: tuple, place: np.ndarray, nodes: int, sizes: list[int]) -> Iterator[np.ndarray]:
    """(rows, labels, squares; nodes; bins) of the leaves with a ``place``."""
    total = np.zeros((3, nodes, sum(sizes)))
    for codes, y, _ in blocks:
        node = place[route(codes, walk)]
        mine = np.flatnonzero(node >= 0)
        total += histogram(codes[:, mine], node[mine], nodes, [None, y[mine], y[mine] ** 2], sizes)
    yield total


def _sign_counts(blocks, trees: list[tuple], walk: tuple, place: np.ndarray, shapes: list[tuple], groups: list[tuple]) -> Iterator[np.ndarray]:
    """Rows of the leaves with a ``place`` whose residual is negative, or not, by bins of the groups' features: one after the other, (nodes, bins of each, 2)."""
    ends = np.cumsum([np.prod(s) for s in shapes])
    total = np.zeros(ends[-1], np.int64)
    for codes, y, score in _scored(blocks, trees):
        node = place[route(codes, walk)]
        sign = y - score >= 0
        if (node < 0).any():
            mine = np.flatnonzero(node >= 0)
            codes, sign, node = codes[:, mine], sign[mine], node[mine]
        for group, shape, end in zip(groups, shapes, ends):
            key = node
            for f, size in zip(group, shape[1:]):
                key = key * size + codes[f]
            size = int(np.prod(shape))
            total[end - size:end] += np.bincount(2 * key + sign, minlength=size)
    yield total.astype(np.uint32) if total.max(initial=0) < 1 << 32 else total


def _sums(counts: np.ndarray) -> np.ndarray:
    """Rows, sum and squares of signs from counts of the negative and the others."""
    rows = (counts[0] + counts[1]).astype(float)
    return np.stack([rows, (counts[1] - counts[0]).astype(float), rows])


def _side(counts: dict[tuple, np.ndarray], i: int, feature: int, cut: int, right: int, features: int) -> np.ndarray:
    """Sums by bin of all features for one side of node ``i``'s split, from the counts of pairs of bins."""
    parts = []
    for f in range(features):
        if f == feature:
            mine = counts[f,][:, i].copy()
            mine[:, slice(0, cut + 1) if right else slice(cut + 1, None)] = 0
        elif (min(f, feature), max(f, feature)) in counts:
            pair = counts[min(f, feature), max(f, feature)][:, i]
            pair = pair if feature < f else pair.swapaxes(1, 2)
            mine = pair[:, slice(cut + 1, None) if right else slice(0, cut + 1)].sum(axis=1)
        else:  # one bin holds all rows
            mine = counts[feature,][:, i, slice(cut + 1, None) if right else slice(0, cut + 1)].sum(axis=1)[:, None]
        parts.append(mine)
    return _sums(np.concatenate(parts, axis=1))


def _split_level(tree: Tree, places: list[int], sums: np.ndarray, sizes: list[int], depth: int, least: int) -> list[tuple]:
    """Splits the leaves ``places`` where their ``sums`` gain by it: (new leaf, index in ``places``, feature, cut, side) that can be split on."""
    whole = sums[:, :, :sizes[0]].sum(axis=2)
    feature, cut, gain, left = best_splits(sums, whole[2], sizes, least)
    below = []
    for i, place in enumerate(places):
        tree.sums[place] = tuple(whole[:, i].tolist())
        rows, total, squares = tree.sums[place]
        if feature[i] >= 0 and tree.level(place) < depth and squares - total ** 2 / rows > NOISE * squares:
            sides = tree.split(place, int(feature[i]), int(cut[i]), float(gain[i]), tuple(left[:, i].tolist()), tuple((whole - left)[:, i].tolist()))
            below += [(new, i, int(feature[i]), int(cut[i]), side) for side, new in enumerate(sides)]
    # The last level's sums are those of its parents' sides.
    return [b for b in below if tree.level(b[0]) < depth and tree.sums[b[0]][0] >= 2 * least]


def grow_boosted(spark: SparkSession, data: Binned, rounds: int, rate: float, depth: int, least: int, pair_cells: int = PAIR_CELLS) -> list[dict]:
    """The first tree is fitted to the labels, every other to the signs of what is left, and added ``rate`` times."""
    ensure_checkpoint_dir(spark)
    sizes, features = data.sizes, len(data.sizes)
    alone = [(f,) for f in range(features)]
    pairs = [(f, g) for f in range(features) for g in range(f + 1, features) if sizes[f] > 1 and sizes[g] > 1]
    cells = sum(sizes[f] * sizes[g] for f, g in pairs)
    state, found, kept = data.blocks.map(lambda b: (b[1], b[2], np.zeros(len(b[2])))), [], None
    late: list[tuple] = []  # trees that are not in the state's scores yet
    for number in range(rounds):
        tree = Tree(float(data.rows))
        open_ = [0]
        while open_:
            walk, level = tree.walk(), tree.level(open_[0])
            place = np.full(len(walk[0]), -1)
            place[open_] = np.arange(len(open_))
            if not number:
                sums = _added(state.mapPartitions(partial(_label_sums, walk=walk, place=place, nodes=len(open_), sizes=sizes)))
                below = _split_level(tree, open_, sums, sizes, depth, least)
            else:
                both = level + 1 < depth and len(open_) * cells <= pair_cells
                groups = alone + pairs if both else alone
                shapes = [(len(open_), *(sizes[f] for f in g), 2) for g in groups]
                total = _added(state.mapPartitions(partial(_sign_counts, trees=late, walk=walk, place=place, shapes=shapes, groups=groups)))
                split = np.split(total, np.cumsum([np.prod(s) for s in shapes])[:-1])
                counts = {g: np.moveaxis(part.reshape(s), -1, 0) for g, s, part in zip(groups, shapes, split)}
                below = _split_level(tree, open_, _sums(np.concatenate([counts[g] for g in alone], axis=2)), sizes, depth, least)
                if both and below:
                    sums = np.stack([_side(counts, i, f, cut, side, features) for _, i, f, cut, side in below], axis=1)
                    below = _split_level(tree, [b[0] for b in below], sums, sizes, depth, least)
            open_ = [b[0] for b in below]
        found.append(tree.table())
        late.append((tree.walk(), (rate if number else 1.0) * np.array([s[1] / s[0] for s in tree.sums])))
        if len(late) == STATE_ROUNDS and number + 1 < rounds:
            before, state = state, state.mapPartitions(partial(_scored, trees=late)).persist(StorageLevel.MEMORY_AND_DISK)
            late = []
            written = (number + 1) % CHECKPOINT_ROUNDS == 0
            if written:
                state.checkpoint()
            state.count()
            before.unpersist()
            if written:
                if kept:
                    delete_path(spark, kept)
                kept = state.getCheckpointFile()
    state.unpersist()
    if kept:
        delete_path(spark, kept)
    return found


# ----------------------------------------------------------------------------- MLlib's model

def pruned(tree: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Nodes in order of their ids, without the children of nodes whose two children are leaves of one value; adds ``child``, -1 of a leaf."""
    order = np.argsort(tree["id"])
    ids, feature, sums = tree["id"][order], tree["feature"][order].copy(), tree["sums"][order]
    value = sums[:, 1] / sums[:, 0]
    child = np.where(feature >= 0, np.searchsorted(ids, 2 * ids), -1)
    keep = np.ones(len(ids), bool)
    ends = np.searchsorted(ids, 1 << np.arange(int(ids[-1]).bit_length() + 1))
    for low, high in zip(ends[-2::-1], ends[:0:-1]):  # a level at a time, from the last
        inner = low + np.flatnonzero(feature[low:high] >= 0)
        a = child[inner]
        same = inner[(feature[a] < 0) & (feature[a + 1] < 0) & (value[a] == value[a + 1])]
        keep[child[same]] = keep[child[same] + 1] = False
        feature[same] = -1
    places = np.cumsum(keep) - 1
    inner = (feature >= 0)[keep]
    return {"feature": feature[keep], "cut": tree["cut"][order][keep], "gain": np.where(inner, tree["gain"][order][keep], -1.0),
            "sums": sums[keep], "child": np.where(inner, places[child[keep]], -1)}


def _node_frame(spark: SparkSession, trees: list[dict], cuts: list[np.ndarray]) -> DataFrame:
    """Rows of MLlib's saved trees."""
    parts = []
    for number, tree in enumerate(map(pruned, trees)):
        n, s, q = tree["sums"].T
        f, child = tree["feature"], tree["child"]
        at = [float(cuts[a][b]) if a >= 0 else 0.0 for a, b in zip(f.tolist(), tree["cut"].tolist())]
        parts.append(pd.DataFrame({"treeID": number, "id": np.arange(len(f)), "prediction": s / n, "impurity": np.maximum(q / n - (s / n) ** 2, 0.0), "n": n,
                                   "s": s, "q": q, "gain": tree["gain"], "left": child, "right": np.where(child >= 0, child + 1, -1), "f": f, "at": at}))
    flat = spark.createDataFrame(pa.Table.from_pandas(pd.concat(parts), preserve_index=False))
    split = F.struct(F.col("f").cast("int").alias("featureIndex"),
                     F.when(F.col("f") >= 0, F.array("at")).otherwise(F.array().cast("array<double>")).alias("leftCategoriesOrThreshold"),
                     F.lit(-1).alias("numCategories"))
    return flat.select(F.col("treeID").cast("int").alias("treeID"), F.struct(
        F.col("id").cast("int").alias("id"), "prediction", "impurity", F.array("n", "s", "q").alias("impurityStats"), F.col("n").cast("long").alias("rawCount"), "gain",
        F.col("left").cast("int").alias("leftChild"), F.col("right").cast("int").alias("rightChild"), split.alias("split")).alias("nodeData"))


def _as_model(spark: SparkSession, estimator, kind, trees: list[dict], weights: list[float], cuts: list[np.ndarray]):
    """The trees as MLlib's model of the estimator: written in the form that MLlib saves, and loaded."""
    path = scratch_path(spark, "trees")
    given, default = ({p.name: v for p, v in m.items()} for m in (estimator._paramMap, estimator._defaultParamMap))

    def meta(name: str, uid: str, of: tuple[str, ...] | None = None, **more) -> str:
        maps = {"paramMap": given, "defaultParamMap": default}
        return json.dumps({"class": f"org.apache.spark.ml.regression.{name}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid}
                          | {m: {k: v for k, v in values.items() if not of or k in of} for m, values in maps.items()} | more)

    def one_line(text: str, to: str) -> None:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(to)

    own = ("featuresCol", "labelCol", "predictionCol", "maxDepth", "maxBins", "minInstancesPerNode", "minInfoGain", "seed")
    one_line(meta(kind.__name__, estimator.uid, numFeatures=len(cuts), numTrees=len(trees)), f"{path}/metadata")
    each = [(i, meta("DecisionTreeRegressionModel", f"dtr_{uuid.uuid4().hex[:12]}", own), w) for i, w in enumerate(weights)]
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    _node_frame(spark, trees, cuts).write.parquet(f"{path}/data")
    model = kind.load(path)
    delete_path(spark, path)
    return model


def fit(spark: SparkSession, data: Binned, estimator):
    """The model of a forest or an L1 boosting estimator that looks at all features of every node."""
    if estimator.getFeatureSubsetStrategy() != "all" or estimator.getSubsamplingRate() != 1.0 or estimator.getImpurity() != "variance":
        raise ValueError("trees are grown on all features, whole samples and by variance")
    depth, least = estimator.getMaxDepth(), estimator.getMinInstancesPerNode()
    if isinstance(estimator, RandomForestRegressor):
        trees = grow_forest(data, estimator.getNumTrees(), depth, least, estimator.getSeed())
        return _as_model(spark, estimator, RandomForestRegressionModel, trees, [1.0] * len(trees), data.cuts)
    if not isinstance(estimator, GBTRegressor) or estimator.getLossType() != "absolute":
        raise TypeError("only forests and boosted trees with absolute loss are grown here")
    trees = grow_boosted(spark, data, estimator.getMaxIter(), estimator.getStepSize(), depth, least)
    weights = [1.0] + [estimator.getStepSize()] * (len(trees) - 1)
    return _as_model(spark, estimator, GBTRegressionModel, trees, weights, data.cuts)
