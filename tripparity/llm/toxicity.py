"""Toxicity by a classifier chain: linear models predict the categories one after the other, each fed
with the probabilities of those before it. In training these are out-of-fold predictions, so a later
model sees the errors it will meet.

A model's own inputs pool the evidence of a document's words: every word's smoothed log-odds of the
category, of which the largest, the sums of the largest few, the mean, the smallest few and the number
of strong ones enter. A training document's log-odds come from the other folds, too, so that its
inputs look like those of a new document and one telling word counts the same in a long text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripparity.llm.common import id_fold, read_table, ready

FOLDS = 5
POOLED = 8
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class ChainConfig:
    """``sample_rows`` bounds the labelled documents; each gives at most ``buckets`` words.

    ``smoothing`` is how many documents of the average mixture are added to every word's counts; words
    of fewer than ``least_docs`` sampled documents carry no evidence either way. ``false_share``: the
    share of out-of-fold negatives of the last category that may score 0.5 or more.
    """

    buckets: int = 1 << 18
    sample_rows: int = 4000
    inner_folds: int = 5
    smoothing: float = 2.0
    least_docs: int = 3
    penalty: float = 1e-3
    steps: int = 40
    false_share: float = 0.005
    seed: int = 5


def word_buckets(text: str | None, buckets: int) -> np.ndarray:
    """Sorted distinct hash buckets of the text's words."""
    return np.unique(np.array([zlib.crc32(w.encode()) % buckets for w in set(_WORD.findall((text or "").lower()))], np.int64))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def word_odds(rows: list[np.ndarray], labels: np.ndarray, c: ChainConfig) -> np.ndarray:
    """Smoothed log-odds of the label by bucket: 0 where a word says nothing."""
    counts = np.zeros((2, c.buckets))
    for row, label in zip(rows, labels):
        counts[int(label)][row] += 1
    n, positive = max(len(rows), 1), float(np.sum(labels))
    sizes = np.maximum([n - positive, positive], 0.5)
    odds = np.diff(np.log((counts + c.smoothing * sizes[:, None] / n) / sizes[:, None]), axis=0)[0]
    odds[counts.sum(axis=0) < c.least_docs] = 0
    return odds


def pooled(odds: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The POOLED inputs of one document; zeros if it has no word."""
    if not len(row):
        return np.zeros(POOLED)
    v = np.sort(odds[row])[::-1]
    return np.array([v[0], v[:3].sum(), v[:5].sum(), v[:10].sum(), v.mean(), (v > 1).sum() / np.sqrt(len(v)), v[-5:].sum(), np.log1p(len(v))])


def fit_linear(inputs: np.ndarray, labels: np.ndarray, c: ChainConfig) -> np.ndarray:
    """Weights of the raw inputs, then the shift: logistic loss on standardised inputs, by Newton steps."""
    share = labels.mean() if len(labels) else 0.0
    if share in (0.0, 1.0):
        return np.append(np.zeros(inputs.shape[1]), 5.0 if share else -5.0)
    mean, spread = inputs.mean(axis=0), inputs.std(axis=0) + 1e-9
    x = np.column_stack([(inputs - mean) / spread, np.ones(len(inputs))])
    ridge = c.penalty * np.append(np.ones(inputs.shape[1]), 1e-6)
    w = np.zeros(x.shape[1])
    for _ in range(c.steps):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + np.diag(ridge), x.T @ (p - labels) / len(x) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    weights = w[:-1] / spread
    return np.append(weights, w[-1] - weights @ mean)


@dataclass
class ToxicityChain:
    config: ChainConfig
    categories: tuple[str, ...]
    odds: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)

    def fit(self, rows: list[np.ndarray], labels: np.ndarray) -> ToxicityChain:
        c, n = self.config, len(rows)
        fold = np.random.default_rng(c.seed).permutation(n) % c.inner_folds
        parts = [(np.flatnonzero(fold != k), np.flatnonzero(fold == k)) for k in range(c.inner_folds)]
        parts = [(inner, outer) for inner, outer in parts if len(inner) and len(outer)]
        before = np.zeros((n, 0))
        for j in range(len(self.categories)):
            y, own, outside = labels[:, j], np.zeros((n, POOLED)), np.zeros(n)
            for inner, outer in parts:
                odds = word_odds([rows[i] for i in inner], y[inner], c)
                own[outer] = [pooled(odds, rows[i]) for i in outer]
            inputs = np.column_stack([own, before])
            for inner, outer in parts:
                part = fit_linear(inputs[inner], y[inner], c)
                outside[outer] = inputs[outer] @ part[:-1] + part[-1]
            self.odds.append(word_odds(rows, y, c).astype(np.float32))
            weights = fit_linear(inputs, y, c)
            if j == len(self.categories) - 1 and (y == 0).any() and (y == 1).any():
                weights[-1] -= np.quantile(outside[y == 0], 1 - c.false_share)
            self.weights.append(weights)
            before = np.column_stack([before, _sigmoid(outside)])
        return self

    def predict(self, text: str | None) -> list[float]:
        """Probabilities in chain order; 0.5 each if the chain was never fitted."""
        if not self.weights:
            return [0.5] * len(self.categories)
        row, found = word_buckets(text, self.config.buckets), []
        for odds, weights in zip(self.odds, self.weights):
            found.append(float(_sigmoid(np.append(pooled(odds, row), found) @ weights[:-1] + weights[-1])))
        return found


def fit_chain(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("quality", "toxic"), id_col: str = "doc_id",
              text_col: str = "text", config: ChainConfig = ChainConfig()) -> ToxicityChain:
    """Fits on at most ``sample_rows`` labelled documents outside the held-out fold, picked by a hash.

    Of the rows that repeat an id the one with the least word buckets is taken, chosen in Spark.
    """
    spark = ready(docs.sparkSession)
    marks = labels.where(F.col(id_col).isNotNull()).dropna(subset=list(categories)).groupBy(F.col(id_col).alias("__id")) \
        .agg(*[F.max(c).cast("int").alias(f"__{i}") for i, c in enumerate(categories)]).where(id_fold(F.col("__id"), FOLDS) != 0)
    share = min(1.0, (1.3 * config.sample_rows + 50) / max(marks.count(), 1))
    picked = marks.withColumn("__order", F.xxhash64("__id", F.lit(config.seed))) \
        .where(F.pmod("__order", F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("__order", "__id").limit(config.sample_rows)

    @F.pandas_udf("array<int>")
    def buckets(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([word_buckets(t, config.buckets) for t in part])

    marked = [f"__{i}" for i in range(len(categories))]
    found = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where("__text is not null") \
        .join(F.broadcast(picked), "__id").select("__id", *marked, buckets("__text").alias("x"))
    rows = sorted(found.groupBy("__id", *marked).agg(F.min("x").alias("x")).collect(), key=lambda r: r["__id"])
    chain = ToxicityChain(config, categories)
    if not rows:
        return chain
    return chain.fit([np.array(r["x"], np.int64) for r in rows], np.array([[r[m] for m in marked] for r in rows], float))


def score_toxicity(docs: DataFrame, chain: ToxicityChain, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, p_<category> in chain order, predicted (the last category) for every row.

    Only the text enters a score; null texts have no words; whole texts are read; repeated rows and
    null ids stay; an empty table gives an empty result; other columns are ignored.
    """
    ready(docs.sparkSession)
    names = [f"p_{c}" for c in chain.categories]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([chain.predict(t) for t in part], columns=names, dtype="float64")

    found = docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("p"))
    return found.select("doc_id", (id_fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "p.*",
                        (F.col(f"p.{names[-1]}") >= threshold).cast("int").alias("predicted"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents, chain quality -> toxic fitted outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_chain(docs, read_table(spark, sf_dir, "labels")))
