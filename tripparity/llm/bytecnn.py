"""Document quality by a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it. In each chunk learned
filters slide over embedded bytes, each filter's largest response is kept, and a small dense layer
turns the pooled responses into a logit; the mean logit over a document's chunks is its probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripparity.llm.common import id_fold, read_table, ready

PAD = 256  # the index of "no byte" after the end of a short text
THRESHOLD = 0.3
FOLDS = 5


@dataclass(frozen=True)
class CnnConfig:
    """Shape and training parameters; ``sample_rows`` bounds the labelled documents that are collected, whole."""

    chunk: int = 512
    hop: int = 384
    width: int = 8
    stride: int = 4
    embed: int = 8
    filters: int = 32
    hidden: int = 16
    sample_rows: int = 4000
    steps: int = 2000
    batch: int = 32  # documents a step, all their chunks
    rate: float = 4e-3
    seed: int = 7
    block: int = 256  # chunks worked on at once


@dataclass
class ByteCnn:
    config: CnnConfig
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    constant: float | None = None  # the probability given without any labelled row

    def start(self) -> None:
        c, rng = self.config, np.random.default_rng(self.config.seed)
        size = c.width * c.embed
        self.weights = {
            "bytes": rng.normal(0, 0.5, (PAD + 1, c.embed)), "filters": rng.normal(0, size ** -0.5, (size, c.filters)),
            "shift": np.zeros(c.filters), "dense": rng.normal(0, c.filters ** -0.5, (c.filters, c.hidden)),
            "dense_shift": np.zeros(c.hidden), "out": rng.normal(0, c.hidden ** -0.5, c.hidden), "out_shift": np.zeros(1)}
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}
        self.weights["bytes"][PAD] = 0

    def _windows(self, chunks: np.ndarray) -> np.ndarray:
        c, w = self.config, self.weights
        rows = w["bytes"][chunks].reshape(len(chunks), -1)
        at = np.lib.stride_tricks.sliding_window_view(rows, c.width * c.embed, axis=1)
        return at[:, ::c.stride * c.embed]

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows, largest responses (chunks x filters) and where they are."""
        windows = np.ascontiguousarray(self._windows(chunks))
        n, places, size = windows.shape
        responses = (windows.reshape(-1, size) @ self.weights["filters"]).reshape(n, places, -1)
        where = responses.argmax(axis=1)
        top = np.take_along_axis(responses, where[:, None, :], axis=1)[:, 0, :] + self.weights["shift"]
        return windows, top, where

    def logits(self, chunks: np.ndarray) -> np.ndarray:
        """One logit per chunk (rows of ``chunk`` byte values, padded with ``PAD``)."""
        w, c = self.weights, self.config
        windows = np.ascontiguousarray(self._windows(chunks))
        n, places, size = windows.shape
        top = (windows.reshape(-1, size) @ w["filters"]).reshape(n, places, -1).max(axis=1) + w["shift"]
        return np.tanh(np.tanh(top) @ w["dense"] + w["dense_shift"]) @ w["out"] + w["out_shift"][0]

    def fit(self, chunks: np.ndarray, labels: np.ndarray, owners: np.ndarray | None = None) -> ByteCnn:
        """Adam on the logistic loss of the documents' mean logits, as in scoring; both classes weigh the same.

        ``owners`` gives each chunk's document (ascending numbers into ``labels``); without it every chunk is one.
        """
        c = self.config
        self.start()
        rng = np.random.default_rng(c.seed + 1)
        labels = labels.astype(np.float32)
        share = labels.mean()
        if share in (0.0, 1.0):
            self.constant = float(0.99 * share + 0.005)
            return self
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        ends = np.cumsum(np.bincount(np.arange(len(chunks)) if owners is None else owners, minlength=len(labels)))
        starts = np.append(0, ends[:-1])
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        while step < c.steps:
            order = rng.permutation(len(labels))
            for lo in range(0, len(order), c.batch):
                docs = order[lo:lo + c.batch]
                at = np.concatenate([np.arange(starts[d], ends[d]) for d in docs])
                grads = self._gradients(chunks[at], labels[docs], weight[docs], np.repeat(np.arange(len(docs)), ends[docs] - starts[docs]))
                step += 1
                rate = c.rate * max(1 - step / (c.steps + 1), 0.0) * (1 - 0.999 ** step) ** 0.5 / (1 - 0.9 ** step)
                for k, g in grads.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.weights[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
                self.weights["bytes"][PAD] = 0
        return self

    def _gradients(self, chunks: np.ndarray, labels: np.ndarray, weight: np.ndarray,
                   owners: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Gradients of a batch of documents, ``block`` chunks at a time: mean logits first, then back through each block."""
        owners = np.arange(len(chunks)) if owners is None else owners
        sizes = np.bincount(owners, minlength=len(labels))
        blocks = [slice(lo, lo + self.config.block) for lo in range(0, len(chunks), self.config.block)]
        held = self._forward(chunks[blocks[0]])
        z = np.concatenate([held[-1]] + [self.logits(chunks[at]) for at in blocks[1:]])
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owners, z, len(labels)) / sizes, -30, 30)))
        err = (((p - labels) * weight / len(labels)) / sizes)[owners].astype(z.dtype)
        total = self._backward(chunks[blocks[0]], held, err[blocks[0]])
        for at in blocks[1:]:
            for k, g in self._backward(chunks[at], self._forward(chunks[at]), err[at]).items():
                total[k] = total[k] + g
        return total

    def _forward(self, chunks: np.ndarray) -> tuple[np.ndarray, ...]:
        w = self.weights
        windows, top, where = self.pooled(chunks)
        a = np.tanh(top)
        b = np.tanh(a @ w["dense"] + w["dense_shift"])
        return windows, where, a, b, b @ w["out"] + w["out_shift"][0]

    def _backward(self, chunks: np.ndarray, held: tuple[np.ndarray, ...], err: np.ndarray) -> dict[str, np.ndarray]:
        c, w = self.config, self.weights
        windows, where, a, b, _ = held
        db = err[:, None] * w["out"] * (1 - b * b)
        da = db @ w["dense"].T * (1 - a * a)
        row = np.arange(len(chunks))[:, None]
        picked = windows[row, where]  # chunks x filters x window
        d_windows = da[:, :, None] * w["filters"].T[None]
        d_bytes = np.zeros_like(w["bytes"])
        places = where[:, :, None] * c.stride + np.arange(c.width)
        np.add.at(d_bytes, chunks[row[:, :, None], places].ravel(), d_windows.reshape(-1, c.embed))
        return {"out": b.T @ err, "out_shift": np.array([err.sum()], np.float32), "dense": a.T @ db,
                "dense_shift": db.sum(axis=0), "shift": da.sum(axis=0),
                "filters": np.einsum("nf,nfs->sf", da, picked, optimize=True), "bytes": d_bytes}

    def score(self, texts: Iterator[bytes | None]) -> Iterator[float]:
        """Probability of label 1 per text, reading every byte, ``block`` chunks at a time."""
        c = self.config
        if self.constant is not None:
            yield from (self.constant for _ in texts)
            return
        waiting: list[list] = []  # [chunks still to come, sum, chunks]
        block: list[np.ndarray] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if not held:
                return
            values = self.logits(np.concatenate(block))
            at = 0
            for doc in waiting:
                n = min(doc[0], len(values) - at)
                doc[1] += float(values[at:at + n].sum(dtype=np.float64))
                doc[0] -= n
                at += n
            block.clear()
            held = 0

        for text in texts:
            data = np.frombuffer(text or b"", np.uint8)
            starts = chunk_starts(len(data), c)
            waiting.append([len(starts), 0.0, len(starts)])
            for lo in range(0, len(starts), c.block):
                part = cut(data, starts[lo:lo + c.block], c)
                block.append(part)
                held += len(part)
                if held >= c.block:
                    flush()
                    done = 0
                    while done < len(waiting) and not waiting[done][0]:
                        yield _probability(waiting[done][1] / waiting[done][2])
                        done += 1
                    del waiting[:done]
        flush()
        for doc in waiting:
            yield _probability(doc[1] / doc[2])


def _probability(logit: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def chunk_starts(length: int, c: CnnConfig) -> np.ndarray:
    """Starts of the chunks of a text: every ``hop`` bytes, the last one ending where the text ends."""
    if length <= c.chunk:
        return np.zeros(1, np.int64)
    starts = np.arange(0, length - c.chunk, c.hop, dtype=np.int64)
    return np.append(starts, length - c.chunk)


def cut(data: np.ndarray, starts: np.ndarray, c: CnnConfig) -> np.ndarray:
    if len(data) < c.chunk:
        row = np.full((1, c.chunk), PAD, np.int64)
        row[0, :len(data)] = data
        return row
    return data[starts[:, None] + np.arange(c.chunk)].astype(np.int64)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                  config: CnnConfig) -> list:
    """(id, label, whole text) of at most ``sample_rows`` labelled documents outside the held-out fold, picked
    by a hash of the id. Ids are picked first; an id with several texts gives one of them, chosen in
    Spark before anything is collected."""
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")) \
        .agg(F.max(label_col).cast("int").alias("__label")).where(id_fold(F.col("__id"), FOLDS) != 0)
    spread = F.xxhash64("__id", F.lit(config.seed))
    # A uniform hash leaves about 1.3 times the rows wanted; the cut to sample_rows sorts only those.
    share = min(1.0, (1.3 * config.sample_rows + 50) / max(marks.count(), 1))
    picked = marks.withColumn("__order", spread).where(F.pmod("__order", F.lit(1 << 30)) < int(share * (1 << 30))) \
        .orderBy("__order", "__id").limit(config.sample_rows).select("__id", "__label")
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    found = rows.join(F.broadcast(picked), "__id").groupBy("__id", "__label") \
        .agg(F.min_by("__text", F.struct(F.xxhash64("__text"), F.length("__text"))).alias("text")).collect()
    return sorted(found, key=lambda r: r["__id"])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality", config: CnnConfig = CnnConfig()) -> ByteCnn:
    rows = training_rows(docs, labels, id_col, text_col, label_col, config)
    model = ByteCnn(config)
    if not rows:
        model.constant = 0.5
        return model
    parts = []
    for r in rows:
        data = np.frombuffer(r["text"].encode(), np.uint8)
        parts.append(cut(data, chunk_starts(len(data), config), config).astype(np.uint16))
    owners = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    return model.fit(np.concatenate(parts), np.array([r["__label"] for r in rows]), owners)


def quality_score(text: Column, model: ByteCnn) -> Column:
    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(list(model.score(iter(part))), dtype="float64")

    return run(text.cast("binary"))


def score_quality(docs: DataFrame, model: ByteCnn, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Only the text enters a score. Null and empty texts are scored as one chunk without bytes; very
    long texts chunk by chunk; repeated rows stay; an empty table gives an empty result; a null id
    counts as the empty text in the fold; other columns are ignored.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), quality_score(F.col(text_col), model).alias("score"))
    return rows.select("doc_id", (id_fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score",
                       (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: ByteCnn, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches ``threshold``, with all their columns and no others."""
    ready(docs.sparkSession)
    inner = {c: f"__in_{i}" for i, c in enumerate(docs.columns)}
    scored = docs.withColumn("__score", quality_score(F.col(text_col), model)).withColumnsRenamed(inner)
    return scored.where(F.col("__score") >= threshold).select([F.col(v).alias(k) for k, v in inner.items()])


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Contract query: fitted on ``labels.quality`` outside the held-out fold, all documents scored."""
    docs = read_table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, read_table(spark, sf_dir, "labels")))
