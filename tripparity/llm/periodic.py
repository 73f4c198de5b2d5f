"""Periodic runs of words, found online by a sparse diagonal DP, and texts with the runs collapsed.

A run is a stretch of words with smallest period q, at least ``repeats`` periods and ``least`` words
long, that no neighbouring word extends. On the diagonal of lag q it is a chain of matches between
words q apart. The words are read from left to right; at each word the lags of its earlier occurrences
add one to the match lengths of their diagonals, a diagonal without a match ends there, and if it is
long enough its run is emitted at once.

Which earlier occurrences count keeps the work at n log n for every text. A run of lag d holds at
least 2d matches in a row (16 for the shortest lags), so for lags from 2^j up to 2^(j+1) a word counts
together with the 2^(j+1) - 1 words after it. Occurrences of such a stretch within half its length
form one arithmetic progression: three or more of them are multiples of a period of a smaller class,
whose own lag finds the run, so at most two lags are followed at a time in each class.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tripparity.llm.common import WORD, read_table, ready

LEAST_WORDS = 24
REPEATS = 3
_WORDS = re.compile(WORD)
_FIRST = 16  # words of the shortest stretch, for lags below it
_RUN = ("start", "length", "period")
RESULT = StructType([StructField("n_words", LongType()), StructField("runs", ArrayType(StructType([StructField(c, LongType()) for c in _RUN]))),
                     StructField("collapsed", StringType())])
_ARROW = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in _RUN]))), ("collapsed", pa.string())])


def _stretches(ids: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, numbers): equal numbers mark equal stretches of 16, 32, ... words from a place on."""
    length, names = 1, ids
    while length < count:
        length *= 2
        names = names[:-(length // 2)] * (int(names.max(initial=0)) + 1) + names[length // 2:]
        distinct, names = np.unique(names, return_inverse=True)
        if len(distinct) == len(names):
            return  # nothing repeats, longer stretches neither
        if length >= _FIRST:
            yield length, names


def _earlier(names: np.ndarray, low: int, high: int) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(place, lags) of places with one or two earlier occurrences at lags low to high - 1; the nearest alone
    from lag 1 on, where a multiple of a smaller period always has that period's lag in the same class."""
    n = len(names)
    places = np.arange(n)
    order = np.argsort(names, kind="stable")
    keys = names[order] * (n + 1) + order
    base = names * (n + 1)
    first = np.searchsorted(keys, base + np.maximum(places - high + 1, 0))
    after = np.searchsorted(keys, base + np.maximum(places - low + 1, 0))
    found = after - first
    near = places - order[np.maximum(after - 1, 0)]
    far = places - order[np.minimum(first, n - 1)]
    if low == 1:
        found = np.minimum(found, 1)
    for t in np.flatnonzero((found == 1) | (found == 2)).tolist():
        yield t, (int(near[t]),) if found[t] == 1 else (int(near[t]), int(far[t]))


def find_runs(words: list[str], least: int = LEAST_WORDS, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period; needs repeats >= 3 and least >= 24."""
    if repeats < 3 or least < 24:
        raise ValueError("runs need at least three periods and 24 words")
    n = len(words)
    if n < least:
        return []
    numbers: dict[str, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    periods: dict[tuple[int, int], int] = {}  # (start, end): the smallest lag

    def emit(lag: int, matches: int, end: int) -> None:
        start = end - matches - lag
        if end - start < max(least, repeats * lag):
            return
        # A diagonal that was not followed all the way belongs to a smaller period.
        if (start and words[start - 1] == words[start - 1 + lag]) or (end < n and words[end] == words[end - lag]):
            return
        periods[start, end] = min(lag, periods.get((start, end), lag))

    for length, names in _stretches(ids, n):
        for low, high in ([(1, _FIRST // 2)] if length == _FIRST else []) + [(length // 2, length)]:
            if repeats * low > n:
                continue
            active: dict[int, int] = {}  # lag: matches so far
            last = -1
            for t, lags in _earlier(names, low, high):
                if t != last + 1:
                    for lag, matches in active.items():
                        emit(lag, matches, last + length)
                    active = {}
                going = {lag: active.pop(lag, length - 1) + 1 for lag in lags}
                for lag, matches in active.items():
                    emit(lag, matches, last + length)
                active, last = going, t
            for lag, matches in active.items():
                emit(lag, matches, last + length)
    return sorted(((s, e - s, q) for (s, e), q in periods.items()), key=lambda r: (r[0], r[2]))


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period:start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def with_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST_WORDS, repeats: int = REPEATS,
              into: str = "periodic") -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, runs (start, length, period) and collapsed text.

    Every row is judged on its own, so repeated rows, null ids and rows of any order stay as they are.
    A null or empty text has no words, no runs and an empty collapsed text; whole texts of any length
    are read; runs that end at the same words count once, with their smallest period; an empty table
    gives an empty result; a column of the name ``into`` is replaced, all others stay.
    """
    ready(docs.sparkSession)
    docs = docs.drop(into)
    schema = StructType([*docs.schema.fields, StructField(into, RESULT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(text_col).to_pylist():
                words = _WORDS.findall(text or "")
                runs = find_runs(words, least, repeats)
                rows.append({"n_words": len(words), "runs": [{"start": s, "length": n, "period": q} for s, n, q in runs],
                             "collapsed": " ".join(collapse(words, runs))})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _ARROW)], [*batch.schema.names, into])

    return docs.mapInArrow(run, schema)


def collapse_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each text that holds a run replaced by its collapsed form; other texts stay untouched."""
    found = with_runs(docs, text_col, into="__periodic")
    return found.withColumn(text_col, F.when(F.size("__periodic.runs") > 0, F.col("__periodic.collapsed"))
                            .otherwise(F.col(text_col))).drop("__periodic")


def tail_repeated(text: Column, doc_id: Column) -> Column:
    """The contract's texts: in one document of ten the words from a on repeat with period p."""
    hashed = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    group = F.floor(hashed / 10)

    def rebuilt(parts: Column) -> Column:
        n = F.size(parts).cast("long")
        a = group % F.greatest(n, F.lit(1))
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + group % 8))
        return F.transform(parts, lambda w, i: F.when(i < a, w).otherwise(
            F.element_at(parts, (F.lit(1) + a + (i - a) % p).cast("int"))))

    # One-element transform: the words are split once, not at every use.
    joined = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.array_join(rebuilt(w), " "))), 1)
    return F.when(hashed % 10 == 0, joined).otherwise(text)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents, tails of one in ten repeated; digests of the runs and of the collapsed texts.

    A null doc_id hashes as the empty text.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", tail_repeated(F.col("text"), F.col("doc_id")).alias("text"))
    found = with_runs(docs).select("doc_id", "periodic.*")
    # Greatest exact length / period first; the runs come by start, then period.
    best = F.expr("""array_sort(runs, (l, r) -> CASE
        WHEN l.length * r.period <> r.length * l.period THEN IF(l.length * r.period > r.length * l.period, -1, 1)
        WHEN l.start <> r.start THEN IF(l.start < r.start, -1, 1)
        ELSE IF(l.period < r.period, -1, IF(l.period > r.period, 1, 0)) END)""")
    found = found.select("doc_id", "n_words", "runs", "collapsed", F.get(best, F.lit(0)).alias("best"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(
        ",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
