"""Packing token sequences by a configuration linear program.

Texts become tokens and one end token; longer ones are cut into pieces of the capacity. The number of
pieces of each length (at most ``capacity`` numbers, whatever the corpus) is all that reaches the
driver. There the configuration program "least number of sequences whose contents cover every length"
is solved by multiplicative weights: lengths still short of pieces weigh more, a knapsack dynamic
program prices the fullest contents under these weights, and contents close to the best price are
added. The fractional solution is rounded down and what remains goes best-fit into the gaps and new
sequences, group by group of equal contents. On the cluster every piece is numbered among the pieces
of its length and looks its place up in the plan.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripparity.llm.common import materialize, read_table, ready

CAPACITY = 4096
END_ID = 1
SMALL = 16  # pieces up to capacity / SMALL fill gaps
TOKENIZER = "word_bpe_49k.json"
CACHE_WORDS = 400_000
# Characters up to Latin Extended-A but the dotted capital I have one-to-one lower-case forms, and
# a text of them is its own composed form.
_LOWERS = re.compile("[\x00-\u012f\u0131-\u017f]*")
# Words of Latin-1 without control characters, capitals and "<" pass the normalizer unchanged.
_LATIN = re.compile("[!-;=-@\\[-~\u00a1-\u00bf\u00d7\u00df-\u00ff]*")
# The tokenizer's groups of characters (fixed by its file).
_GROUPS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
# Byte-level letters: printable bytes stand for themselves, the others for characters from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

# ----------------------------------------------------------------------------- tokens


class WordTokenizer:
    """Token ids of whole texts, remembering the ids of words.

    The tokenizer drops white space and never joins characters across it, so a text's ids are those
    of its space- and newline-separated parts in turn. Texts within Latin letters are lower-cased
    first, as the tokenizer would; their words need no normalizer, fall into the tokenizer's groups
    (letters, a digit, other marks) and each new group goes to the tokenizer's model. Other words go to
    the tokenizer whole. Words move from an old to a new generation as they are met again; about two
    times ``cache_words`` are held.
    """

    def __init__(self, tokenizer_json: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        self.cache_words = cache_words
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        probe = "it's größe, 12 =() \u00b5\u00ad"
        self.by_group = b"".join(map(self._group, _GROUPS.findall(probe))) == self._whole(probe)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _group(self, group: str) -> bytes:
        if not group.isascii():
            group = group.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(group)]).tobytes()

    def _learn(self, words: Iterable[str]) -> None:
        known, older = self.known, self.older
        for w in words:
            if w in older:
                known[w] = older[w]
            elif not self.by_group or not _LATIN.fullmatch(w):
                known[w] = self._whole(w)
            elif w.isalpha():
                known[w] = self._group(w)
            else:
                groups = _GROUPS.findall(w)
                for g in groups:
                    if g not in known:
                        known[g] = older[g] if g in older else self._group(g)
                known[w] = b"".join(map(known.__getitem__, groups))

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.known) > self.cache_words:
            self.known, self.older = {"": b""}, self.known
        split, new = [], set()
        for text in texts:
            text = text or ""
            if _LOWERS.fullmatch(text) and "<|" not in text:
                text = text.lower()
            split.append(text.replace("\n", " ").split(" "))
            new.update(split[-1])
        self._learn(new.difference(self.known))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


_TOKENIZERS: dict[int, WordTokenizer] = {}


def _tokenizer(tokenizer_json: str) -> WordTokenizer:
    key = hash(tokenizer_json)
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = WordTokenizer(tokenizer_json)
    return _TOKENIZERS[key]


def tokenizer_file(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None,
                 capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32 (and ids).

    A null text is empty and gives one piece that holds the end token alone; repeated rows give
    pieces each; an empty table gives none; other columns are ignored. The tokenizer file is read
    on the driver and sent along (its size is that of the vocabulary).
    """
    spark = ready(docs.sparkSession)
    with open(tokenizer_path or tokenizer_file(), encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    end = int(end_id).to_bytes(4, "little")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = _tokenizer(shared.value)
        for part in parts:
            for lo in range(0, len(part), 256):
                rows = part.iloc[lo:lo + 256]
                out = []
                for doc_id, data in zip(rows["doc_id"], tokenizer.ids(rows["text"].tolist())):
                    data += end
                    for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                        ids = data[at:at + 4 * capacity]
                        row = (doc_id, piece, at // 4, len(ids) // 4, zlib.crc32(ids))
                        out.append((*row, np.frombuffer(ids, "<u4").astype(np.int32)) if with_ids else row)
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                frame = pd.DataFrame(out, columns=names[:6 if with_ids else 5])
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, schema)


# ----------------------------------------------------------------------------- the plan


@dataclass
class Config:
    """``count`` sequences of equal contents: (length, times) pairs in order."""

    count: int
    contents: list[tuple[int, int]]

    def used(self) -> int:
        return sum(n * k for n, k in self.contents)


def price(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: best worth for every capacity and the length index taken there (-1: none)."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fit = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        values = best[c - lengths[:fit[c]]] + worth[:fit[c]]
        j = int(values.argmax())
        if values[j] > best[c - 1]:
            best[c], pick[c] = values[j], j
        else:
            best[c] = best[c - 1]
    return best, pick


def _contents(first: int, lengths: np.ndarray, pick: np.ndarray, capacity: int) -> dict[int, int]:
    """The contents priced best among those that hold length number ``first``."""
    found = {first: 1}
    c = capacity - int(lengths[first])
    while c > 0:
        j = int(pick[c])
        if j < 0:
            c -= 1
        else:
            found[j] = found.get(j, 0) + 1
            c -= int(lengths[j])
    return found


def grouped(histogram: dict[int, int], groups: int) -> list[dict[int, int]]:
    """Linear grouping: lengths in order, cut into groups of about equal count."""
    out: list[dict[int, int]] = []
    target = sum(histogram.values()) / groups
    held = 0.0
    for n in sorted(histogram):
        if not out or held >= target:
            out.append({})
            held = 0.0
        out[-1][n] = histogram[n]
        held += histogram[n]
    return out


def solve_program(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 100, near: float = 0.01,
                  step: float = 0.5, sharp: float = 4.0) -> list[tuple[float, dict[int, int]]]:
    """Fractional configurations that cover ``counts``: (amount, {length number: times}).

    Multiplicative weights from the prior length / capacity (the volume bound's prices): a length's
    price falls by exp(-sharp) with each time its count is covered, and is nothing once it is. After
    each pricing the contents within ``near`` of the best price are taken, those of the least covered
    lengths first, until one of their lengths is ``step`` ahead of the least covered length. If no
    contents qualify, the least covered length gets its best ones whatever their price. No length is
    covered more than once; what ``rounds`` pricings leave short is left to the rounding.
    """
    chosen: dict[tuple, float] = {}
    cover = np.zeros(len(lengths))
    for _ in range(rounds):
        open_ = cover < 1 - 1e-9
        if not open_.any():
            break
        least = cover[open_].min()
        goal = min(1.0, least + step)
        worth = np.where(open_, lengths / capacity * np.exp(-sharp * (cover - least)), 0.0)
        best, pick = price(lengths, worth, capacity)
        value = np.where(open_, best[capacity - lengths] + worth, 0.0)
        enough = (1 - near) * value.max()
        order = np.lexsort((-value, cover))
        order = order[open_[order]]
        for j in order:
            if value[j] < enough and j != order[0]:
                continue
            found = _contents(int(j), lengths, pick, capacity)
            at, times = np.array(list(found)), np.array(list(found.values()), float)
            amount = (((goal if value[j] >= enough else 1.0) - cover[at]) * counts[at] / times).min()
            if amount > 1e-9:
                key = tuple(sorted(found.items()))
                chosen[key] = chosen.get(key, 0.0) + amount
                cover[at] += amount * times / counts[at]
    return [(amount, dict(key)) for key, amount in chosen.items()]


def best_fit(rest: dict[int, int], open_: list[Config], capacity: int) -> list[Config]:
    """Best-fit decreasing on groups of equal sequences: every length in turn fills the tightest gaps
    that hold it, then new sequences. The work depends on the number of lengths and groups only."""
    full: list[Config] = []
    gaps: dict[int, list[Config]] = {}
    sizes: list[int] = []

    def put(config: Config) -> None:
        gap = capacity - config.used()
        if gap <= 0:
            full.append(config)
            return
        if gap not in gaps:
            gaps[gap] = []
            insort(sizes, gap)
        gaps[gap].append(config)

    for config in open_:
        put(config)
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                config = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    sizes.pop(at)
            else:
                gap, config = capacity, Config(-(-n // (capacity // length)), [])
            times = min(gap // length, n)
            filled = min(config.count, n // times)
            if filled < config.count:
                put(Config(config.count - filled, config.contents))
            put(Config(filled, [*config.contents, (length, times)]))
            n -= filled * times
    return full + [c for group in gaps.values() for c in group]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, small: int = SMALL, **options) -> list[Config]:
    """Sequences for a length histogram, as groups of equal contents; every piece has its place.

    The program covers the pieces longer than capacity / ``small``; its whole amounts are taken, and
    all other pieces go best-fit into their gaps and new sequences.
    """
    rest = {n: k for n, k in histogram.items() if k}
    lengths = np.array(sorted(n for n in rest if n * small > capacity))
    whole: list[Config] = []
    if len(lengths):
        counts = np.array([rest[n] for n in lengths.tolist()], float)
        for amount, found in sorted(solve_program(lengths, counts, capacity, **options), key=lambda x: -x[0]):
            contents = [(int(lengths[j]), k) for j, k in found.items()]
            times = min([int(amount + 1e-6), *(rest[n] // k for n, k in contents)])
            if times:
                for n, k in contents:
                    rest[n] -= times * k
                whole.append(Config(times, sorted(contents, reverse=True)))
    return best_fit({n: k for n, k in rest.items() if k}, whole, capacity)


def places(configs: list[Config]) -> pd.DataFrame:
    """Per length, runs of places: the first rank, the sequence it starts in, pieces per sequence, offset."""
    rows, base = [], 0
    for config in configs:
        offset = 0
        for length, times in config.contents:
            rows.append((length, config.count * times, base, times, offset))
            offset += length * times
        base += config.count
    table = pd.DataFrame(rows, columns=["length", "places", "sequence", "times", "offset"], dtype="int64")
    table["first"] = table.groupby("length")["places"].cumsum() - table["places"]
    return table.sort_values(["length", "first"], kind="stable").reset_index(drop=True)


# ----------------------------------------------------------------------------- on the cluster


def _ranked(pieces: DataFrame, rows: int) -> DataFrame:
    """Numbers the pieces of each length from 0, a length's pieces spread over about sqrt(rows) buckets."""
    buckets = max(1, round(rows ** 0.5))
    keyed = pieces.withColumn("__bucket", F.pmod(F.xxhash64("__row"), F.lit(buckets)))
    sizes = keyed.groupBy("length", "__bucket").agg(F.count("*").alias("__size"))
    before = materialize(sizes.selectExpr(
        "length as __length", "__bucket as __b",
        "sum(__size) over (partition by length order by __bucket) - __size as __before"), "pack-before")
    ranked = keyed.join(before, (F.col("length") == F.col("__length")) & (F.col("__bucket") == F.col("__b")))
    number = F.expr("row_number() over (partition by length, __bucket order by __row)")
    return ranked.withColumn("__rank", F.col("__before") + number - 1).drop("__bucket", "__b", "__length", "__before")


def pack(pieces: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` column (1 to ``capacity``); keeps all columns."""
    ready(pieces.sparkSession)
    pieces = materialize(pieces.withColumn("__row", F.monotonically_increasing_id()), "pack-pieces")
    # At most `capacity` rows whatever the corpus.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = places(plan(histogram, capacity, **options))
    length, first, sequence, times, offset = (table[c].to_numpy() for c in ("length", "first", "sequence", "times", "offset"))
    start, key = np.searchsorted(length, np.arange(capacity + 2)), length * (1 << 42) + first

    @F.pandas_udf("sequence_id long, offset long")
    def place(n: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, rank = n.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(key, n * (1 << 42) + rank, side="right") - 1
        within = rank - first[at]
        return pd.DataFrame({"sequence_id": sequence[at] + within // times[at],
                             "offset": offset[at] + (within % times[at]) * n})

    placed = _ranked(pieces, sum(histogram.values())).withColumn("__place", place("length", "__rank"))
    return placed.select(*[c for c in pieces.columns if c != "__row"], "__place.sequence_id", "__place.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces with ids: sequence_id, ids."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None,
                   capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenizes, cuts and packs all documents; see ``token_pieces`` for nulls and repeated rows."""
    return pack(token_pieces(docs, id_col, text_col, tokenizer_path, capacity, end_id, with_ids), capacity)


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents in sequences of at most 4096 tokens."""
    return pack_documents(read_table(spark, sf_dir, "documents"))
