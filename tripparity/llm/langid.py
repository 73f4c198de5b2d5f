"""Language identification in two steps: family first, then one-versus-one linear support vector
machines between the languages of the family. Features are hashed byte n-grams of the lower-cased
text; the machines are fitted by dual coordinate descent on a bounded sample of labelled rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripparity.llm.common import id_fold, read_table, ready

FOLDS, HELD_OUT = 4, 2
UNDETERMINED = "und"
# Fixed facts: languages by family. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indo-aryan": ("hi", "bn", "mr", "ur", "pa", "gu"),
}
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class LangConfig:
    """``sample_rows`` bounds the labelled rows taken of each language, ``max_languages`` the languages
    learned (those with the most labelled rows), so that a dirty column can't ask for endless machines."""

    orders: tuple[int, ...] = (1, 2, 3, 4)
    buckets: int = 1 << 13
    sample_rows: int = 400
    max_languages: int = 60
    epochs: int = 12
    cost: float = 4.0
    slope: float = 4.0  # of the logistic curve from margin to score
    block: int = 1 << 20
    seed: int = 11


def profile(text: str, c: LangConfig) -> np.ndarray:
    """Counts of hashed byte n-grams of the whole text, block by block."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    counts = np.zeros(c.buckets, np.int64)
    reach = max(c.orders) - 1
    for lo in range(0, max(len(data), 1), c.block):
        part = data[lo:lo + c.block + reach].astype(np.uint32)
        own = min(c.block, len(data) - lo)
        key = np.zeros(len(part), np.uint32)
        for n in range(1, reach + 2):
            key = key[:len(part) - n + 1] * np.uint32(0x01000193) ^ part[n - 1:]
            if n in c.orders and len(key):
                mixed = (key + np.uint32(n)) * np.uint32(0x9E3779B1)
                counts += np.bincount((mixed >> np.uint32(8)) % np.uint32(c.buckets), minlength=c.buckets) if own >= len(key) \
                    else np.bincount((mixed[:own] >> np.uint32(8)) % np.uint32(c.buckets), minlength=c.buckets)
    return counts


def unit(counts: np.ndarray) -> np.ndarray:
    """Square roots of the counts, scaled to length 1: long and short texts weigh alike."""
    values = np.sqrt(counts.astype(np.float64))
    norm = np.sqrt((values * values).sum())
    return values / norm if norm else values


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, c: LangConfig) -> np.ndarray:
    """Weights (the last one the shift) of a linear L2-loss machine, classes weighing alike."""
    rng = np.random.default_rng(c.seed)
    weights, alpha = np.zeros(c.buckets + 1), np.zeros(len(rows))
    share = (signs > 0).mean()
    bound = np.where(signs > 0, 0.5 / share, 0.5 / (1 - share)) * c.cost
    for _ in range(c.epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            grad = signs[i] * (weights[at] @ x + weights[-1]) - 1 + alpha[i] / (2 * bound[i])
            new = max(alpha[i] - grad / (2.0 + 1 / (2 * bound[i])), 0.0)
            if new != alpha[i]:
                move = (new - alpha[i]) * signs[i]
                weights[at] += move * x
                weights[-1] += move
                alpha[i] = new
    return weights


@dataclass
class LanguageModel:
    config: LangConfig
    family_of: dict[str, str] = field(default_factory=dict)
    machines: dict[tuple[str, str, str], np.ndarray] = field(default_factory=dict)  # ("" or family, first, second)

    def _decide(self, group: str, names: list[str], x: np.ndarray) -> tuple[str, float]:
        """Most won duels, then the larger sum of margins, then the smaller name; mean confidence."""
        if len(names) == 1:
            return names[0], 1.0
        wins, sums = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        sure: dict[str, list[float]] = {n: [] for n in names}
        for a, b in combinations(names, 2):
            w = self.machines[group, a, b]
            margin = float(w[:-1] @ x + w[-1])
            wins[a if margin > 0 else b] += 1
            sums[a] += margin
            sums[b] -= margin
            p = 1 / (1 + np.exp(-np.clip(self.config.slope * margin, -40, 40)))
            sure[a].append(p)
            sure[b].append(1 - p)
        best = min(names, key=lambda n: (-wins[n], -sums[n], n))
        return best, float(np.mean(sure[best]))

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.family_of or not _LETTER.search(text):
            return UNDETERMINED, 0.0
        x = unit(profile(text, self.config))
        family, p = self._decide("", sorted(set(self.family_of.values())), x)
        lang, q = self._decide(family, sorted(n for n, f in self.family_of.items() if f == family), x)
        return lang, min(max(p * q, 0.0), 1.0)


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  families: dict[str, tuple[str, ...]] = FAMILIES, config: LangConfig = LangConfig()) -> LanguageModel:
    """Fits on at most ``sample_rows`` different texts of each language outside the held-out fold, read whole.

    Rows are picked by a hash of id and text, and equal rows once, so an id that repeats over the table
    is one of many; only the profiles of the picked texts (at most ``buckets`` numbers each) reach the driver.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")) \
        .where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_fold(F.col("id"), FOLDS) != HELD_OUT))
    largest = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(config.max_languages)
    sizes = {r["lang"]: r["n"] for r in largest.collect()}
    model = LanguageModel(config)
    if not sizes:
        return model
    listed = {lang: family for family, langs in families.items() for lang in langs}
    model.family_of = {lang: listed.get(lang, f"={lang}") for lang in sizes}
    # A uniform hash keeps about 1.3 times the rows wanted before they are ranked.
    share = F.element_at(F.create_map(*[x for lang, n in sizes.items() for x in (
        F.lit(lang), F.lit(min(1.0, (1.3 * config.sample_rows + 50) / n)))]), F.col("lang"))
    rows = rows.where(F.col("lang").isin(list(sizes))).withColumn("order", F.xxhash64("id", "text", F.lit(config.seed)))
    near = rows.where(F.pmod(F.col("order"), F.lit(1 << 30)) / float(1 << 30) < share).select("lang", "order").distinct()
    picked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order"))) \
        .where(F.col("rank") <= config.sample_rows).select("lang", "order")

    @F.pandas_udf("at array<int>, x array<double>")
    def profiles(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            units = [unit(profile(t, config)) for t in part]
            yield pd.DataFrame({"at": [np.flatnonzero(u).astype(np.int32) for u in units], "x": [u[u > 0] for u in units]})

    # At most sample_rows * max_languages keys are sent to the rows.
    texts = rows.join(F.broadcast(picked), ["lang", "order"]).dropDuplicates(["lang", "order"])
    sample = texts.select("lang", "order", profiles("text").alias("p")).select("lang", "order", "p.at", "p.x").collect()
    points = [(r["lang"], (np.array(r["at"], np.int64), np.array(r["x"]))) for r in sorted(sample, key=lambda r: (r["lang"], r["order"]))]
    names = sorted(set(model.family_of.values()))
    for a, b in combinations(names, 2):
        model.machines["", a, b] = _duel(points, lambda lang: model.family_of[lang], a, b, config)
    for family in names:
        for a, b in combinations(sorted(n for n, f in model.family_of.items() if f == family), 2):
            model.machines[family, a, b] = _duel(points, lambda lang: lang, a, b, config)
    return model


def _duel(points: list, name_of, a: str, b: str, config: LangConfig) -> np.ndarray:
    rows = [(name_of(lang) == a, x) for lang, x in points if name_of(lang) in (a, b)]
    signs = np.array([1.0 if first else -1.0 for first, _ in rows])
    if not len(signs) or abs(signs.sum()) == len(signs):
        return np.append(np.zeros(config.buckets), float(np.sign(signs.sum())))
    return fit_machine([x for _, x in rows], signs, config)


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; only the text enters a prediction.

    Null texts and texts without a letter are ``und`` with score 0, as is every text if the model
    has seen no labelled row. Texts are read whole; repeated rows stay; a null id counts as the
    empty text in the fold; an empty table gives an empty result; other columns are ignored.
    """
    ready(docs.sparkSession)

    @F.pandas_udf("lang string, score double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([model.predict(t) for t in part], columns=["lang", "score"])

    found = docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("found"))
    return found.select("doc_id", (id_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
                        F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """Contract query: fitted outside the held-out fold, all documents predicted."""
    docs = read_table(spark, sf_dir, "documents")
    return identify_languages(docs, fit_languages(docs))
