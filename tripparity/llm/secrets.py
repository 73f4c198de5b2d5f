"""Secret scan: fixed patterns, and sliding-window entropy over candidate strings.

A candidate is a maximal run of token characters. For every character class a window of the class's
width slides over the candidate's stretches of that class; symbol counts and the sum of c log c are
updated by the one symbol that enters and the one that leaves, so a window's Shannon entropy costs
constant time. Windows at or above the class's threshold join to spans; spans that touch a pattern's
match, or that are on the allow list themselves or with the rest of their segment, are left out.
Segments lie between slashes and equals signs; checksums and plain words that are on the allow list
are taken out first, so that they neither join nor excuse what stands beside them.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripparity.llm.common import read_table, ready

KINDS = ("assign", "access", "hex", "entropy")
_KEYWORD_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


ASSIGN = re.compile("(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24


@dataclass(frozen=True)
class CharClass:
    """Windows of ``width`` characters with at least ``bits`` of entropy and ``groups`` of the groups
    lower case, upper case, digits, of which each must hold ``least`` characters."""

    name: str
    pattern: str
    width: int
    bits: float
    groups: int = 2
    least: int = 2


CLASSES = (
    CharClass("hex", r"[0-9a-fA-F]+", 20, 3.0),
    CharClass("upper", r"[A-Z0-9]+", 16, 3.25),
    CharClass("lower", r"[a-z0-9]+", 16, 3.25),
    CharClass("mixed", r"[A-Za-z0-9]+", 16, 3.5, groups=3, least=1),
    CharClass("base64", r"[A-Za-z0-9+/_=-]+", 20, 3.75, groups=3, least=1),
)

# Candidates that look random but are not secret.
ALLOW = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUID
    r"(?i).*(example|sample|dummy|placeholder|changeme|xxxx).*",
    r"([A-Za-z][a-z]*[/_=+-]+)+[A-Za-z][a-z]*",  # words joined by separators
    # joined words, perhaps numbered: a piece ends only where its lower case does, so a failing run costs one pass
    r"[A-Z]?[a-z]{3,}+([A-Z][a-z]{3,}+)++[0-9]{0,4}",
    r"[A-Z]?[a-z]{6,}+[0-9]{0,4}",
    r"[0-9_/+=-]+",  # numbers
    r"([A-Z]?[a-z]+[0-9]+|[0-9]+[A-Z]?[a-z]+)",  # one word and one number
    r"(?i)(sha(1|224|256|384|512)|md5)[-=_].*",  # checksums
)

# A checksum has at most its hexadecimal length, so that what follows it is judged for itself.
_DIGEST = "|".join(f"{name}[-=_][A-Za-z0-9+/]{{1,{bits // 4}}}+={{0,2}}" for name, bits in (
    ("md5", 128), ("sha1", 160), ("sha224", 224), ("sha256", 256), ("sha384", 384), ("sha512", 512)))
SEGMENT = re.compile(f"(?<![^/=])(?P<digest>{_DIGEST})|[^/=]+", re.IGNORECASE)
_PLAIN_WORD = "(?:[A-Z]?[a-z]++(?:[A-Z][a-z]{2,}+)*+|[A-Z]++)"
PLAIN = re.compile(f"{_PLAIN_WORD}(?:[_-]++{_PLAIN_WORD})*+[_-]*+[0-9]{{0,4}}")
_GROUPS = (re.compile("[a-z]"), re.compile("[A-Z]"), re.compile("[0-9]"))


def window_spans(text: str, cls: CharClass) -> list[tuple[int, int]]:
    """Spans covered by windows of ``text`` at or above the class's entropy, by incremental counts."""
    w = cls.width
    if len(text) < w:
        return []
    weigh = [0.0] + [c * log2(c) for c in range(1, w + 1)]
    group = [0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 for c in text]
    counts: dict[str, int] = {}
    of_group, total = [0, 0, 0, 0], 0.0
    most, spans = (log2(w) - cls.bits) * w + 1e-9, []
    for i, c in enumerate(text):
        if i >= w:
            old = text[i - w]
            n = counts[old]
            total += weigh[n - 1] - weigh[n]
            counts[old] = n - 1
            of_group[group[i - w]] -= 1
        n = counts.get(c, 0)
        total += weigh[n + 1] - weigh[n]
        counts[c] = n + 1
        of_group[group[i]] += 1
        if i >= w - 1 and total <= most and sum(g >= cls.least for g in of_group[:3]) >= cls.groups:
            if spans and spans[-1][1] > i - w:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((i - w + 1, i + 1))
    return spans


class SecretScanner:
    def __init__(self, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW):
        self.classes = [(c, re.compile(c.pattern)) for c in classes]
        self.allow = re.compile("|".join(f"(?:{p})" for p in allow if not p.startswith("(?i)"))) if allow else None
        self.allow_any_case = [re.compile(p[4:], re.IGNORECASE) for p in allow if p.startswith("(?i)")]

    def allowed(self, candidate: str) -> bool:
        return bool(self.allow and self.allow.fullmatch(candidate)) or any(p.fullmatch(candidate) for p in self.allow_any_case)

    def windows(self, run: str) -> list[tuple[int, int]]:
        """Spans of the run by all classes, between its allowed words and checksums, without allowed ones."""
        segments = [(m.start(), m.end(), m["digest"] or PLAIN.fullmatch(m[0])) for m in SEGMENT.finditer(run)]
        cut = [(s, e) for s, e, alone in segments if alone and e - s >= 4 and self.allowed(run[s:e])]
        starts, ends = [s for s, _, _ in segments], [e for _, e, _ in segments]
        out, excused = [], {}  # a segment is looked at once, however many spans it holds
        for low, high in zip([0] + [e for _, e in cut], [s for s, _ in cut] + [len(run)]):
            spans = sorted((low + m.start() + s, low + m.start() + e) for cls, stretch in self.classes
                           for m in stretch.finditer(run[low:high]) for s, e in window_spans(m[0], cls))
            joined: list[list[int]] = []
            for s, e in spans:
                if joined and s <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], e)
                else:
                    joined.append([s, e])
            for s, e in joined:
                first = starts[max(bisect_right(starts, s) - 1, 0)]
                last = ends[min(bisect_left(ends, e), len(ends) - 1)]
                whole = max(min(first, s), low), min(max(last, e), high)
                if whole not in excused:
                    excused[whole] = self.allowed(run[slice(*whole)])
                if not excused[whole] and not self.allowed(run[s:e]):
                    out.append((s, e))
        return out

    def scan(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, number of the kind, end) of all spans, sorted; code points, end exclusive."""
        text = text or ""
        found: list[tuple[int, int, int]] = []
        low = text.lower()
        if any(hint in low for hint in _KEYWORD_HINTS):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
        runs = [(m.start(), m[0]) for m in CANDIDATE.finditer(text)]
        for at, run in runs:
            found += [(at + m.start(), 1, at + m.end()) for m in ACCESS.finditer(run) if m.end() - m.start() >= ACCESS_LENGTH]
            found += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(run) if m.end() - m.start() >= HEX_LENGTH]
        base = sorted((s, e) for s, _, e in found)
        for at, run in runs:
            if sum(bool(g.search(run)) for g in _GROUPS) >= 2:
                found += [(at + s, 3, at + e) for s, e in self.windows(run) if not any(at + s < y and x < at + e for x, y in base)]
        return sorted(found)


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: tuple[CharClass, ...] = CLASSES,
                 allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy for every row.

    A null text is empty (no spans, the digest of the empty string); texts are scanned whole
    whatever their length; repeated rows and null ids stay; an empty table gives an empty result;
    other columns are ignored.
    """
    ready(docs.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = SecretScanner(classes, allow)
        for part in parts:
            rows = []
            for doc_id, text in zip(part["doc_id"], part["text"]):
                spans = scanner.scan(text)
                count = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
                digest = hashlib.sha256(_listed([x for x in spans if x[1] < 3]).encode()).hexdigest()
                rows.append((doc_id, *count[:3], digest, _listed(spans), count[3]))
            out = pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long")


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document, default classes and allow list."""
    return scan_secrets(read_table(spark, sf_dir, "documents"))
