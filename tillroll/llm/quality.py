"""Quality rules: distribution divergence.

Every document's histograms of character classes and of common words are
compared with its language's reference histograms by Jensen-Shannon distance
(base 2), the root of the divergence.  A document fails when either distance is
above its limit, which a guard widens for short texts, as they scatter more;
documents under ``MIN_WORDS`` words are not judged by the distances.

The references are counted over all rows.  Common words are those with at
least ``SHARE`` of a language's words: a first pass finds candidates by lossy
counting per task (a word with that share in the corpus has it in some task,
and lossy counting keeps it, whatever the order of the rows), a second pass
counts the candidates and the character classes exactly.  So the references do
not depend on how rows are dealt to tasks.

Defined cases: null or empty text has no words (``base_failed``); a null or
unlearned language is compared with every reference, the smallest distance
counts; no reference at all: only the base rules apply; repeated rows count
as often as they occur; other columns pass through, and columns named like
the results are replaced.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import LOWER, map_rows, with_columns

SHARE = 0.005
MIN_WORDS = 50
CHAR_LIMIT = 0.06
WORD_LIMIT = 0.06
GUARD = 3.0  # a distance's limit is the root of CHAR_LIMIT or WORD_LIMIT + GUARD / n_words
SYMBOLS = b"#*$%&|<>"
_PRUNE_AT = 200_000  # entries of a task's counter before rare ones are dropped (lossy counting)
_SPACES = b" \t\n\x0b\x0c\r"
_CLASS = np.zeros(256, dtype=np.int64)  # byte -> class
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (
        7 if _b >= 0x80 else 0 if _c.isupper() else 1 if _c.islower() else 2 if _c.isdigit()
        else 4 if _c == "\n" else 3 if _b in _SPACES else 5 if _b in SYMBOLS else 6
    )
N_CLASSES = 8
RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "char_divergence double, word_divergence double, base_failed boolean, kept boolean"
)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _classes(b: bytes) -> np.ndarray:
    return np.bincount(_CLASS, weights=np.bincount(np.frombuffer(b, dtype=np.uint8), minlength=256), minlength=N_CLASSES)


def _batches(batches):
    for b in batches:
        yield b.column("lang").to_pylist(), b.column("text").to_pylist()


class Lossy:
    """Lossy counting: words of at least ``share`` of all, counted in bounded
    space.  An entry is (occurrences since it came, the most it can have had
    before); it goes when both together are at most ``ERROR * share`` of the
    words so far, so a count is short by that much at most, whatever the order
    of the words."""

    ERROR = 0.25

    def __init__(self, share: float, prune_at: int):
        self.share, self.prune_at = share, prune_at
        self.total, self.counts, self.before, self.floor = 0, Counter(), {}, 0

    def add(self, words: list[bytes]) -> None:
        for at in range(0, len(words), self.prune_at):
            part = words[at : at + self.prune_at]
            self.total += len(part)
            self.counts.update(part)
            if len(self.counts) > self.prune_at:
                now = int(self.ERROR * self.share * self.total)
                kept = ((w, n, self.before.get(w, self.floor)) for w, n in self.counts.items())
                kept = [x for x in kept if x[1] + x[2] > now]
                self.counts = Counter({w: n for w, n, _ in kept})
                self.before, self.floor = {w: d for w, _, d in kept}, now

    def frequent(self) -> list[bytes]:
        """All words with ``share`` or more (and no word far below it)."""
        least = self.share * self.total
        return [w for w, n in self.counts.items() if n + self.before.get(w, self.floor) >= least]


def _candidates(batches):
    """Words that can have SHARE of this task's words, by language."""
    seen: dict[str, Lossy] = {}
    for langs, texts in _batches(batches):
        for lang, text in zip(langs, texts):
            if lang is not None and text:
                seen.setdefault(lang, Lossy(SHARE, _PRUNE_AT)).add(_bytes(text).translate(LOWER).split())
    got = [(k, w) for k, c in seen.items() for w in c.frequent()]
    yield {"lang": [k for k, _ in got], "word": [w for _, w in got]}


def references(docs: DataFrame) -> dict[str, tuple[np.ndarray, dict[bytes, int], np.ndarray]]:
    """{lang: (class counts, {word: position}, counts of the words and, last,
    of all others)} over all rows of ``docs`` (text, lang).  The candidates
    (at most 2 / SHARE a language and task, without repeats) and the sums
    reach the driver."""
    docs = docs.select("text", "lang")
    found = map_rows(docs, "lang string, word binary", _candidates).distinct().collect()
    words: dict = {}
    for lang, w in sorted((r["lang"], bytes(r["word"])) for r in found):
        words.setdefault(lang, {})[w] = len(words.get(lang, {}))
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def count(batches):
        sums: dict = {}
        for langs, texts in _batches(batches):
            for lang, text in zip(langs, texts):
                at = shared.value.get(lang)
                if at is None or not text:
                    continue
                s = sums.setdefault(lang, np.zeros(N_CLASSES + len(at) + 1, dtype=np.int64))
                b = _bytes(text)
                w = b.translate(LOWER).split()
                s[:N_CLASSES] += _classes(b).astype(np.int64)
                s[-1] += len(w)
                c = Counter(w)
                for k in c.keys() & at.keys():
                    s[N_CLASSES + at[k]] += c[k]
        rows = [(k, i, int(x)) for k, s in sums.items() for i, x in enumerate(s)]
        yield {"lang": [r[0] for r in rows], "i": [r[1] for r in rows], "n": [r[2] for r in rows]}

    total = map_rows(docs, "lang string, i int, n long", count).groupBy("lang", "i").agg(F.sum("n").alias("n")).collect()
    sums = {k: np.zeros(N_CLASSES + len(v) + 1, dtype=np.int64) for k, v in words.items()}
    for r in total:
        sums[r["lang"]][r["i"]] = r["n"]
    out = {}
    for lang, s in sums.items():
        n = s[-1]
        kept = [w for w, i in words[lang].items() if s[N_CLASSES + i] >= SHARE * n]
        counts = np.array([s[N_CLASSES + words[lang][w]] for w in kept], dtype=float)
        out[lang] = (s[:N_CLASSES].astype(float), {w: i for i, w in enumerate(kept)}, np.append(counts, n - counts.sum()))
    return out


def _entropy(p: np.ndarray) -> float:
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


def divergence(a: np.ndarray, b: np.ndarray) -> float:
    """Jensen-Shannon divergence (base 2) of two histograms; 0 if one is empty."""
    if not a.sum() or not b.sum():
        return 0.0
    a, b = a / a.sum(), b / b.sum()
    return max(0.0, _entropy((a + b) / 2) - (_entropy(a) + _entropy(b)) / 2)


def distance(a: np.ndarray, b: np.ndarray) -> float:
    """Jensen-Shannon distance: the root of the divergence."""
    return divergence(a, b) ** 0.5


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    t = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
    _, at, n = np.unique(t, return_inverse=True, return_counts=True)
    twice = n[at] > 1
    cover = np.zeros(len(words), dtype=bool)
    for k in range(3):
        cover[k : len(words) - 2 + k] |= twice
    return int(cover.sum())


def _measure(text: str | None, lang: str | None, refs: dict) -> tuple:
    b = _bytes(text)
    words = b.split()
    n = len(words)
    chars = len(text or "") - (len(b) - len(b.translate(None, _SPACES)))
    symbols = len(b) - len(b.translate(None, SYMBOLS))
    lines = [x for x in b.split(b"\n") if x.split()] if b"\n" in b else []
    dup = len(lines) - len(set(lines))
    rep = repeat_words(words)
    failed = n < 50 or 100 * rep > 50 * n
    dc = dw = None
    if n >= MIN_WORDS and refs:
        own, c = _classes(b), Counter(b.translate(LOWER).split())
        best = []
        for classes, at, counts in [refs[lang]] if lang in refs else refs.values():
            v = np.zeros(len(counts))
            for k in c.keys() & at.keys():
                v[at[k]] = c[k]
            v[-1] = n - v.sum()
            best.append((distance(own, classes), distance(v, counts)))
        dc, dw = min(best, key=max)
    guard = GUARD / max(n, 1)
    kept = not failed and (dc is None or (dc <= (CHAR_LIMIT + guard) ** 0.5 and dw <= (WORD_LIMIT + guard) ** 0.5))
    return n, chars, symbols, dup, rep, dc, dw, failed, kept


def judge(docs: DataFrame, refs: dict) -> DataFrame:
    """``docs`` (text, lang) with the measures, distances and verdict of ``RESULT``."""
    shared = docs.sparkSession.sparkContext.broadcast(refs)  # languages x (classes + words of SHARE or more)
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(texts, langs):
        got = [_measure(t, k, shared.value) for t, k in zip(texts, langs)]
        return {n: [g[i] for g in got] for i, n in enumerate(names)}

    return with_columns(docs, ["text", "lang"], RESULT, run)


def op3_quality(docs: DataFrame) -> DataFrame:
    """The contract's columns and both distances, one row per document."""
    docs = docs.select("doc_id", "text", "lang")
    return judge(docs, references(docs)).drop("text", "lang")
