"""Benchmark decontamination with one Aho-Corasick automaton.

Test questions and answers and documents are normalised alike (A-Z
lower-cased, words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` joined by one space).
Every window of ``WINDOW`` consecutive words of an item (a shorter item is one
window) goes into one automaton; a document is scanned once, and the word
ranges found are mapped back to code-point offsets of the original text.

The automaton holds at most ``max_block_bytes`` of benchmark text.  A larger
benchmark is split by item hash into blocks, each with its own automaton; the
documents then pass all blocks in one stage (no shuffle, bounded memory).

Defined cases: null or empty text has no words, no hits and is clean; an item
without words (or null text) has no window; an item with a null id still
contaminates but is not counted or listed; items with equal windows are all
listed; repeated document rows are judged one by one; other columns pass
through, and columns named like the results are replaced.
"""

from __future__ import annotations

import hashlib
import math
import re

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import WORD_BYTES, with_columns

WINDOW = 13
MAX_BLOCK_BYTES = 16 << 20
RESULT = (
    "n_words long, n_hit long, n_items long, items array<string>, "
    "spans array<struct<start:int,end:int>>, contaminated boolean"
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_automata: dict = {}  # of this worker process: digest -> automaton, the last one only


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def windows(items: list[tuple], window: int = WINDOW) -> dict[bytes, tuple[int, list[str]]]:
    """{normalised window: (its words, ids of the items it occurs in)}."""
    found: dict = {}
    for item_id, text in items:
        w = _words(text)
        k = min(len(w), window)
        for i in range(len(w) - k + 1 if k else 0):
            ids = found.setdefault(b" ".join(w[i : i + k]), (k, []))[1]
            if item_id is not None and str(item_id) not in ids:
                ids.append(str(item_id))
    return found


def _automaton(patterns: dict):
    key = hashlib.md5(b"\n".join(patterns)).digest()
    if key not in _automata:
        a = ahocorasick.Automaton()
        for p, (k, ids) in patterns.items():
            s = f" {p.decode('latin-1')} "
            a.add_word(s, (len(s), k, ids))
        if patterns:
            a.make_automaton()
        _automata.clear()
        _automata[key] = a
    return _automata[key]


def _scan(a, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, word ranges hit (from, to), ids of the items found."""
    w = _words(text)
    if not w or not len(a):
        return len(w), [], set()
    norm = b" " + b" ".join(w) + b" "
    ranges, ids, spaces = [], set(), None
    for end, (n, k, of) in a.iter(norm.decode("latin-1")):
        if spaces is None:
            spaces = np.cumsum(np.frombuffer(norm, dtype=np.uint8) == 0x20) - 1
        at = int(spaces[end - n + 1])
        ranges.append((at, at + k))
        ids.update(of)
    return len(w), ranges, ids


def _merged(ranges: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _offsets(text: str, ranges: list[list[int]]) -> list[dict]:
    """Word ranges as code-point offsets of the original text."""
    ends = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    return [{"start": ends[a][0], "end": ends[b - 1][1]} for a, b in ranges]


def _blocks(benchmark: DataFrame, max_bytes: int) -> list[dict]:
    """The windows of each block of items; a block's text is near ``max_bytes`` at most."""
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / max_bytes))
    block = F.pmod(F.xxhash64("text"), F.lit(n))
    return [windows([tuple(r) for r in items.where(block == i).collect()]) for i in range(n)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """``docs`` (``text``) with n_words, n_hit (words inside an occurrence of a
    window), n_items and items (ids with occurring windows, sorted as strings),
    spans (code points of the runs hit) and contaminated (n_hit > 0 and
    20 * n_hit >= n_words)."""
    sc = docs.sparkSession.sparkContext
    shared = [sc.broadcast(b) for b in _blocks(benchmark, max_block_bytes)]
    many = len(shared) > 1

    def judge(texts, ranges, ids):
        out = {k: [] for k in ("n_words", "n_hit", "n_items", "items", "spans", "contaminated")}
        a = _automaton(shared[-1].value)
        for text, before, known in zip(texts, ranges, ids):
            n, found, of = _scan(a, text)
            runs = _merged(found + [tuple(x) for x in before])
            hit, of = sum(b - a for a, b in runs), sorted(of | set(known))
            out["n_words"].append(n)
            out["n_hit"].append(hit)
            out["n_items"].append(len(of))
            out["items"].append(of)
            out["spans"].append(_offsets(text, runs) if runs else [])
            out["contaminated"].append(hit > 0 and 20 * hit >= n)
        return out

    def part(b):
        def run(texts, ranges, ids):
            a = _automaton(b.value)
            got = [_scan(a, t) for t in texts]
            return {
                "_ranges": [_merged(g[1] + [tuple(x) for x in r]) for g, r in zip(got, ranges)],
                "_ids": [sorted(g[2] | set(i)) for g, i in zip(got, ids)],
            }

        return run

    if not many:
        return with_columns(docs, ["text"], RESULT, lambda t: judge(t, [()] * len(t), [()] * len(t)))
    df = docs.withColumns({"_ranges": F.expr("cast(array() as array<array<int>>)"), "_ids": F.expr("cast(array() as array<string>)")})
    for b in shared[:-1]:
        df = with_columns(df, ["text", "_ranges", "_ids"], "_r array<array<int>>, _i array<string>", lambda *a, f=part(b): {"_r": (g := f(*a))["_ranges"], "_i": g["_ids"]})
        df = df.drop("_ranges", "_ids").withColumnsRenamed({"_r": "_ranges", "_i": "_ids"})
    return with_columns(df, ["text", "_ranges", "_ids"], RESULT, judge).drop("_ranges", "_ids")


def op6_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of the contract, one row per document."""
    found = decontaminate(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


ORACLE_SQL = """
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM (SELECT *, least(len(w), 13) AS k FROM items WHERE len(w) > 0))
), here AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS i
        FROM docs, (SELECT DISTINCT k FROM win))
), found AS (
  SELECT doc_id, i, here.k, item_id FROM here JOIN win ON here.k = win.k AND here.s = win.s
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id
), of AS (
  SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(of.n, 0) AS n_items,
       sha256(coalesce(of.ids, '')) AS items_sha256, coalesce(hit.n > 0 AND 20 * hit.n >= len(w), false) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN of USING (doc_id)
"""
