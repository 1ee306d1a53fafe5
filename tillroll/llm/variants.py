"""Spelling variant grouping by reduced alphabets.

Letters are hashed to ``SYMBOLS`` symbols.  Words within one edit have reduced
forms within one edit, so every word's full one-edit neighbourhood over the
few symbols (itself, all replacements, deletions and insertions: 17 L + 9 keys
for L letters, made by numpy from prefix and suffix values) is joined with the
reduced vocabulary; the words that meet are compared as they are.  A bitmap of
the reduced vocabulary (fixed size, broadcast) drops neighbours that no word
has before the shuffle.  A neighbourhood has a key once and a word one reduced
form, so a pair meets once from each side and no pair is lost.

The counting, the joins, the comparison and the grouping are Spark's; Spark
takes a neighbourhood for one row, so no join is left to broadcast.  Roots
come by pointer jumping over the forms: a form has twice the count of its
word, so a chain has at most 63 words and settles in few rounds.

Defined cases: null and empty texts have no words; a null ``doc_id`` counts as
an empty one in the hash; repeated rows count as often as they occur; ties
between forms go to the smallest word in code-point order; very long texts and
words are handled whole (a task holds ``_KEYS`` keys or one word's
neighbourhood at a time); an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.collocations import BITS, bitmap
from tillroll.llm.common import map_rows, saved
from tillroll.plans.joins import by_shuffle

MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2  # a form has this many times the word's count
SYMBOLS = 8
EDITED = 97  # of so many runs of a document one loses a letter
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_FLUSH = 200_000  # words of a task's counter before they are sent
_KEYS = 2_000_000
_STEP = np.uint64(SYMBOLS + 1)


def _words_of(doc_id, text: str) -> Counter:
    """Runs of a text after the contract's edits."""
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only
    out: Counter = Counter()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(_RUN.findall(low)).items():
        h = zlib.crc32(run.encode(), start)
        if h % EDITED == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
        if len(run) >= MIN_LENGTH:
            out[run] += n
    return out


def vocabulary(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of all words of ``docs`` (doc_id, text) with ``min_count``."""

    def run(batches):
        seen: Counter = Counter()

        def send():
            got = {"word": list(seen), "n": list(seen.values())}
            seen.clear()
            return got

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if text:
                    seen.update(_words_of(doc, text))
                    if len(seen) > _FLUSH:
                        yield send()
        yield send()

    counts = map_rows(docs.select("doc_id", "text"), "word string, n long", run)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _symbols(words: list[str]) -> np.ndarray:
    """Words of one length as rows of symbols, 1 to ``SYMBOLS``."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1).astype(np.uint64)
    return ((points * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(SYMBOLS) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _STEP, dtype=np.uint64), dtype=np.uint64)])


def reduced_keys(words: list[str]) -> np.ndarray:
    """The reduced forms of words of one length as numbers to base 9 (exact up
    to 20 letters, modulo 2^64 beyond)."""
    r = _symbols(words)
    return (r * _powers(r.shape[1])[: r.shape[1]][::-1]).sum(axis=1, dtype=np.uint64)


def neighbourhoods(words: list[str]) -> np.ndarray:
    """Keys of all reduced forms within one edit, a row a word (with repeats)."""
    r = _symbols(words)
    m, n = r.shape
    p = _powers(n + 1)
    weight = p[:n][::-1]  # of each place
    zero = np.zeros((m, 1), dtype=np.uint64)
    terms = r * weight
    tail = np.concatenate([np.cumsum(terms[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1], zero], axis=1)  # value of the places from i on
    whole = tail[:, :1]
    head = whole - tail  # value of the places before i, in place
    out = [whole]
    for s in range(SYMBOLS):
        s = np.uint64(s + 1)
        out.append(whole + (s - r) * weight)  # replaced (once by itself)
        out.append(head * _STEP + s * p[: n + 1][::-1] + tail)  # inserted before i
    # deleted at i: what stands before moves down by one place
    before = np.zeros((m, n), dtype=np.uint64)
    for i in range(1, n):
        before[:, i] = before[:, i - 1] * _STEP + r[:, i - 1]
    out.append(before * weight + tail[:, 1:])
    return np.concatenate(out, axis=1)


def _by_length(batches):
    """Lists (words, counts) of one length, of bounded neighbourhoods."""
    for b in batches:
        groups: dict[int, tuple[list, list]] = {}
        for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
            words, counts = groups.setdefault(len(w), ([], []))
            words.append(w)
            counts.append(n)
            if len(words) * 17 * len(w) >= _KEYS:
                yield groups.pop(len(w))
        yield from groups.values()


def _bit(keys: np.ndarray) -> np.ndarray:
    """Places in the bitmap."""
    return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(38)).astype(np.int64) % BITS


def reduced(words: DataFrame) -> DataFrame:
    """(key, bit, other, other_n): the reduced vocabulary."""

    def run(batches):
        for w, n in _by_length(batches):
            keys = reduced_keys(w)
            yield {"key": keys.view(np.int64), "bit": _bit(keys), "other": w, "other_n": n}

    return map_rows(words, "key long, bit long, other string, other_n long", run)


def reduced_neighbours(words: DataFrame, bits) -> DataFrame:
    """(key, word): the words' neighbourhoods where ``bits``, a broadcast
    bitmap, has a bit; a key once a word."""

    def run(batches):
        for w, _ in _by_length(batches):
            keys = np.sort(neighbourhoods(w), axis=1)
            at = _bit(keys)
            keep = (bits.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            keep[:, 1:] &= keys[:, 1:] != keys[:, :-1]
            which, place = np.nonzero(keep)
            yield {"key": keys[which, place].view(np.int64), "word": [w[i] for i in which.tolist()]}

    return map_rows(words, "key long, word string", run)


def near_words(words: DataFrame) -> DataFrame:
    """(word, other, other_n): all pairs of ``words`` (word, n) one edit apart,
    from both sides."""
    vocab = saved(reduced(words), "reduced-words")
    bits = words.sparkSession.sparkContext.broadcast(bitmap(vocab, F.col("bit")))
    met = reduced_neighbours(words, bits).join(by_shuffle(vocab.drop("bit")), "key")
    return met.where(F.levenshtein("word", "other", 1) == 1).drop("key")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) by pointer jumping over ``forms`` (word, form)."""
    now = saved(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = saved(now.join(by_shuffle(ahead), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if step.where("moved").isEmpty():
            return step.drop("moved")
        now = step.drop("moved")


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``words`` (word, n) with form, root, n_near and form_n."""
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    best_n = -F.col("best.less")
    is_form = best_n >= ratio * F.col("n")
    joined = words.join(by_shuffle(near), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, best_n).alias("form_n")
    )
    joined = saved(joined, "spelling-forms")
    found = joined.join(by_shuffle(roots(joined.where("form is not null"))), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_variants(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per word."""
    return group_variants(saved(vocabulary(docs.select("doc_id", "text")), "spelling-words"))


# CRC-32 is linear: the value of a byte is the sum (xor) of its bits' values,
# which are fixed values of the checksum.
ORACLE_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents
),
distinct_runs AS (SELECT doc_id, run, count(*) AS times FROM runs GROUP BY ALL),
octets AS (
  SELECT run, times, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS b
  FROM distinct_runs
),
hashed AS (
  SELECT run, times, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, b::BIGINT[]), lambda s, c: xor(s >> 8,
    xor(xor(xor((xor(s, c) & 1) * 1996959894, ((xor(s, c) >> 1) & 1) * 3993919788), xor(((xor(s, c) >> 2) & 1) * 124634137, ((xor(s, c) >> 3) & 1) * 249268274)),
        xor(xor(((xor(s, c) >> 4) & 1) * 498536548, ((xor(s, c) >> 5) & 1) * 997073096), xor(((xor(s, c) >> 6) & 1) * 1994146192, ((xor(s, c) >> 7) & 1) * 3988292384)))))) AS h
  FROM octets
),
edited AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, times FROM hashed
),
words AS (SELECT word, sum(times)::BIGINT AS n FROM edited WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
holes AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z FROM places),
shorter AS (SELECT DISTINCT word, n, a || z AS other FROM holes),
near AS (
  SELECT x.word, y.word AS other, y.n AS other_n FROM holes x JOIN holes y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION ALL SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON w.word = s.other
  UNION ALL SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON w.word = s.other
),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS most FROM near GROUP BY word),
forms AS (SELECT near.word, min(other) AS form, any_value(most) AS form_n FROM near JOIN best ON near.word = best.word AND other_n = most JOIN words ON words.word = near.word WHERE most >= 2 * n GROUP BY near.word),
chain AS (
  SELECT word, word AS root, 0 AS step FROM words
  UNION ALL SELECT chain.word, forms.form, step + 1 FROM chain JOIN forms ON forms.word = chain.root
),
last AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
SELECT words.word, form, root, n, coalesce(n_near, 0) AS n_near, form_n
FROM words JOIN last USING (word) LEFT JOIN best USING (word) LEFT JOIN forms USING (word)
"""
