"""Language-model scoring with deleted interpolation.

Tokens are lower-cased words and one end per document.  The probability of a
token w after v (a start mark for the first) mixes maximum-likelihood
estimates of the bigram, the unigram and a uniform one:

    p(w | v) = l2[b] * c(v w) / c(v) + l1[b] * c(w) / N + l0[b] / (V + 1)

b is the bucket of the context's frequency (powers of two of c(v)).  The
weights of a bucket are learned by expectation-maximisation on held-out
counts: training documents of one fold (crc32 of the id mod 10 is 1) are
predicted from the counts of all others.  The final score uses the counts of
all training documents.  Counts of words and bigrams are exact, over the whole
corpus, whatever their number.

Defined cases: null or empty text is the end token alone; documents with a
null id are scored, not learned from; an unseen context leaves unigram and
uniform; without training documents the uniform probability is 1; repeated
rows count as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm import chunks as C
from tillroll.llm.common import LOWER, fold, map_rows

HELD, DEV, TRAIN = 0, 1, 2  # kinds of chunks
BUCKETS = 32
CELL = 2  # histogram cells for a factor of two
CELLS = 160
ROUNDS = 60
END = 0x6A09E667F3BCC909
START = 0xBB67AE8584CAA73B
RESULT = "doc_id long, kind int, n_tokens long, n_known long, base_score double, score double"
_A = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes) -> np.ndarray:
    """Names of the words of a text and of its end."""
    w = text.translate(LOWER).split()
    out = np.empty(len(w) + 1, dtype=np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, w), dtype=np.uint64, count=len(w))
    out[-1] = END
    return out


def _bigrams(t: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context and bigram names; ``first``: positions of first tokens."""
    v = np.empty_like(t)
    v[1:] = t[:-1]
    v[first] = START
    with np.errstate(over="ignore"):
        x = (v ^ (v >> np.uint64(31))) * _A + t
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xC2B2AE3D27D4EB4F)
        return v, x ^ (x >> np.uint64(32))


class _Read:
    """A chunk's tokens, and its distinct words (with the start) and bigrams."""

    def __init__(self, row: dict):
        self.docs = C.Docs(row)
        per = [tokens(t) for t in self.docs.texts()]
        self.n = np.array([len(p) for p in per], dtype=np.int64)
        t = np.concatenate(per)
        first = np.cumsum(self.n) - self.n
        v, b = _bigrams(t, first)
        self.words, self.at_word, self.c_word = np.unique(t, return_inverse=True, return_counts=True)
        self.pairs, self.at_pair, self.c_pair = np.unique(b, return_inverse=True, return_counts=True)
        self.at_context = np.searchsorted(self.words, v)  # of START: unused
        self.at_context[first] = -1

    def sets(self):
        yield 0, self.words, self.c_word
        yield 1, self.pairs, self.c_pair


def _ask(row: dict, bits: int):
    """Per part: number of keys, the chunk's kind, keys, counts."""
    r = _Read(row)
    for kind, keys, counts in r.sets():
        for part, at in C.pack_keys(keys, bits):
            head = np.array([at.stop - at.start, row["kind"]], dtype=np.int64).tobytes()
            yield kind << 32 | part, head + C.key_bytes(keys[at], bits) + C.squeeze(counts[at].astype(np.uint32).tobytes())


def _sums(asked: list, bits: int, part: int):
    """To each chunk, per key, the counts of all training documents and of the
    held-out fold; as chunk -1 the number of distinct trained words."""
    got = []
    for chunk, b in asked:
        n, kind = np.frombuffer(b[:16], dtype=np.int64).tolist()
        w = (8 - bits // 8) * n
        got.append((chunk, kind, C.keys_from(b[16 : 16 + w], bits), np.frombuffer(C.expand(b[16 + w :]), dtype=np.uint32)))
    keys, at = np.unique(np.concatenate([g[2] for g in got]), return_inverse=True)
    train, dev = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
    pos = 0
    for _, kind, k, c in got:
        i = at[pos : pos + len(k)]
        pos += len(k)
        if kind != HELD:
            train[i] += c  # distinct keys within a chunk
        if kind == DEV:
            dev[i] += c
    pos = 0
    for chunk, _, k, _ in got:
        i = at[pos : pos + len(k)]
        pos += len(k)
        yield chunk, C.squeeze(_columns(train[i]) + _columns(dev[i]))
    if part >> 32 == 0:
        yield -1, np.array([(train > 0).sum(), (train > dev).sum()], dtype=np.int64).tobytes()


def _columns(c: np.ndarray) -> bytes:
    """Numbers byte by byte (the high bytes are mostly 0 and compress away)."""
    return np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def _numbers(b: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(b, dtype=np.uint8).reshape(6, n).T
    return out.reshape(-1).view("<u8").astype(np.int64)


def _counts(r: _Read, parts: dict[int, bytes], bits: int) -> dict:
    """Training and held-out counts of a chunk's words and bigrams."""
    out = {}
    for kind, keys, _ in r.sets():
        train, dev = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        for part, at in C.pack_keys(keys, bits):
            b, n = C.expand(parts[kind << 32 | part]), at.stop - at.start
            train[at], dev[at] = _numbers(b[: 6 * n], n), _numbers(b[6 * n :], n)
        out[kind] = (train, dev)
    return out


def bucket(c: np.ndarray) -> np.ndarray:
    """Of a context's count: 0 for none, then by powers of two."""
    return np.where(c > 0, np.minimum(np.log2(np.maximum(c, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)


def _estimates(r: _Read, word: np.ndarray, pair: np.ndarray, n: int, starts: int):
    """Per token: bucket, bigram and unigram estimate."""
    c = np.where(r.at_context >= 0, word[np.maximum(np.minimum(r.at_context, len(word) - 1), 0)], starts)
    p2 = np.where(c > 0, pair[r.at_pair] / np.maximum(c, 1), 0.0)
    return bucket(c), p2, word[r.at_word] / max(n, 1)


def _cell(p: np.ndarray) -> np.ndarray:
    """Histogram cell of a probability; 0 for none."""
    return np.where(p > 0, np.clip((-np.log2(np.maximum(p, 1e-30)) * CELL).astype(np.int64), 0, CELLS - 2) + 1, 0)


def learn(histogram: np.ndarray, uniform: float) -> np.ndarray:
    """Weights [bucket, (bigram, unigram, uniform)] by expectation-maximisation
    from rows (bucket, cell of the bigram, cell of the unigram, tokens)."""
    weights = np.tile([0.6, 0.3, 0.1], (BUCKETS, 1))
    weights[0] = [0.0, 0.75, 0.25]
    if len(histogram):
        value = np.concatenate([[0.0], 2.0 ** (-(np.arange(CELLS - 1) + 0.5) / CELL)])
        b, n = histogram[:, 0], histogram[:, 3].astype(float)
        p = np.stack([value[histogram[:, 1]], value[histogram[:, 2]], np.full(len(b), uniform)], axis=1)
        for _ in range(ROUNDS):
            share = weights[b] * p
            share *= (n / share.sum(axis=1))[:, None]
            total = np.stack([np.bincount(b, weights=share[:, i], minlength=BUCKETS) for i in range(3)], axis=1)
            seen = total.sum(axis=1) > 0
            weights[seen] = (total[seen] + 0.01) / (total[seen] + 0.01).sum(axis=1, keepdims=True)
        weights[0, 0] = 0.0
        weights[0] /= weights[0].sum()
    return weights


def score(docs: DataFrame, chunk_bytes: int = C.CHUNK_BYTES) -> tuple[DataFrame, int]:
    """``RESULT`` for every row of ``docs`` (doc_id, text, kind: HELD, DEV or
    TRAIN), and the number of training tokens."""
    chunks = C.write_chunks(docs, chunk_bytes)
    bits = C.part_bits(chunks)
    answers = C.ask(chunks, lambda row: _ask(row, bits), lambda part, asked: _sums(asked, bits, part))

    sizes: dict[int, tuple[int, int]] = {}
    for r in token_counts(chunks).collect():  # a row for each kind
        sizes[r["kind"]] = (r["tokens"], r["docs"])
    known = [np.frombuffer(r["blob"], dtype=np.int64) for r in answers.where("chunk = -1").select("blob").collect()]  # two numbers a part
    v_all, v_rest = (sum(int(k[i]) for k in known) for i in (0, 1))
    n_all, d_all = (sum(sizes.get(k, (0, 0))[i] for k in (DEV, TRAIN)) for i in (0, 1))
    n_rest, d_rest = sizes.get(TRAIN, (0, 0))

    def held_out(row, parts):
        r = _Read(row)
        c = _counts(r, parts, bits)
        b, p2, p1 = _estimates(r, c[0][0] - c[0][1], c[1][0] - c[1][1], n_rest, d_rest)
        code, n = np.unique((b * CELLS + _cell(p2)) * CELLS + _cell(p1), return_counts=True)
        return {"b": code // CELLS**2, "i": code // CELLS % CELLS, "j": code % CELLS, "n": n}

    dev = chunks.where(F.col("kind") == DEV)
    few = answers.join(dev.select("chunk"), "chunk", "left_semi").select("part", "chunk", "blob")
    cells = C.meet(dev, few, "b long, i long, j long, n long", held_out).groupBy("b", "i", "j").agg(F.sum("n").alias("n"))
    histogram = np.array([tuple(r) for r in cells.orderBy("b", "i", "j").collect()], dtype=np.int64).reshape(-1, 4)
    weights = learn(histogram, 1 / (v_rest + 1))

    def final(row, parts):
        r = _Read(row)
        c = _counts(r, parts, bits)
        word, pair = c[0][0], c[1][0]
        b, p2, p1 = _estimates(r, word, pair, n_all, d_all)
        p = weights[b, 0] * p2 + weights[b, 1] * p1 + weights[b, 2] / (v_all + 1)
        base = np.log10((word + 0.1) / (n_all + 0.1 * (v_all + 1)))[r.at_word]
        at = np.cumsum(r.n) - r.n
        total = lambda x: np.add.reduceat(x, at)
        ids = [None if i == C.NULL_ID else i for i in r.docs.ids.tolist()]
        return {
            "doc_id": ids, "kind": [row["kind"]] * len(ids), "n_tokens": r.n, "n_known": total((word > 0)[r.at_word].astype(np.int64)),
            "base_score": total(base), "score": total(np.log10(p)),
        }

    return C.meet(chunks, answers, RESULT, final), n_all


def token_counts(chunks: DataFrame) -> DataFrame:
    """(kind, tokens, docs): tokens are words and ends."""

    def run(batches):
        for r in C.rows_of(batches):
            d = C.Docs(r)
            yield {"kind": [r["kind"]], "tokens": [len(d.ids) + sum(len(t.split()) for t in d.texts())], "docs": [len(d.ids)]}

    return map_rows(chunks, "kind int, tokens long, docs long", run).groupBy("kind").agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs"))


def op4_lm_score(docs: DataFrame) -> DataFrame:
    """Contract: learns outside crc32 fold 0 of 10, scores every document."""
    f = fold(F.col("doc_id"), 10)
    kind = F.when(f.isNull() | (f == 0), HELD).when(f == 1, DEV).otherwise(TRAIN)
    found, n = score(docs.select("doc_id", "text", kind.alias("kind")))
    held = F.coalesce(fold(F.col("doc_id"), 10) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
