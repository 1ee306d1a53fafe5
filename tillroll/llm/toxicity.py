"""Toxic spans and document scores with a linear-chain conditional random field.

Tokens are runs of letters, lower-cased; a chain is a sentence (cut at ``.!?``
and line ends).  States are toxic and other; a token's features are the word
and its prefixes of 4 to 8 letters.  Training tokens get their labels from
document labels: a token of a toxic document is toxic if one of its features
is found far more often in toxic documents than chance explains.  Other
features carry no weight; a sentence without an active feature has no toxic
token.

Forward-backward marginals give spans (at or above ``SPAN_AT``) and, through a
logistic calibration of the largest marginal, the sum over distinct words and
the text's length, the document's score.

The fit reads at most ``MAX_TOXIC`` + ``MAX_CLEAN`` labelled documents (hash
order of the id), whole texts; scoring reads every document.

Defined cases: null or empty text has no token and gets the score of a
document without findings; a null label or id is not learned from; several
labels of one document count as toxic if one is; without toxic training rows
every score is the share 0; repeated rows are scored alike; other columns pass
through, and columns named like the results are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import is_fold, with_columns

MAX_TOXIC = 2000
MAX_CLEAN = 4000
MIN_SUPPORT = 4  # toxic documents with a feature before it counts
PURITY = 0.75  # least share of toxic documents among those with a feature, at equal class sizes
DEVIATION = 4.0  # standard deviations by which its toxic share exceeds chance
PREFIXES = (4, 5, 6, 7, 8)
STEPS, RATE, L2 = 80, 0.5, 1e-5
SPAN_AT = 0.5
RESULT = "score double, spans array<struct<start:int,end:int,p:double>>"
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")
_cache: dict = {}  # of this worker process: model key -> {word: emission}
_CACHE_SIZE = 300_000
_FLOOR = -12.0


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    link: np.ndarray = field(default_factory=lambda: np.array([_FLOOR, 0.0, 0.0, 0.0]))  # intercept and _evidence

    def emission(self, word: str) -> float | None:
        """Score of the toxic state for an active word; None for any other."""
        got = [self.weights[f] for f in features(word) if f in self.weights]
        return self.bias + sum(got) if got else None


def features(word: str) -> tuple[str, ...]:
    return ("=" + word, *(word[:n] for n in PREFIXES if n <= len(word)))


class _Emissions(dict):
    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word):
        if len(self) >= _CACHE_SIZE:
            self.clear()
        v = self[word] = self.model.emission(word)
        return v


def forward_backward(e: np.ndarray, n: np.ndarray, t: np.ndarray):
    """Marginals of the toxic state [s, i], expected transitions [s, 2, 2] and
    log Z [s] of chains with toxic-state scores ``e`` [s, i] and lengths ``n``."""
    s, size = e.shape
    a = np.zeros((size, 2, s))
    a[0, 1] = e[:, 0]
    for i in range(1, size):
        o = np.logaddexp(a[i - 1, 0] + t[0, 0], a[i - 1, 1] + t[1, 0])
        x = np.logaddexp(a[i - 1, 0] + t[0, 1], a[i - 1, 1] + t[1, 1]) + e[:, i]
        on = i < n
        a[i, 0], a[i, 1] = np.where(on, o, a[i - 1, 0]), np.where(on, x, a[i - 1, 1])
    z = np.logaddexp(a[-1, 0], a[-1, 1])
    p = np.zeros((s, size))
    pairs = np.zeros((s, 2, 2))
    bo, bx = np.zeros(s), np.zeros(s)
    for i in range(size - 1, -1, -1):
        on = i < n
        p[:, i] = np.where(on, np.exp(a[i, 1] + bx - z), 0.0)
        if not i:
            break
        to = (bo, bx + e[:, i])
        for u in (0, 1):
            for v in (0, 1):
                pairs[:, u, v] += np.where(on, np.exp(a[i - 1, u] + t[u, v] + to[v] - z), 0.0)
        o = np.logaddexp(t[0, 0] + to[0], t[0, 1] + to[1])
        x = np.logaddexp(t[1, 0] + to[0], t[1, 1] + to[1])
        bo, bx = np.where(on, o, bo), np.where(on, x, bx)
    return p, pairs, z


def _padded(chains: list) -> dict[int, list[int]]:
    """Positions of the chains by padded length (powers of two)."""
    by: dict[int, list[int]] = {}
    for k, c in enumerate(chains):
        by.setdefault(1 << max(0, len(c) - 1).bit_length(), []).append(k)
    return by


def marginals(model: Model, chains: list[list[float | None]]) -> list[np.ndarray]:
    """Marginals of chains of emissions (None: an inactive word)."""
    out: list = [None] * len(chains)
    for size, ks in _padded(chains).items():
        step = max(1, (1 << 20) // size)
        for at in range(0, len(ks), step):
            part = ks[at : at + step]
            e = np.full((len(part), size), model.bias)
            n = np.array([len(chains[k]) for k in part])
            for row, k in enumerate(part):
                e[row, : n[row]] = [model.bias if x is None else x for x in chains[k]]
            p, _, _ = forward_backward(e, n, model.trans)
            for row, k in enumerate(part):
                out[k] = p[row, : n[row]]
    return out


def _doc_chains(emit: _Emissions, text: str | None) -> tuple[int, list[list[tuple[int, int, float | None, str]]]]:
    """Number of words; sentences with an active word: (start, end, emission, word)."""
    words = _WORD.findall(text.lower()) if text else []
    if not any(v is not None for v in map(emit.__getitem__, words)):
        return len(words), []
    found = []
    for s in _SENTENCE.finditer(text):
        at = s.start()
        row = [(m.start() + at, m.end() + at, emit[w], w) for m in _WORD.finditer(s.group()) for w in (m.group().lower(),)]
        if any(w[2] is not None for w in row):
            found.append(row)
    return len(words), found


def _evidence(doc, ps: list[np.ndarray]) -> tuple[float, float, float]:
    """Largest marginal as a logit; log of 1 + the sum over distinct active
    words (a repeated word counts once); log of 1 + the number of words."""
    n, chains = doc
    best: dict[str, float] = {}
    for c, p in zip(chains, ps):
        for w, x in zip(c, p):
            if w[2] is not None:
                best[w[3]] = max(best.get(w[3], 0.0), float(x))
    size = float(np.log1p(n))
    if not best:
        return _FLOOR, 0.0, size
    top = min(max(best.values()), 1 - 1e-6)
    return max(_FLOOR, float(np.log(max(top, 1e-9) / (1 - top)))), float(np.log1p(sum(best.values()))), size


def _score(model: Model, evidence: tuple) -> float:
    x = model.link[0] + float(np.dot(model.link[1:], evidence))
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def _active(docs: list[tuple[str, int]]) -> dict[str, float]:
    """Features found far more often in toxic documents, with their share."""
    seen = Counter()
    for text, y in docs:
        if y:
            seen.update({f for w in set(_WORD.findall(text.lower())) for f in features(w)})
    toxic = {f: n for f, n in seen.items() if n >= MIN_SUPPORT}
    del seen
    clean = Counter()
    for text, y in docs:
        if not y:
            clean.update({f for w in set(_WORD.findall(text.lower())) for f in features(w)} & toxic.keys())
    n1 = max(1, sum(y for _, y in docs))
    n0 = max(1, len(docs) - n1)
    found = {}
    for f, n in toxic.items():
        share = (n / n1) / (n / n1 + (clean[f] + 0.5) / n0)
        expected = (n + clean[f]) * n1 / (n1 + n0)
        if share >= PURITY and n - expected > DEVIATION * (expected * n0 / (n1 + n0)) ** 0.5:
            found[f] = share
    return found


def train(docs: list[tuple[str, int]]) -> Model:
    """The field and its calibration from (text, toxic) of labelled documents."""
    model = Model()
    pure = _active(docs)
    if not pure:
        return model
    names = sorted(pure)
    at = {f: i for i, f in enumerate(names)}
    chains, labels, plain = [], [], Counter()  # plain: sentences without an active word, by length
    for text, y in docs:
        for s in _SENTENCE.findall(text):
            words = [[at[f] for f in features(w) if f in at] for w in _WORD.findall(s.lower())]
            if any(words):
                chains.append(words)
                labels.append([int(bool(y and w)) for w in words])
            elif words:
                plain[min(len(words), 256)] += 1
    theta = np.zeros(len(names) + 5)  # weights, bias, transitions
    theta[len(names)] = -2.0
    sets = []
    for size, ks in _padded(chains).items():
        n = np.array([len(chains[k]) for k in ks])
        cell = [(r, i, f) for r, k in enumerate(ks) for i, fs in enumerate(chains[k]) for f in fs]
        y = np.zeros((len(ks), size))
        for r, k in enumerate(ks):
            y[r, : n[r]] = labels[k]
        sets.append((n, np.ones(len(ks)), y, *(np.array(c, dtype=np.int64) for c in zip(*cell))))
    none = np.zeros(0, dtype=np.int64)
    for size, ns in _padded([range(k) for k in plain]).items():
        n = np.array([list(plain)[i] for i in ns])
        sets.append((n, np.array([plain[k] for k in n], dtype=float), np.zeros((len(n), size)), none, none, none))
    total = sum(w.sum() for _, w, *_ in sets)
    square = np.full_like(theta, 1e-8)
    for _ in range(STEPS):
        grad = -L2 * theta
        trans = theta[-4:].reshape(2, 2)
        for n, w, y, r, i, f in sets:
            mask = np.arange(y.shape[1]) < n[:, None]
            e = np.where(mask, theta[len(names)], 0.0)
            e += np.bincount(r * y.shape[1] + i, weights=theta[f], minlength=e.size).reshape(e.shape)
            p, pairs, _ = forward_backward(e, n, trans)
            miss = (y - p) * mask * w[:, None]
            grad[: len(names)] += np.bincount(f, weights=miss[r, i], minlength=len(names)) / total
            grad[len(names)] += miss.sum() / total
            for u in (0, 1):
                for v in (0, 1):
                    seen = ((y[:, :-1] == u) & (y[:, 1:] == v) & mask[:, 1:]).sum(axis=1)
                    grad[len(names) + 1 + 2 * u + v] += ((seen - pairs[:, u, v]) * w).sum() / total
        square += grad**2
        theta += RATE * grad / np.sqrt(square)
    model.weights = {f: float(theta[i]) for f, i in at.items()}
    model.bias, model.trans = float(theta[len(names)]), theta[-4:].reshape(2, 2).copy()
    emit = _Emissions(model)
    per = [_doc_chains(emit, t) for t, _ in docs]
    flat = marginals(model, [[w[2] for w in c] for _, d in per for c in d])
    x, k = [], 0
    for d in per:
        x.append((1.0, *_evidence(d, flat[k : k + len(d[1])])))
        k += len(d[1])
    model.link = _logistic(np.array(x), np.array([y for _, y in docs], dtype=float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression (Newton steps, small ridge)."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w += np.clip(np.linalg.solve(h, x.T @ (y - p) - 0.05 * w), -2, 2)
    return w


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """From ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic; the rows to
    learn from).  The sampled ids and texts, bounded by the two maxima, reach
    the driver."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    order = F.xxhash64(F.lit("toxic"), "doc_id")
    ids = []
    for y, n in ((1, max_toxic), (0, max_clean)):
        ids += [(r[0], y) for r in one.where(F.col("y") == y).orderBy(order, "doc_id").limit(n).collect()]
    if not any(y for _, y in ids):
        return Model()
    spark = docs.sparkSession
    some = F.broadcast(spark.createDataFrame(ids, "doc_id long, y int"))  # the bounded sample
    rows = docs.select("doc_id", "text").join(some, "doc_id").select("doc_id", "text", "y").collect()
    return train([(r["text"] or "", r["y"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"] or ""))])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (``text``) with score and the toxic spans (code points)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features of the bounded sample

    def run(texts):
        m = shared.value
        key = id(m)
        if key not in _cache:
            _cache.clear()
            _cache[key] = _Emissions(m)
        per = [_doc_chains(_cache[key], t) for t in texts]
        flat = marginals(m, [[w[2] for w in c] for _, d in per for c in d])
        out: dict = {"score": [], "spans": []}
        k = 0
        for d in per:
            ps = flat[k : k + len(d[1])]
            k += len(d[1])
            out["score"].append(_score(m, _evidence(d, ps)))
            out["spans"].append([{"start": w[0], "end": w[1], "p": float(x)} for c, p in zip(d[1], ps) for w, x in zip(c, p) if x >= SPAN_AT])
        return out

    return with_columns(docs, ["text"], RESULT, run)


def op1_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract: learns outside crc32 fold 1 of 3, scores every document."""
    held = is_fold(F.col("doc_id"), 3, 1)
    docs = docs.select("doc_id", "text")
    model = fit(docs, labels.select("doc_id", "toxic").where(~held))
    found = score(docs, model)
    return found.select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans")
    )
