"""Personal data: candidate spans, boosted trees, calibrated thresholds.

Only DataFrame functions run on the executors.  Per kind (email, ip, card,
phone) a base pattern gives the spans that always count; generators with high
recall propose further, overlapping candidates (among them parts of base
matches that failed their check, such as a phone number followed by an IP
address).  Boosted trees over format and context features score the
candidates; a candidate at or above its kind's threshold that overlaps no base
span is added.

The trees learn from all rows: a candidate equal to a valid base span is
positive, one inside a longer base match is left out, and so is one that the
base pattern cannot match by its form (a phone number without "+" that is
grouped, an address with "(at)" or "(dot)", a card of 13 digits): nothing says
that it is wrong.  Any other is negative, among them bare runs of digits as
phone numbers.  Features are those of a plain form (no country code, "@" and "."
for what is spelled out), so such candidates are scored by digits, grouping, cue
words and neighbours.  Features are small integers, so the training set is one grouped
count by feature vector; the ``MAX_VECTORS`` most frequent vectors (the bound
of the fit) reach the driver.  The threshold of a kind is the lowest score with
``PRECISION`` on the documents kept apart for calibration.

Defined cases: null or empty text has no span; a null id is like any other;
spans of different kinds may overlap and are all listed; added spans overlap
neither base spans nor each other (higher score first, then smaller start);
without positive examples nothing is added; repeated rows count as often as
they occur; other columns pass through, and columns named like the results
are replaced.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
MAX_VECTORS = 20_000
ROUNDS, DEPTH, RATE, L2 = 24, 3, 0.3, 1.0
PRECISION = 0.95
CONTEXT = 24  # characters before a candidate that are searched for cue words

# Base patterns.  Possessive quantifiers and the start guard (\G: where the
# last match ended) change no match but keep the search linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{2,63}+){1,4}+",
    "ip": rf"(?<![0-9]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){2}[\x20-][0-9]{1,7}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3}[\x20.-]?|(?<![0-9A-Za-z+]))(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])",
}
# What a text must contain before the patterns of a kind are searched.
_GATE = {"email": r"@|[(\[]at[)\]]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"[0-9]"}
_CUES = r"(?i)(?:mail|phone|tel|call|mobile|fax|card|visa|credit|server|host|addr|contact|\bip\b)"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
FEATURES = ("kind", "digits", "luhn", "bytes", "plus", "seps", "before", "after", "group", "cue", "length")
_SPAN = "array<struct<k:int,s:int,e:int,t:string,b:string,a:string>>"
ADDED = "array<struct<k:int,s:int,e:int,p:double>>"


def _luhn(d: Column) -> Column:
    """True if the digits pass the Luhn check (d: digits only, not empty)."""
    n = F.length(d)

    def add(total, i):
        v = F.substring(d, n - i, F.lit(1)).cast("int")
        twice = F.when(v > 4, v * 2 - 9).otherwise(v * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(v)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def _valid(kind: str, t: Column) -> Column:
    """The check of a base match."""
    n = F.length(_digits(t))
    if kind == "ip":
        return t.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), _luhn(_digits(t))).otherwise(False)
    return (n >= 10) & (n <= 15) if kind == "phone" else F.lit(True)


def _walk(m: Column, p: Column, k: int) -> Column:
    """Spans of kind k from its matches m and the pieces p around them."""

    def add(acc, j):
        start = acc["pos"] + F.length(F.get(p, j))
        end = start + F.length(F.get(m, j))
        one = F.struct(
            F.lit(k).alias("k"), start.alias("s"), end.alias("e"), F.get(m, j).alias("t"),
            F.right(F.get(p, j), F.lit(CONTEXT)).alias("b"), F.left(F.get(p, j + 1), F.lit(1)).alias("a"),
        )
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(one)).alias("out"))

    none = F.expr(f"cast(array() as {_SPAN})")
    zero = F.struct(F.lit(0).alias("pos"), none.alias("out"))
    spans = F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), zero, add, lambda a: a["out"])
    return F.when(F.size(m) > 0, spans).otherwise(none)


def _checked(kind: str, good: bool) -> Column:
    """Base matches of a kind that pass (good) or fail its check."""
    return F.filter(f"_b_{kind}", lambda c: _valid(kind, c["t"]) == F.lit(good))


def _with_spans(df: DataFrame, text: str, patterns: dict, prefix: str) -> DataFrame:
    """Columns <prefix><kind>: the matches of each pattern with code-point
    offsets.  A match's offset is the length of the pieces and matches before
    it, so the text is searched twice and never walked by position."""
    found, spans = {}, {}
    for i, (kind, rx) in enumerate(patterns.items()):
        gate = F.coalesce(F.col(text).rlike(_GATE[kind]), F.lit(False))
        found[f"_m{i}"] = F.when(gate, F.regexp_extract_all(text, F.lit(rx), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)"))
        found[f"_p{i}"] = F.when(gate, F.split(text, rx, -1)).otherwise(F.expr("cast(array() as array<string>)"))
    for i, kind in enumerate(patterns):
        spans[f"{prefix}{kind}"] = _walk(F.col(f"_m{i}"), F.col(f"_p{i}"), KINDS.index(kind))
    return df.withColumns(found).withColumns(spans).drop(*found)


def _class(c: Column) -> Column:
    """Of the character beside a candidate: none, space, letter, digit, other."""
    return (
        F.when(F.coalesce(c, F.lit("")) == "", 0).when(c.rlike(r"^\s$"), 1)
        .when(c.rlike(r"^\p{L}$"), 2).when(c.rlike("^[0-9]$"), 3).otherwise(4)
    )


_AT, _DOT = r"\x20?[(\[]at[)\]]\x20?", r"\x20?[(\[]dot[)\]]\x20?"


def _plain(c: Column) -> Column:
    """A candidate's text without what only its notation adds."""
    k = KINDS.index
    spelled = F.regexp_replace(F.regexp_replace(c["t"], _AT, "@"), _DOT, ".")
    return F.when(c["k"] == k("phone"), F.regexp_replace(c["t"], r"^\+[0-9]{1,3}?[\x20.-]?(?=(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}$)", "")).when(c["k"] == k("email"), spelled).otherwise(c["t"])


def _formless(c: Column) -> Column:
    """True if the base pattern of its kind cannot match a candidate by its form."""
    k = KINDS.index
    phone = ~c["t"].startswith("+") & c["t"].rlike("[^0-9]")
    return (
        F.when(c["k"] == k("phone"), phone).when(c["k"] == k("email"), c["t"].rlike(f"{_AT}|{_DOT}"))
        .when(c["k"] == k("card"), F.length(_digits(c["t"])) < 14).otherwise(False)
    )


def _features(c: Column) -> list[Column]:
    t = _plain(c)
    d = _digits(t)
    n = F.length(d)
    groups = F.transform(F.split(t, "[^0-9]+"), lambda g: F.length(g))
    return [
        c["k"],
        F.least(n, F.lit(20)),
        F.when(n.between(12, 19), _luhn(d).cast("int")).otherwise(0),
        t.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$").cast("int"),
        t.startswith("+").cast("int"),
        F.least(F.length(F.regexp_replace(t, "[^ ().-]", "")), F.lit(8)),
        _class(F.right(c["b"], F.lit(1))),
        _class(c["a"]),
        F.least(F.coalesce(F.array_max(groups), F.lit(0)), F.lit(20)),
        c["b"].rlike(_CUES).cast("int"),
        F.least(F.floor(F.length(t) / 4).cast("int"), F.lit(12)),
    ]


def _prepared(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``_base`` (valid base spans), ``_failed`` (base matches that
    failed) and ``_cand`` (candidates with their features ``f``)."""
    df = _with_spans(docs, text, BASE, "_b_")
    df = df.withColumns(
        {
            "_base": F.concat(*[_checked(k, True) for k in KINDS]),
            "_failed": F.concat(*[_checked(k, False) for k in KINDS]),
        }
    ).drop(*[f"_b_{k}" for k in KINDS])
    df = _with_spans(df, text, GENERATORS, "_g_")
    every = F.concat(*[F.col(f"_g_{k}") for k in KINDS])
    made = F.transform(every, lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e"), F.array(*_features(c)).alias("f"), _formless(c).alias("formless")))
    return df.withColumn("_cand", made).drop(*[f"_g_{k}" for k in KINDS])


def _tree(x, g, h, depth):
    """Regression tree: (feature, threshold, left, right) or a leaf value."""
    leaf = float(g.sum() / (h.sum() + L2)) * RATE
    if depth == 0 or len(g) < 2:
        return leaf
    score = g.sum() ** 2 / (h.sum() + L2)
    best = (1e-6, None, None)
    for j in range(x.shape[1]):
        for t in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= t
            gain = g[left].sum() ** 2 / (h[left].sum() + L2) + g[~left].sum() ** 2 / (h[~left].sum() + L2) - score
            if gain > best[0]:
                best = (gain, j, int(t))
    if best[1] is None:
        return leaf
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], _tree(x[left], g[left], h[left], depth - 1), _tree(x[~left], g[~left], h[~left], depth - 1)


def _leaf(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


class Model:
    """Boosted trees (``prior`` plus leaf values, logistic) and thresholds by kind."""

    def __init__(self, prior: float, trees: list, thresholds: list[float]):
        self.prior, self.trees, self.thresholds = prior, trees, thresholds

    def probability(self, row) -> float:
        return 1 / (1 + math.exp(-(self.prior + sum(_leaf(t, row) for t in self.trees))))

    def column(self, f: Column) -> Column:
        """The same as an expression over the feature array."""

        def walk(t):
            return F.when(F.get(f, F.lit(t[0])) <= t[1], walk(t[2])).otherwise(walk(t[3])) if isinstance(t, tuple) else F.lit(float(t))

        total = F.lit(self.prior)
        for t in self.trees:
            total = total + walk(t)
        return 1 / (1 + F.exp(-total))


def fit_vectors(learn: list[tuple], calibrate: list[tuple]) -> Model:
    """From (feature vector, positives, rows) of the two parts."""
    pos, n = (np.array([r[i] for r in learn], dtype=float) for i in (1, 2))
    if not len(n) or not pos.sum():
        return Model(-20.0, [], [2.0] * len(KINDS))
    x = np.array([r[0] for r in learn], dtype=np.int64)
    prior = math.log((pos.sum() + 0.5) / (n.sum() - pos.sum() + 0.5))
    at, trees = np.full(len(n), prior), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-at))
        trees.append(_tree(x, pos - n * p, n * p * (1 - p), DEPTH))
        at += np.array([_leaf(trees[-1], row) for row in x])
    m = Model(prior, trees, [2.0] * len(KINDS))
    for k in range(len(KINDS)):
        good = total = 0
        rows = sorted(((m.probability(v), a, b) for v, a, b in calibrate if v[0] == k), reverse=True)
        for i, (s, a, b) in enumerate(rows):
            good, total = good + a, total + b
            last = i + 1 == len(rows) or rows[i + 1][0] < s
            if last and s >= 0.5 and good >= PRECISION * total:
                m.thresholds[k] = s - 1e-9
    return m


def fit(docs: DataFrame) -> Model:
    """The trees from all rows of ``docs`` (doc_id, text)."""
    df = _prepared(docs.select("doc_id", "text"))
    apart = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("apart")
    same = lambda c: F.exists("_base", lambda b: (b["k"] == c["k"]) & (b["s"] == c["s"]) & (b["e"] == c["e"]))
    inside = lambda c: F.exists(F.concat("_base", "_failed"), lambda b: (b["k"] == c["k"]) & (b["s"] <= c["s"]) & (b["e"] >= c["e"]) & (b["e"] - b["s"] > c["e"] - c["s"]))
    labelled = F.transform(F.filter("_cand", lambda c: ~inside(c) & ~c["formless"]), lambda c: F.struct(c["f"].alias("f"), same(c).cast("int").alias("y")))
    rows = df.where(F.size("_cand") > 0).select(apart, F.explode(labelled).alias("c"))
    table = rows.groupBy("apart", "c.f").agg(F.sum("c.y").alias("pos"), F.count(F.lit(1)).alias("n"))
    top = table.orderBy(F.desc("n"), "apart", "f").limit(MAX_VECTORS).collect()
    part = lambda a: sorted((tuple(r["f"]), r["pos"], r["n"]) for r in top if r["apart"] == a)
    return fit_vectors(part(False), part(True) or part(False))


def find(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (``text``) with ``base_spans`` and ``added_spans``: arrays of
    (k: index into KINDS, s: start, e: end, p: probability; code points)."""
    df = _prepared(docs.drop("base_spans", "added_spans"))
    free = lambda c: ~F.exists("_base", lambda b: (b["s"] < c["e"]) & (b["e"] > c["s"]))
    limit = F.array(*[F.lit(t) for t in model.thresholds])
    one = lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e"), model.column(c["f"]).alias("p"))
    scored = F.filter(F.transform(F.filter("_cand", free), one), lambda c: c["p"] >= F.get(limit, c["k"]))
    order = F.transform(F.array_sort(F.transform("_scored", lambda c: F.struct((-c["p"]).alias("o"), c["s"].alias("s"), c["e"].alias("e"), c["k"].alias("k"))))
                        , lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e"), (-c["o"]).alias("p")))
    take = lambda acc, c: F.when(F.exists(acc, lambda t: (t["s"] < c["e"]) & (t["e"] > c["s"])), acc).otherwise(F.concat(acc, F.array(c)))
    none = F.expr(f"cast(array() as {ADDED})")
    base = F.transform("_base", lambda b: F.struct(b["k"].alias("k"), b["s"].alias("s"), b["e"].alias("e"), F.lit(1.0).alias("p")))
    df = df.withColumn("_scored", F.when(F.size("_cand") > 0, scored).otherwise(none))
    added = F.when(F.size("_scored") > 0, F.aggregate(order, none, take)).otherwise(none)
    return df.withColumns({"base_spans": base, "added_spans": added}).drop("_base", "_failed", "_cand", "_scored")


def _count(kind: int) -> Column:
    return F.size(F.filter("base_spans", lambda c: c["k"] == kind))


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    rows = F.array_sort(F.transform(spans, lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"))))
    return F.array_join(F.transform(rows, lambda c: F.concat_ws(":", F.get(names, c["k"]), c["s"].cast("string"), c["e"].cast("string"))), ",")


def _replaced(df: DataFrame, spans: Column) -> DataFrame:
    """``df`` with the spans (s, k, e) of ``text`` replaced by ``<KIND>``;
    overlapping spans are replaced together under the kind of the first."""
    rows = F.array_sort(F.transform(spans, lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"))))
    none = F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)")

    def join(acc, c):
        last = F.element_at(acc, -1)
        wider = F.struct(last["s"].alias("s"), last["k"].alias("k"), F.greatest(last["e"], c["e"]).alias("e"))
        meets = F.when(F.size(acc) > 0, c["s"] < last["e"]).otherwise(False)
        return F.when(meets, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(wider))).otherwise(F.concat(acc, F.array(c)))

    df = df.withColumn("_runs", F.when(F.size(rows) > 0, F.aggregate(rows, none, join)).otherwise(none))
    runs, names = F.col("_runs"), F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    end = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(runs, i - 1)["e"])
    piece = lambda r, i: F.concat(F.substring("text", end(i) + 1, r["s"] - end(i)), F.get(names, r["k"]))
    tail = F.substring("text", F.element_at(runs, -1)["e"] + 1, F.length("text"))
    text = F.when(F.size(runs) > 0, F.concat(F.array_join(F.transform(runs, piece), ""), tail)).otherwise(F.col("text"))
    return df.withColumn("text", text).drop("_runs")


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with every base and added span of ``text`` replaced by
    ``<KIND>``.  What is cut out can leave a new match of a base pattern (a
    phone number after which an address went), so base spans are replaced once
    more in the text that results."""
    df = find(docs, model)
    df = _replaced(df, F.concat("base_spans", "added_spans"))
    df = _with_spans(df, "text", BASE, "_b_")
    left = F.concat(*[_checked(k, True) for k in KINDS])
    return _replaced(df.withColumn("_left", left), F.col("_left")).drop("_left", *[f"_b_{k}" for k in KINDS])


def op10_pii(docs: DataFrame) -> DataFrame:
    """The contract's columns (counts and digest of the base spans, all spans)."""
    docs = docs.select("doc_id", "text")
    df = find(docs, fit(docs))
    counts = {f"n_{k}": _count(i).cast("long") for i, k in enumerate(KINDS)}
    return df.select(
        "doc_id",
        *[v.alias(k) for k, v in counts.items()],
        F.sha2(_listed(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.concat("base_spans", "added_spans")).alias("spans"),
        F.size("added_spans").cast("long").alias("n_added"),
    )
