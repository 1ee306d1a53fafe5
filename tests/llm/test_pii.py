"""Personal data: base spans by brute force, added spans, redaction, edge rows."""

import hashlib
import random
import re

from tests.llm.frames import edge_rows, frame, prose
from tillroll.llm import pii

PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base(t):
    out = []
    for k, rx in enumerate(PATTERNS):
        for m in rx.finditer(t or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = (True, k != 1 or all(int(x) <= 255 for x in m.group().split(".")), 14 <= len(d) <= 19 and luhn(d), 10 <= len(d) <= 15)[k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def card(rng, good=True, n=16):
    while True:
        d = "".join(rng.choice("0123456789") for _ in range(n))
        if luhn(d) == good and d[0] != "0":
            return d


def corpus(n=160):
    rng, rows = random.Random(2), []
    for i in range(n):
        bits = [
            f"{rng.choice('abcxyz')}{i}.q@mail{i % 7}.example.com", ".".join(str(rng.randint(0, 255)) for _ in range(4)), card(rng), card(rng, False),
            f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", "999.1.2.3", "tok4f2a9981bc", str(rng.randint(1, 10**6)),
        ]
        rng.shuffle(bits)
        rows.append((1000 + i, " ".join(f"{prose(rng, 8)} é {b}," for b in bits), "en"))
    return rows


TRICKY = [
    (1, "a@b.c%x@y.z d@e@f.g.h. @x.y a@b a@-.- \U0001f600k@l.m", "en"),
    (2, "1.2.3.4.5.6.7.8.9 01.002.0003.255 256.1.1.1 1..2.3.4", "en"),
    (3, "4111 1111-1111 1111 4111  1111 5500005555555559- 4111-1111-1111-1111x0", "en"),
    (4, "+1 (743) 555-3824 +12 +1()()() +123456789012345 +1234567890123456 ++44 20 7946 0958.", "en"),
    (5, "a." * 3000 + "@" + "b." * 3000 + "c", "en"),
    (6, "9" * 20_000 + " " + "1.2." * 2000, "en"),
    (7, "+" * 500 + "1(" * 500, None),
]


def test_base_spans_match_brute_force(spark):
    rows = corpus(40) + TRICKY + edge_rows()
    got = pii.op10_pii(frame(spark, rows)).collect()
    want = []
    for d, t, _ in rows:
        b = base(t)
        want.append((d, *(sum(x[1] == k for x in b) for k in range(4)), hashlib.sha256(listed(b).encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    texts = {d: t for d, t, _ in rows}
    for r in got:
        spans = [x for x in r.spans.split(",") if x]
        assert set(listed(base(texts[r.doc_id])).split(",")) - {""} <= set(spans)
        starts = [int(x.split(":")[1]) for x in spans]
        assert starts == sorted(starts)


def test_parts_of_failed_matches_are_added(spark):
    rng = random.Random(9)
    good, bad, phone = card(rng), card(rng, False), "+1 (826) 555-4081"
    rows = [*corpus(), (1, f"see {bad} {good} there", "en"), (2, f"ring {phone} 190.137.223.204 now", "en"), (3, f"only {bad} here", "en")]
    got = {r.doc_id: r for r in pii.op10_pii(frame(spark, rows)).collect()}
    at = 4 + len(bad) + 1
    assert got[1].spans == f"card:{at}:{at + 16}" and got[1].n_card == 0 and got[1].n_added == 1
    assert f"phone:5:{5 + len(phone)}" in got[2].spans.split(",") and got[2].n_phone == 0
    assert got[3].spans == "" and got[3].n_added == 0


def test_expression_equals_the_trees(spark):
    docs = frame(spark, corpus())
    model = pii.fit(docs)
    assert model.trees
    df = pii._prepared(docs.select("doc_id", "text")).selectExpr("explode(_cand) c").selectExpr("c.f f").distinct()
    rows = df.select("f", model.column(df["f"]).alias("p")).collect()
    assert len(rows) > 10 and all(abs(model.probability(r.f) - r.p) < 1e-9 for r in rows)


def replaced(t, spans):
    runs = []
    for a, k, b in spans:
        if runs and a < runs[-1][2]:
            runs[-1][2] = max(b, runs[-1][2])
        else:
            runs.append([a, k, b])
    out, pos = "", 0
    for a, k, b in runs:
        out, pos = out + t[pos:a] + f"<{pii.KINDS[k].upper()}>", b
    return out + t[pos:]


def test_redaction(spark):
    model = pii.fit(frame(spark, corpus()))
    rows = [(d + 500, t, k) for d, t, k in TRICKY[:4]] + edge_rows() + corpus(20)
    got = pii.redact(frame(spark, rows, "extra"), model).collect()
    texts = {d: t for d, t, _ in rows if d is not None}
    for r in got:
        if r.doc_id is None:
            continue
        t = texts[r.doc_id]
        want = replaced(t or "", sorted([(s.s, s.k, s.e) for s in [*r.base_spans, *r.added_spans]]))
        want = replaced(want, base(want))
        assert r.text == (None if t is None else want) and r.rep == "own"


def test_only_dataframe_functions(spark):
    plan = pii.op10_pii(frame(spark, corpus(5)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty(spark):
    none = frame(spark, corpus(1)).limit(0)
    assert pii.op10_pii(none).collect() == []
    assert pii.fit(none).trees == []


def test_forms_that_the_base_cannot_match_are_added(spark):
    rng, rows, want = random.Random(4), corpus(), {}
    for i in range(60):
        spans = [("phone", f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"), ("email", f"name{i} (at) host{i % 7} (dot) org"), ("card", card(rng, True, 13))]
        for j, (k, t) in enumerate([*spans, ("none", str(rng.randint(10**9, 10**10 - 1))), ("none", card(rng, False, 13))]):
            pre = prose(rng, 8).replace("\n", " ") + " "
            rows.append((10_000 + 10 * i + j, f"{pre}{t} and {prose(rng, 5)}", "en"))
            want[10_000 + 10 * i + j] = (k, f"{k}:{len(pre)}:{len(pre) + len(t)}" if k != "none" else "")
    got = {r.doc_id: r.spans for r in pii.op10_pii(frame(spark, rows)).collect()}
    hits = {k: [got[d] == w for d, (kind, w) in want.items() if kind == k] for k in ("phone", "email", "card", "none")}
    print(hits_of := {k: (sum(v), len(v)) for k, v in hits.items()})
    assert all(n == m for n, m in hits_of.values())
