"""Toxicity: marginals by enumeration, learned spans, held-out accuracy, edge rows."""

import itertools
import math
import random

import numpy as np
import pytest

from tests.llm.frames import edge_rows, frame, prose
from tillroll.llm import toxicity as T
from tillroll.sources.tables import read_table


def test_forward_backward_by_enumeration():
    rng = np.random.RandomState(0)
    t = rng.randn(2, 2)
    e = rng.randn(3, 5)
    n = np.array([5, 1, 3])
    p, pairs, z = T.forward_backward(e, n, t)
    for s in range(3):
        total, node, pair = 0.0, np.zeros(5), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=int(n[s])):
            w = math.exp(sum(e[s, i] for i, y in enumerate(path) if y) + sum(t[a, b] for a, b in zip(path, path[1:])))
            total += w
            for i, y in enumerate(path):
                node[i] += w * y
            for a, b in zip(path, path[1:]):
                pair[a, b] += w
        assert z[s] == pytest.approx(math.log(total))
        assert p[s] == pytest.approx(node / total) and pairs[s] == pytest.approx(pair / total)


def corpus(n=300):
    rng, out = random.Random(4), []
    for i in range(n):
        t = prose(rng, rng.randint(20, 120))
        y = int(i % 5 == 0)
        if y:
            w = t.split()
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["grokolt", "grokole", "GROKOLTA!!", "vizzap", "vizzaps###"]))
            t = " ".join(w)
        out.append((i, t, y))
    return out


def test_learns_spans_and_new_inflections():
    rows = corpus()
    m = T.train([(t, y) for _, t, y in rows])
    emit = T._Emissions(m)
    text = "Well the grokolnew, and vizzapped of it. All is fine."
    n, chains = T._doc_chains(emit, text)
    ps = T.marginals(m, [[w[2] for w in c] for c in chains])
    found = {text[w[0] : w[1]]: x for c, p in zip(chains, ps) for w, x in zip(c, p)}
    likely = sorted(found, key=found.get)[-2:]
    assert set(likely) == {"grokolnew", "vizzapped"} and min(found[w] for w in likely) > 5 * sorted(found.values())[-3]
    assert T._score(m, T._evidence((n, chains), ps)) > 0.7
    assert T._score(m, T._evidence(T._doc_chains(emit, "All is fine."), [])) < 0.2


def test_held_out_documents(spark):
    docs, labels = read_table(spark, "/root/testdata/sf0.01", "documents"), read_table(spark, "/root/testdata/sf0.01", "labels")
    rows = T.op1_toxicity(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    pos, neg = [r.score for r in held if r.toxic], [r.score for r in held if not r.toxic]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert auc > 0.85 and sum(r.predicted for r in held if not r.toxic) <= 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_edge_rows(spark):
    rows = corpus()
    docs = frame(spark, [(1000 + d, t, "en") for d, t, _ in rows] + edge_rows(), "extra")
    labels = spark.createDataFrame([(1000 + d, y) for d, _, y in rows] + [(None, 1), (1001, None), (1002, 0), (7, 0), (9999, 1)], "doc_id long, toxic int")
    got = T.op1_toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3, 5)}) == 1
    none = labels.limit(0)
    assert {r.predicted for r in T.op1_toxicity(docs, none).collect()} == {0}
    assert T.op1_toxicity(docs.limit(0), labels).collect() == []


def test_sentence_of_many_words():
    m = T.train([(t, y) for _, t, y in corpus()])
    text = "so grokolt " * 3000
    n, chains = T._doc_chains(T._Emissions(m), text)
    (p,) = T.marginals(m, [[w[2] for w in c] for c in chains])
    assert n == 6000 and len(p) == 6000 and np.isfinite(p).all()
