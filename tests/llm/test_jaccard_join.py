"""Jaccard join: classes and link counts by brute force, hot groups, edge rows."""

import random
from collections import Counter

import pytest

from tests.llm.frames import edge_rows, frame, prose
from tillroll.llm import jaccard_join as J
from tillroll.sources.tables import read_table


def sets_of(t):
    w = (t or "").encode().split()
    if len(w) >= 5:
        return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)}
    return {b" ".join(w)} if w else set()


def brute(rows):
    """{row number: (class, links)} over (id, text)."""
    s = [sets_of(t) for _, t in rows]
    ok = [i for i, (d, _) in enumerate(rows) if d is not None and s[i]]
    par, links = {i: i for i in ok}, Counter()

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, i in enumerate(ok):
        for j in ok[a + 1 :]:
            n = len(s[i] & s[j])
            if n >= 0.8 * (len(s[i]) + len(s[j]) - n) - 1e-9:
                links[i] += 1
                links[j] += 1
                par[find(j)] = find(i)
    low = {}
    for i in ok:
        low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return sorted(((d, low[find(i)], links[i]) if i in par else (d, d, 0) for i, (d, _) in enumerate(rows)), key=str)


def result(spark, rows, **kw):
    df = J.jaccard_classes(frame(spark, [(d, t, "en") for d, t in rows], "extra"), **kw)
    return sorted((tuple(r) for r in df.collect()), key=str)


def near(rng, text, edits):
    w = text.split(" ")
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice(["x", "yy", "zzz"]) + str(rng.random())[2:6]
    return " ".join(w)


def corpus(rng, groups=25):
    rows = []
    for g in range(groups):
        t = prose(rng, rng.choice([8, 40, 150, 400]))
        rows.append((10 * g + 100, t))
        rows += [(10 * g + 100 + k, t if k == 1 else near(rng, t, rng.randint(1, 6))) for k in range(1, rng.randint(2, 6))]
    return rows


def test_matches_brute_force(spark):
    rows = corpus(random.Random(21)) + [(d, t) for d, t, _ in edge_rows()]
    assert result(spark, rows) == brute(rows)


def test_hot_group_is_split(spark, monkeypatch):
    """A group far beyond bucket and block size, dealt into blocks."""
    rng = random.Random(22)
    t = prose(rng, 150)
    rows = [(i, near(rng, t, rng.randint(0, 5))) for i in range(150)] + [(1000 + i, t) for i in range(40)]
    monkeypatch.setattr(J, "BLOCK", 16)
    assert result(spark, rows, small=8) == brute(rows)


def test_recall_of_pairs_near_the_threshold(spark):
    rng = random.Random(23)
    rows = []
    for g in range(120):
        t = prose(rng, 200)
        rows += [(2 * g, t), (2 * g + 1, near(rng, t, 4))]
    got = {(r[0], r[1], r[2]) for r in result(spark, rows)}
    want = set(brute(rows))
    linked = {w for w in want if w[2]}
    assert len(linked) > 60 and len(got & linked) / len(linked) >= 0.98 and not {g for g in got if g[2]} - linked


def test_runs_reach_the_recall():
    s = J._survival()
    assert 0 < s < 1 and 1 - (1 - s) ** J.runs() >= J.RECALL > 1 - (1 - s) ** (J.runs() - 1)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert {r.v: r["class"] for r in J.components(links).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a b c d e f")]])
def test_nothing_to_join(spark, rows):
    assert result(spark, rows) == [(d, d, 0) for d, _ in rows]


def test_given_documents(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((tuple(r) for r in J.op2_jaccard_join(docs).collect()), key=str) == brute(rows)


def test_recall_counts_shared_coordinates_and_the_estimate():
    """Against a simulation of the whole pool of coordinates."""
    rng, n, got = random.Random(24), J.runs(), 0.0
    for _ in range(4000):
        agree = sum(rng.random() < J.THRESHOLD for _ in range(J.T))
        q = 0.0
        for _ in range(J.DEPTHS[-1]):
            q = (1 - (1 - q) / (J.LAMBDA * J.T)) ** agree
        got += (1 - q**n) * (agree >= J.ESTIMATE * J.T)
    assert got / 4000 >= J.RECALL - 0.002 and J.expected_recall(n) >= J.RECALL > J.expected_recall(n - 1)
    with pytest.raises(ValueError):
        J.runs(0.9999)


def test_large_last_buckets_are_compared_across_blocks(spark):
    """Sets with one template: pairs unlike the first set, in different blocks,
    with one bucket as the only place to meet."""
    rng = random.Random(25)
    seeds, sigs, pairs = J._seeds(), [], []
    shared = rng.sample(range(1 << 40), 400)
    for i in range(300):
        own = rng.sample(range(1 << 40), 400)
        for k in range(2):
            s = J.np.unique(J.np.array(shared + own[: 400 - 20 * k], dtype=J.np.uint64))
            sigs.append((2 * i + k, bytearray(J.signature(J._mix(s), seeds).tobytes())))
        pairs.append((2 * i, 2 * i + 1))
    reps = spark.createDataFrame(sigs, "rep long, sig binary")
    bucket = reps.selectExpr("1L as key", "rep")
    links = spark.createDataFrame([(0, 2)], "a long, b long")
    found = J._bucket_links(J._across(bucket, J.components(links), 16), reps)
    near = {frozenset(p) for p in pairs}
    classes = {r.v: r["class"] for r in J.components(found.union(links)).collect()}
    assert all(classes[a] == classes[b] for a, b in map(tuple, near))
    units = J._across(bucket, J.components(links), 16)
    assert max(r["count"] for r in units.groupBy("key").count().collect()) < 120
    one = spark.createDataFrame([(0, i) for i in range(1, 600)], "a long, b long")
    assert J._across(bucket, J.components(one), 16).count() == 0


def test_template_beyond_the_bucket_size(spark):
    """A template in far more sets than a bucket holds; near pairs unlike the first set."""
    rng = random.Random(26)
    template, rows = prose(rng, 120), []
    for i in range(120):
        t = template + " " + prose(rng, 60)
        rows += [(2 * i, t), (2 * i + 1, near(rng, t, 2))]
    assert result(spark, rows, small=8) == brute(rows)
