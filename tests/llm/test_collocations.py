"""Phrase collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.frames import edge_rows, frame, prose
from tillroll.llm import collocations as col
from tillroll.llm.tries import DoubleArray


def brute(rows, min_count=10, kept=2000, cover=50):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        k = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            n[k] += len(w)
            for m in (1, 2, 3):
                f.update((k, *w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for p, a in f.items():
        if len(p) == 2 or a < min_count:
            continue
        k, w = p[0], p[1:]
        cuts = []
        for c in range(1, len(w)):
            left, right = f[(k, *w[:c])], f[(k, *w[c:])]
            cuts.append((1000000 * a * a // (left * right), c, left, right))
        score, _, left, right = min(cuts)
        out.append([k, " ".join(w), a, left, right, n[k], score, w])
    longer = Counter()
    for k, _, a, *_, w in out:
        if len(w) == 3:
            for x in (w[:2], w[1:]):
                longer[k, x] = max(longer[k, x], a)
    out = [r for r in out if not (len(r[-1]) == 2 and (r[0], r[-1]) in longer and 100 * longer[r[0], r[-1]] >= cover * r[2])]
    got = []
    for k in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == k), key=lambda r: (-r[6], -r[2], r[1].encode()))[:kept]
        got += [(k, i, p, a, left, right, total, s) for i, (_, p, a, left, right, total, s, _) in enumerate(mine, 1)]
    return sorted(got)


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    some = [(100 + i, prose(rng, rng.randint(0, 300)), rng.choice(["en", "fr", None])) for i in range(60)]
    shared = "free as in beer; Free As IN Beer\tand  so on"
    return edge_rows() + some + [(300 + i, shared + " " + str(i), "en") for i in range(12)] + [(400, "la la la la " * 30, "de")]


def test_equals_brute_force(spark, rows):
    df = frame(spark, rows, "clashing")
    got = col.op11_collocations(df)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows)
    assert len(want) > 300 and found(got) == want


def test_many_shards_and_a_cut(spark, rows):
    got = col.mine(frame(spark, rows), min_count=5, kept=20, shard=40)
    assert found(got) == brute(rows, min_count=5, kept=20)


def test_a_text_over_several_chunks(spark):
    rng = random.Random(8)
    text = " ".join(rng.choice("abcdefgh") + ("." if rng.random() < 0.1 else "") for _ in range(2 * col.CHUNK_WORDS + 7))
    rows = [(1, text, "en"), (2, "a b c", "en")]
    assert found(col.mine(frame(spark, rows))) == brute(rows)


def test_shared_buckets_add_no_counts(spark, rows, monkeypatch):
    """Hashes that say little give more candidates and the same rows."""
    monkeypatch.setattr(col, "_named", lambda found, words, n: _all_words(words, n))
    small = [r for r in rows if r[0] and r[0] >= 300]
    assert found(col.mine(frame(spark, small))) == brute(small)


def _all_words(words, n):
    out = words.select("lang", words.word.alias("w0"))
    for k in range(1, n):
        out = out.join(words.select("lang", words.word.alias(f"w{k}")), "lang")
    return out


def test_empty_table(spark):
    df = frame(spark, [(1, "a b", "en")]).where("false")
    assert found(col.op11_collocations(df)) == []
    assert found(col.op11_collocations(frame(spark, [(1, None, None), (2, "", "en")]))) == []


def test_double_array_walks_every_path():
    rng = np.random.default_rng(1)
    paths = np.unique(rng.integers(0, 40, size=(3000, 3)), axis=0)
    short = np.unique(rng.integers(0, 40, size=(200, 2)), axis=0)
    paths = np.concatenate([paths, np.column_stack([short, np.full(len(short), -1)])])
    trie = DoubleArray.build(paths)
    text = rng.integers(-1, 45, size=20_000).astype(np.int32)
    got = Counter()
    for states in trie.walk(0, text, len(text) - 1, 3):
        hit = trie.accept[states]
        got.update(hit[hit >= 0].tolist())
    at = {tuple(int(x) for x in p if x >= 0): i for i, p in enumerate(paths)}
    want = Counter()
    for i in range(len(text) - 1):
        for m in (2, 3):
            if (k := at.get(tuple(text[i : i + m].tolist()))) is not None and i + m <= len(text):
                want[k] += 1
    assert got == want and len(want) > 500


def test_double_array_of_wide_and_single_states():
    wide = [[0, c, -1] for c in range(5000)] + [[1, c, -1] for c in range(0, 5000, 2)] + [[2, 7, 9]]
    trie = DoubleArray.build(np.array(wide))
    for i, p in enumerate(wide):
        s = np.zeros(1, dtype=np.int32)
        for c in p:
            if c >= 0:
                s = trie.step(s, np.array([c]))
        assert trie.accept[s[0]] == i
    assert trie.step(np.zeros(1, dtype=np.int32), np.array([3]))[0] == -1
    assert DoubleArray.build(np.zeros((0, 4), dtype=np.int64)).step(np.zeros(1, dtype=np.int32), np.array([0]))[0] == -1
