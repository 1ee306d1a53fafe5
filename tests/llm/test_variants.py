"""Spelling variants against a comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from tests.llm.frames import edge_rows, frame, prose
from tillroll.llm import variants as var


def words_of(rows):
    n = Counter()
    for doc, text, _ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    near = {w: [o for o in words if abs(len(o) - len(w)) < 2 and one_edit(w, o)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        if best and words[best] >= 2 * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = ["grey", "greys", "Élève", "elève", "naïve", "naïves", "organise", "organize", "organizes", "x" * 300, "x" * 301, "×÷abc", "abcde"]
    some = [(100 + i, " ".join(rng.choice(base[: rng.randint(1, len(base))]) for _ in range(40)) + " " + prose(rng, 60), "en") for i in range(40)]
    chain = [(90, "color " * 40 + "colour " * 12 + "colours " * 4, "en")]
    return edge_rows() + some + chain


def test_equals_brute_force(spark, rows):
    got = var.op13_variants(frame(spark, rows, "clashing"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(words_of(rows))
    assert found(got) == want
    assert any(r[1] and r[1] != r[2] for r in want), "a chain of forms"


def test_chains_settle(spark):
    """Each word has twice the count of the one before it, a letter away."""
    words = [("a" * (9 + i), 3 * 2**i) for i in range(20)]
    got = var.group_variants(spark.createDataFrame(words, "word string, n long"))
    assert {r["root"] for r in got.collect()} == {"a" * 28}


def test_ties_and_ratio(spark):
    words = [("abcde", 6), ("abcdf", 12), ("abcdg", 12), ("zzzzz", 5), ("zzzzy", 9)]
    got = {r["word"]: r for r in var.group_variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got["abcde"]["form"] == "abcdf" and got["abcde"]["n_near"] == 2 and got["abcdf"]["form"] is None
    assert got["zzzzz"]["form"] is None and got["zzzzz"]["n_near"] == 1 and got["zzzzz"]["root"] == "zzzzz"


def test_every_edit_is_in_the_neighbourhood():
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzéß"
    for n in (1, 2, 5, 9, 30):
        w = "".join(rng.choice(letters) for _ in range(n))
        own = set(var.neighbourhoods([w])[0].tolist())
        assert len(var.neighbourhoods([w])[0]) == 17 * n + 9
        for i in range(n + 1):
            for c in letters:
                for o in (w[:i] + c + w[i:], w[:i] + c + w[i + 1 :] if i < n else w, w[:i] + w[i + 1 :] or w):
                    assert int(var.reduced_keys([o])[0]) in own


def test_no_join_collects_words_on_the_driver(spark):
    """Small files stand for a neighbourhood that Spark sizes too low."""
    words = var.saved(spark.createDataFrame([("a" * (9 + i), 3 * 2**i) for i in range(9)], "word string, n long"), "words")
    for df in (var.near_words(words), var.group_variants(words)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_empty_table(spark):
    df = frame(spark, [(1, "a b", "en")]).where("false")
    assert found(var.op13_variants(df)) == []
    assert found(var.op13_variants(frame(spark, [(1, None, None), (2, "", "en")]))) == []
