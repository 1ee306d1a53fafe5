"""Decontamination against a brute force over all windows."""

import hashlib
import random
import re

from tests.llm.frames import edge_rows, frame, prose
from tillroll.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items):
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        k = min(13, len(iw))
        for i in range(len(iw) - k + 1 if k else 0):
            for j in range(len(w) - k + 1):
                if w[j : j + k] == iw[i : i + k]:
                    hit.update(range(j, j + k))
                    if item is not None:
                        ids.add(str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def cases():
    rng = random.Random(1)
    items = [(i, prose(rng, n)) for i, n in enumerate((40, 13, 12, 3, 1, 25, 30))]
    items += [(7, None), (8, ""), (9, "..."), (None, prose(rng, 20)), (10, items[0][1])]
    docs = [(100 + i, prose(rng, 80), "en") for i in range(12)]
    for i, (item, t) in enumerate(items):
        part = " ".join((t or "").split()[:14])
        docs.append((200 + i, f"{prose(rng, 30)} {part.upper()}!! {prose(rng, 300 if i % 2 else 20)} {t or ''}", "en"))
    return docs + edge_rows(), items


def test_matches_brute_force(spark):
    docs, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in D.op6_decontaminate(frame(spark, docs), bench).collect()), key=str)
    assert got == sorted(((d, *brute(t, items)) for d, t, _ in docs), key=str)


def test_blocks_give_the_same(spark):
    docs, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = frame(spark, docs, "extra")
    one, many = (sorted(map(str, D.decontaminate(df, bench, n).collect())) for n in (1 << 20, 300))
    assert one == many


def test_spans_are_offsets_of_the_original(spark):
    bench = spark.createDataFrame([(1, "Alpha beta gamma")], "item_id long, text string")
    df = spark.createDataFrame([(1, "é — ALPHA, beta;\n(gamma) rest"), (2, "alpha beta"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in D.decontaminate(df, bench).collect()}
    (s,) = got[1].spans
    assert "é — ALPHA, beta;\n(gamma) rest"[s.start : s.end] == "ALPHA, beta;\n(gamma"
    assert got[1].contaminated and not got[2].contaminated and got[3].n_words == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = frame(spark, [(1, "a b c", "en")])
    assert [r.n_hit for r in D.decontaminate(docs, none).collect()] == [0]
    assert D.decontaminate(docs.limit(0), none).collect() == []
