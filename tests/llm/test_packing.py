"""Packing: every id once, gapless sequences, the curve's properties, edge rows."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.frames import edge_rows, frame, prose
from tillroll.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(pieces, docs, sequence=4096):
    t = Tokenizer.from_file(PATH)
    left = defaultdict(list)
    for d, text, *_ in docs:
        left[d].append(t.encode(text or "", add_special_tokens=False).ids + [2])
    by, seq = defaultdict(list), defaultdict(list)
    for r in pieces:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append((r.offset, r.length))
    for d, wanted in left.items():
        got = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by[d])
        if len({tuple(w) for w in wanted}) == len(wanted) == 1:
            (ids,), pos = wanted, 0
            for start, length, crc, n in got:
                assert start == pos and n == len(ids) and zlib.crc32(np.array(ids[start : start + length], dtype="<u4").tobytes()) == crc
                pos += length
            assert pos == len(ids)
        assert sum(g[1] for g in got) == sum(map(len, wanted))
    ends = []
    for s in sorted(seq):
        at = 0
        for o, n in sorted(seq[s]):
            assert o == at
            at += n
        ends.append(at)
    assert all(e == sequence for e in ends[:-1]) and (not ends or 0 < ends[-1] <= sequence)
    assert sorted(seq) == list(range(len(seq)))


def test_whole_documents(spark):
    rng = random.Random(6)
    rows = [(100 + i, prose(rng, rng.randint(1, 900)) + " Straße ŒUVRE it's 12,5€ ", "en") for i in range(120)] + edge_rows()
    check(P.op5_pack(frame(spark, rows, "extra")).collect(), rows)


def test_short_sequences_and_copies(spark):
    rng = random.Random(7)
    same = prose(rng, 50)
    rows = [(i, same, "en") for i in range(200)]
    check(P.pack(frame(spark, rows), PATH, sequence=64, task_tokens=500).collect(), rows, 64)


def test_empty(spark):
    assert P.op5_pack(frame(spark, [(1, "a", "en")]).limit(0)).collect() == []


def test_words_are_tokenised_like_whole_texts():
    t, w = Tokenizer.from_file(PATH), P._Words(PATH)
    rng = random.Random(8)
    texts = ["don't é ﬁ x y <|endoftext|> a\tb\x0bc 日本語 İ ΣΑΣ", "", None, prose(rng, 500), "\x1ca\x1db", "Then,! THEN;. They're. don.'t l'eau, ÉTÉ!! ǅ. ŉx, Ḁ! <| a|b| x\u0301. ß ﬀ", "straße. 5. a5, İx!"]
    for text, got in zip(texts, w.ids(texts)):
        assert np.frombuffer(got, dtype="<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids


def test_cache_bound(monkeypatch):
    monkeypatch.setattr(P, "_CACHE_WORDS", 50)
    w = P._Words(PATH)
    texts = [prose(random.Random(i), 60) for i in range(20)]
    full = P._Words(PATH)
    monkeypatch.setattr(P, "_CACHE_WORDS", 50)
    assert [w.ids([x])[0] for x in texts] == [full.ids([x])[0] for x in texts]


def test_hilbert_is_a_curve():
    for dims, bits in ((2, 3), (3, 2)):
        every = list(itertools.product(range(1 << bits), repeat=dims))
        cells = dict(zip(P.hilbert(np.array(every), bits).tolist(), every))
        assert sorted(cells) == list(range(1 << bits * dims))
        path = [cells[i] for i in sorted(cells)]
        assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(path, path[1:]))


def test_neighbours_are_alike(spark):
    """Documents of one vocabulary lie closer on the curve than chance."""
    rng = random.Random(10)
    sets = ["alpha beta gamma delta".split(), "north south east west".split(), "red green blue black".split()]
    rows = [(i, " ".join(rng.choice(sets[i % 3]) for _ in range(80)), "en") for i in range(90)]
    pieces = sorted(P.op5_pack(frame(spark, rows)).collect(), key=lambda r: (r.sequence_id, r.offset))
    order = [r.doc_id % 3 for r in pieces if r.start == 0]
    assert sum(a == b for a, b in zip(order, order[1:])) > 0.6 * len(order)
