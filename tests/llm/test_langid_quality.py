"""Language ID (held-out accuracy, independent recomputation) and quality rules (brute force)."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tests.llm.frames import edge_rows, frame, prose
from tillroll.llm import langid, quality
from tillroll.sources.tables import read_table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = read_table(spark, SF, "documents")
    rows = langid.op8_language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and len(held) > 250
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.98
    assert sum(r.rejected for r in held) / len(held) < 0.02
    assert all(0 <= r.score <= 1 for r in rows)


def test_sizes_by_independent_encoder():
    d = {"aa": b"lorem ipsum dolor sit amet " * 40, "bb": b"the quick brown fox jumps over " * 40}
    text = "The QUICK brown fox, 12 dolor! " * 200
    norm = re.sub(r"[\W\d_]+", " ", text.lower()).strip().encode()
    sizes = {}
    for k, v in d.items():
        p = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=p)
        sizes[k] = sum(len(c.compress(norm[i : i + langid.PIECE] + langid.FILLER)) for i in range(0, len(norm), langid.PIECE))
    lang, _, margin, rejected = langid.judge(langid._load(d), text)
    assert lang == min(sizes, key=sizes.get) == "bb"
    assert abs(margin - (sizes["aa"] - sizes["bb"])) <= 2 and not rejected


def test_language_edge_rows(spark):
    docs = frame(spark, edge_rows(), "extra")
    got = langid.identify(docs, langid.fit(docs, F.lit(True))).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id in (1, 2, 3, 5, 11):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        assert r.rep == "own"
    assert langid.identify(docs.limit(0), {}).collect() == []
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(docs.limit(0), F.lit(True))).collect()} == {"und"}


def test_language_ties_are_rejected():
    same = {"bb": b"one two three four five " * 20, "aa": b"one two three four five " * 20}
    lang, score, margin, rejected = langid.judge(langid._load(dict(sorted(same.items()))), "one two three")
    assert (lang, margin, rejected) == ("aa", 0, True) and score == pytest.approx(0.5)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    w = WORD.findall(t)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(rep), n < 50 or 100 * len(rep) > 50 * n


def test_base_rules_by_brute_force(spark):
    rng = random.Random(3)
    rows = edge_rows() + [(50 + i, prose(rng, 200) + "\n" + "same line here\n" * (i % 4) + " <|> #" * i, "en") for i in range(20)]
    rows += [(90, "a b c " * 40 + prose(rng, 100), None), (91, "a b c d a b c", "zz")]
    df = quality.op3_quality(frame(spark, rows))
    got = sorted((tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in df.collect()), key=str)
    assert got == sorted(((d, *base(t)) for d, t, _ in rows), key=str)


def test_references_are_exact_counts(spark):
    docs = read_table(spark, SF, "documents")
    refs = quality.references(docs)
    rows = docs.collect()
    for lang, (classes, at, counts) in refs.items():
        c = Counter(w for r in rows if r.lang == lang for w in WORD.findall("".join(x.lower() if "A" <= x <= "Z" else x for x in r.text or "")))
        n = sum(c.values())
        assert {w.decode() for w in at} == {w for w, k in c.items() if k >= quality.SHARE * n}
        assert {w.decode(): counts[i] for w, i in at.items()} == {w.decode(): c[w.decode()] for w in at} and counts.sum() == n
        assert classes.sum() == sum(len((r.text or "").encode()) for r in rows if r.lang == lang)


def test_divergence_by_definition():
    import numpy as np

    def h(p):
        return -sum(x * math.log2(x) for x in p if x)

    a, b = np.array([3.0, 1, 0]), np.array([1.0, 1, 2])
    p, q = a / 4, b / 4
    assert quality.divergence(a, b) == pytest.approx(h((p + q) / 2) - (h(p) + h(q)) / 2)
    assert quality.divergence(a, np.zeros(3)) == 0


def test_quality_follows_the_labels(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    rows = quality.op3_quality(docs).join(labels, "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) / len(good) > 0.97
    assert sum(r.kept for r in bad) / len(bad) < 0.1


def test_quality_empty_and_extra_columns(spark):
    docs = frame(spark, edge_rows(), "extra")
    assert quality.op3_quality(docs.limit(0)).collect() == []
    got = quality.judge(docs, {}).collect()
    assert len(got) == docs.count() and all(r.char_divergence is None for r in got)


@pytest.mark.parametrize("noise_first", [True, False])
def test_lossy_counting_keeps_a_common_word_in_any_order(noise_first):
    """Over two million different words and one with 0.55 % of all."""
    noise = [b"n%d" % i for i in range(1_000_000)]
    late = [b"common" if i % 91 == 0 else b"m%d" % i for i in range(1_000_000)]
    words = noise + late if noise_first else late + noise
    c = quality.Lossy(0.005, 100_000)
    for at in range(0, len(words), 5_000):
        c.add(words[at : at + 5_000])
    share = words.count(b"common") / len(words)
    assert (b"common" in c.frequent()) == (share >= 0.005) and len(c.frequent()) < 2000 and len(c.counts) <= 100_000
    c.add([b"common"] * 2000)
    assert b"common" in c.frequent()


def test_references_do_not_depend_on_partitions(spark):
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randint(0, 200)), rng.choice(["en", "fr"])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [quality.references(df.repartition(n)) for n in (1, 40)]
    assert [{k: (a.tolist(), set(w), sorted(c.tolist())) for k, (a, w, c) in g.items()} for g in got][0] == {
        k: (a.tolist(), set(w), sorted(c.tolist())) for k, (a, w, c) in got[1].items()
    }


def test_distance_is_the_root_of_the_divergence():
    a, b = np.array([1.0, 3, 0]), np.array([2.0, 2, 4])
    assert quality.distance(a, b) == pytest.approx(quality.divergence(a, b) ** 0.5)
