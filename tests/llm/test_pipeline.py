"""The pipeline's stages, each against what it was given."""

import random

import pytest

import corpus_pipeline
from tests.llm import test_packing
from tests.llm.frames import edge_rows, prose
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_jaccard_join import brute as classes
from tests.llm.test_pii import base as personal
from tillroll.llm import langid, pii


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small ``documents`` and ``benchmark`` with planted cases."""
    rng = random.Random(41)
    d = str(tmp_path_factory.mktemp("tables"))
    items = [(i, prose(rng, 30)) for i in range(5)]
    rows = [(100 + i, prose(rng, rng.randint(5, 200)), "en", "s", 0) for i in range(150)]
    rows += [(300 + i, f"{prose(rng, 40)} a{i}@b.example.org +1 ({200 + i}) 555-1234 {prose(rng, 40)}", "en", "s", 0) for i in range(40)]
    rows += [(400 + i, rows[i][1], "en", "s", 0) for i in range(30)]
    rows += [(500 + i, f"{prose(rng, 60)} {items[i][1]}", None, None, None) for i in range(5)]
    rows += [(i, t, k, None, None) for i, t, k in edge_rows(rng)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    columns = docs.columns
    steps = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, folder)
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert docs.columns == columns, name
        steps[name] = (before, [tuple(r) for r in docs.collect()])
    before, after = steps["language_id"]
    letters = lambda t: any(c.isalpha() for c in langid.normalise(t))
    assert {r[0] for r in before} - {r[0] for r in after} >= {r[0] for r in before if not letters(r[1])}
    assert len(after) > 0.95 * sum(letters(r[1]) for r in before) and all(r[2] for r in after)
    before, after = steps["ngram_jaccard"]
    want = sorted({d for d, c, _ in classes([(r[0], r[1]) for r in before]) if d is not None and d == c})
    assert sorted(r[0] for r in after if r[0] is not None) == want
    before, after = steps["decontaminate"]
    assert sorted(map(str, after)) == sorted(str(r) for r in before if not contaminated(r[1], items)[4]) and len(after) < len(before)
    before, after = steps["redact"]
    assert len(after) == len(before)
    old = {r[0]: r[1] for r in before}
    for r in after:
        assert not personal(r[1]) and r[4] == len(r[1])
        if not personal(old[r[0]]) and not any(c.isdigit() for c in old[r[0]]):
            assert r[1] == old[r[0]]
    assert any("<EMAIL>" in r[1] and "<PHONE>" in r[1] for r in after)
    name, pack = corpus_pipeline.STAGES[-1]
    test_packing.check(pack(spark, docs, folder).collect(), steps["redact"][1])


def test_run_goes_through_all_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 150 and {"doc_id", "sequence_id", "ids_crc32"} <= set(out.columns)


def test_redaction_leaves_nothing_behind(spark):
    rows = [(1, "1.2.3.4.5.6.7.8 a@b.c@d.e +1 (234) 555-0000 12.3.4.5", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    (r,) = pii.redact(df, pii.fit(df)).collect()
    assert not personal(r.text)


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, spark.createDataFrame([], docs.schema), folder) if docs.schema.names[0] == "doc_id" and "text" in docs.columns else docs
        assert docs.collect() == []
