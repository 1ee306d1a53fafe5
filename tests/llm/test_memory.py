"""What a worker process keeps between tasks and between stages."""

import random

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql.types import StringType, StructField, StructType

from tests.llm.frames import prose
from tillroll.llm import common, jaccard_join
from tillroll.llm import packing as P


class Caught(Exception):
    pass


class Frame:
    """Stands for a DataFrame; keeps the function given to mapInArrow."""

    columns, schema = ["text"], StructType([StructField("text", StringType())])

    def drop(self, *names):
        return self

    def mapInArrow(self, run, out):
        return run


@pytest.fixture
def released(monkeypatch):
    calls = []

    class Pool:
        def release_unused(self):
            calls.append(1)

    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    return calls


def test_memory_is_given_back_when_a_task_ends(spark, released):
    batch = pa.RecordBatch.from_arrays([pa.array(["a", None])], names=["text"])
    run = common.map_rows(Frame(), "n long", lambda batches: ({"n": [b.num_rows]} for b in batches))
    assert [b.to_pydict() for b in run(iter([batch]))] == [{"n": [2]}] and len(released) == 1
    run = common.with_columns(Frame(), ["text"], "n long", lambda t: {"n": [len(x or "") for x in t]})
    assert [b.to_pydict() for b in run(iter([batch]))] == [{"text": ["a", None], "n": [1, 0]}] and len(released) == 2
    rows = run(iter([batch, batch]))  # not read to its end
    next(rows)
    rows.close()
    assert len(released) == 3


def test_tasks_of_a_worker_share_the_word_table(spark, monkeypatch, tmp_path):
    made, tasks = [], []

    class Words(P._Words):
        def __init__(self, path):
            made.append(path)

        def arrays(self, texts):
            return [P.np.zeros(0, dtype="<u4") for _ in texts]

    def caught(df, ddl, fn):
        tasks.append(cloudpickle.dumps(fn))
        raise Caught

    monkeypatch.setattr(P, "_Words", Words)
    monkeypatch.setattr(P, "_words", {})
    monkeypatch.setattr(P, "map_rows", caught)
    with pytest.raises(Caught):
        P.tokenised(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "path")
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a"]), pa.array([0])], names=["doc_id", "text", "spread"])
    for _ in range(3):  # as a worker does it for each task
        assert [r["n"] for r in cloudpickle.loads(tasks[0])(iter([batch]))] == [[1]]
    assert made == ["path"]
    P._forget()
    assert not P._words


def test_buckets_get_the_bytes_that_are_compared(spark, monkeypatch):
    rng = random.Random(3)
    texts = [prose(rng, 60) for _ in range(4)]
    sigs = [jaccard_join.signature(jaccard_join.shingles(t), jaccard_join._seeds()) for t in [*texts, texts[0]]]
    reps = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sigs)], "rep long, sig binary")
    members = spark.createDataFrame([(7, i) for i in range(5)], "key long, rep long")
    sent = []
    real = jaccard_join.map_rows
    monkeypatch.setattr(jaccard_join, "map_rows", lambda df, *a: sent.append(df) or real(df, *a))
    assert [tuple(r) for r in jaccard_join._bucket_links(members, reps).collect()] == [(0, 4)]
    rows = {r["rep"]: r for r in sent[0].collect()}
    assert all(sum(len(v) for v in r if not isinstance(v, int)) == jaccard_join.T for r in rows.values())
    assert all(bytes(rows[i]["low"]) == bytes(int(x) & 0xFF for x in s) for i, s in enumerate(sigs))
