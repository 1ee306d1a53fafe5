"""Corpus-wide questions about hashed keys, asked in bulk.

Documents are gathered into chunks of a few MB (written once, compressed).  A
chunk's distinct 64-bit keys (words, n-grams, windows of bytes) are cut by
their leading bits into parts; every part is one row (chunk, part, blob), so a
shuffle moves 7 bytes a key (or less) instead of a row a key.  A key is sent
once by each chunk, however often it occurs there, so no key is hot.  The
answers come back in the order of the question and meet the chunk again.

A chunk is read by one task at a time, a part as well; both sizes are bounded:
``chunk_bytes`` of text (one longer document is a chunk of its own), and parts
get more and smaller as the corpus grows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import map_rows, saved

CHUNK_BYTES = 2 << 20
PART_BYTES = 16 << 20  # most text that a part stands for
NULL_ID = -(1 << 63)  # stands for a null id inside a chunk
CHUNK = "chunk long, kind int, n_bytes long, ids binary, sizes binary, text binary"


def squeeze(b: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(b)


def expand(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)


class Docs:
    """The documents of a chunk row."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.sizes = np.frombuffer(row["sizes"], dtype=np.int64)
        self.kind = row["kind"]
        self.data = expand(row["text"])

    def texts(self) -> list[bytes]:
        ends = np.cumsum(self.sizes)
        return [self.data[e - s : e] for e, s in zip(ends.tolist(), self.sizes.tolist())]


def write_chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` (doc_id, text, kind) as chunks of one kind each; null text is empty."""

    def run(batches):
        task, seq = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def row(kind):
            nonlocal seq
            ids, parts = zip(*held.pop(kind))
            seq += 1
            data = b"".join(parts)
            return {
                "chunk": [task << 32 | seq], "kind": [kind], "n_bytes": [len(data)], "ids": [np.array(ids, dtype=np.int64).tobytes()],
                "sizes": [np.array([len(p) for p in parts], dtype=np.int64).tobytes()], "text": [squeeze(data, 6)],
            }

        size: dict[int, int] = {}
        for b in batches:
            for doc, text, kind in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "kind"))):
                t = (text or "").encode("utf-8", "surrogatepass")
                held.setdefault(kind, []).append((NULL_ID if doc is None else doc, t))
                size[kind] = size.get(kind, 0) + len(t) + 64
                if size[kind] >= chunk_bytes:
                    size[kind] = 0
                    yield row(kind)
        for kind in list(held):
            yield row(kind)

    return saved(map_rows(docs.select("doc_id", "text", "kind"), CHUNK, run), "chunks")


def part_bits(chunks: DataFrame) -> int:
    """Leading bits of a key that name its part: more for a larger corpus, bit
    by bit, since every chunk sends a row to nearly every part."""
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    return min(24, max(8, math.ceil(math.log2(max(total, 1) / PART_BYTES))))


def pack_keys(keys: np.ndarray, bits: int) -> list[tuple[int, slice]]:
    """Parts of sorted distinct keys: (part, their range)."""
    top = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cut = np.flatnonzero(np.diff(top)) + 1
    starts = np.concatenate([[0], cut]) if len(keys) else np.zeros(0, dtype=np.int64)
    ends = np.concatenate([cut, [len(keys)]]) if len(keys) else starts
    return [(int(top[s]), slice(int(s), int(e))) for s, e in zip(starts, ends)]


def key_bytes(keys: np.ndarray, bits: int) -> bytes:
    """The keys of one part without the whole bytes that the part names."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : 8 - bits // 8].tobytes()


def keys_from(b: bytes, bits: int) -> np.ndarray:
    """Keys of a part without the named bits (as numbers in the part's order)."""
    w = 8 - bits // 8
    out = np.zeros((len(b) // w, 8), dtype=np.uint8)
    out[:, :w] = np.frombuffer(b, dtype=np.uint8).reshape(-1, w)
    return out.reshape(-1).view("<u8").astype(np.uint64) & np.uint64((1 << (64 - bits)) - 1)


def rows_of(batches):
    """Rows as dicts, one at a time (a batch holds up to 64 MB of blobs)."""
    for b in batches:
        names, cols = b.schema.names, b.columns
        for i in range(b.num_rows):
            yield {n: c[i].as_py() for n, c in zip(names, cols)}


def grouped(rows, key: str):
    """Lists of rows that follow each other with the same key."""
    now: list = []
    for r in rows:
        if now and r[key] != now[0][key]:
            yield now
            now = []
        now.append(r)
    if now:
        yield now


ASKED = "part long, chunk long, blob binary"


def ask(chunks: DataFrame, questions: Callable, answer: Callable) -> DataFrame:
    """Answers (part, chunk, blob) to the questions of all chunks, written.

    ``questions(row)`` yields (part, blob) of a chunk row; ``answer(part,
    [(chunk, blob), ...])`` yields (chunk, blob) for a part's questions."""

    def send(batches):
        for r in rows_of(batches):
            got = list(questions(r))
            yield {"part": [p for p, _ in got], "chunk": [r["chunk"]] * len(got), "blob": [b for _, b in got]}

    def reply(batches):
        for g in grouped(rows_of(batches), "part"):
            got = list(answer(g[0]["part"], [(r["chunk"], r["blob"]) for r in g]))
            yield {"part": [g[0]["part"]] * len(got), "chunk": [c for c, _ in got], "blob": [b for _, b in got]}

    sent = map_rows(chunks, ASKED, send)
    return saved(map_rows(sent.repartition("part").sortWithinPartitions("part", "chunk"), ASKED, reply), "answers")


def meet(chunks: DataFrame, answers: DataFrame, ddl: str, fn: Callable) -> DataFrame:
    """``fn(chunk row, {part: blob})`` -> {column: list} for every chunk."""
    own = chunks.select("chunk", F.lit(-1).cast("long").alias("part"), "kind", "n_bytes", "ids", "sizes", "text")
    none = F.lit(None)
    back = answers.where("chunk >= 0").select("chunk", "part", none.cast("int").alias("kind"), none.cast("long").alias("n_bytes"), none.cast("binary").alias("ids"), none.cast("binary").alias("sizes"), F.col("blob").alias("text"))

    def run(batches):
        for g in grouped(rows_of(batches), "chunk"):
            yield fn(g[0], {r["part"]: r["text"] for r in g[1:]})

    return map_rows(own.union(back).repartition("chunk").sortWithinPartitions("chunk", "part"), ddl, run)
