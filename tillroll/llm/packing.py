"""Packing along a space-filling curve.

A document's token ids are hashed into a vector of ``BUCKETS`` counts, which is
projected to ``DIMS`` dimensions; the cell there is numbered along the Hilbert
curve.  Documents are sorted by that number (ties: a hash of the id, the id,
the text) and laid end to end; every ``SEQUENCE`` ids make one sequence, so a
document is cut only where a sequence ends and only the last sequence needs
padding.

How it runs: tokens are made once and written to the shared folder; quantiles
of the sort key cut it into slices, ``SLICES_A_TASK`` for ``TASK_TOKENS`` ids; slice totals (one
number a slice) give each slice its first position; documents are shuffled by
slice and numbered while streaming through the sorted slice.

Defined cases: null or empty text is one end id; repeated rows are packed each;
a null id is allowed and sorts first; an empty table gives no piece.
"""

from __future__ import annotations

import gc
import math
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillroll.llm.common import give_back, map_rows
from tillroll.session import shared_dir

SEQUENCE = 4096
END_ID = 2
BUCKETS = 64
DIMS = 3
BITS = 10  # per dimension of the curve
TASK_TOKENS = 32 << 20  # ids a task sorts
SLICES_A_TASK = 4
_CACHE_WORDS = 400_000  # stems and marks kept by a worker process with their ids
_BATCH_BYTES = 4 << 20  # text tokenised at once (one longer document is alone)
_words: dict = {}  # of this worker process: path -> _Words
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Words:
    """The ids of strings, kept for a bounded number of them.

    The tokenizer never joins across ASCII white space, so a text's ids are its
    words' ids in order.  Nor does it join Latin letters and the marks after
    them, so a word like ``Then,!`` is the ids of ``then`` and of ``,!``: far
    fewer different strings are tokenised than there are words."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.last = np.zeros(1 << 17, dtype=bool)  # ids that end a piece
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.last[i] = token.endswith("</w>")

    def _pieces(self, new: list[str]) -> list[bytes]:
        """The ids of strings that are one piece each: tokenised as one text, cut
        where an id ends a piece."""
        e = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.last[e]) + 1
        if len(ends) != len(new):  # not met with this tokenizer; then one by one
            return self._whole(new)
        b, cut = e.tobytes(), [0, *(4 * ends).tolist()]
        return [b[i:j] for i, j in zip(cut, cut[1:])]

    def _whole(self, new: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in got]

    def of(self, strings: list[str], whole: bool) -> list[bytes]:
        """Ids of distinct strings; ``whole``: words, not one piece each."""
        new = [x for x in strings if x not in self.known]
        if len(self.known) + len(new) > _CACHE_WORDS:  # the older half goes
            self.known = {"": b""} | dict(islice(self.known.items(), len(self.known) // 2, None))
            new = [x for x in strings if x not in self.known]
        encode = self._whole if whole else self._pieces
        for at in range(0, len(new), 20_000):
            self.known.update(zip(new[at : at + 20_000], encode(new[at : at + 20_000])))
        return list(map(self.known.__getitem__, strings))

    def ids(self, texts: list) -> list[bytes]:
        """The ids of each text as little-endian uint32."""
        return [a.tobytes() for a in self.arrays(pa.array([(t or "").encode("utf-8", "replace") for t in texts], pa.binary()).cast(pa.string()))]

    def arrays(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text: words are split, parted and numbered as
        columns, and only distinct parts are looked up."""
        words = pc.ascii_split_whitespace(texts.fill_null(""))
        bounds = words.offsets.to_numpy()
        found = words.values.dictionary_encode()
        stems, marks, one = _split(found.dictionary)
        place = np.zeros((len(one), 2), dtype=np.int64)  # of a word's two parts in the table
        table: list[bytes] = []
        for column, strings, whole in ((0, stems.filter(one), False), (0, stems.filter(pc.invert(one)), True), (1, marks, False)):
            parts = strings.dictionary_encode()
            rows = slice(None) if column else np.flatnonzero(one.to_numpy(zero_copy_only=False) != whole)
            place[rows, column] = parts.indices.to_numpy() + len(table)
            table += self.of(parts.dictionary.to_pylist(), whole)
        size = np.fromiter(map(len, table), dtype=np.int64, count=len(table)) // 4
        flat, ends = _joined(np.frombuffer(b"".join(table), dtype="<u4"), size, place.reshape(-1))
        of_word = np.diff(ends[::2])  # both parts
        ids, ends = _joined(flat, of_word, found.indices.to_numpy())
        cut = ends[bounds - bounds[0]]
        return [ids[i:j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]


def _table(path: str) -> _Words:
    """This worker process's table.  Only functions of a module see the module's
    ``_words``: what runs inside a task gets a copy of the names it uses, and
    with it a table that is loaded anew and stays until garbage is collected."""
    if path not in _words:
        _words[path] = _Words(path)
    return _words[path]


def _forget() -> None:
    _words.clear()


def _joined(flat: np.ndarray, size: np.ndarray, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``flat`` (of these sizes, one behind the other) in the order of
    ``sequence``, and where each begins and the last ends."""
    n = size[sequence]
    ends = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(n, out=ends[1:])
    shift = (np.cumsum(size) - size)[sequence] - ends[:-1]
    return flat[np.repeat(shift, n) + np.arange(ends[-1])], ends


#: Marks after a word that start no contraction and no special token.
_MARKS = ".,!?;:|*%$&#"
#: Letters whose lower case is one letter, too.
_LATIN = "^[A-Za-zªµºÀ-ÖØ-öø-įı-ɏ]+$"


def _split(words: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Words as lower-cased Latin letters and the marks after them, both one
    piece to the tokenizer (True); any other word whole (False, no marks)."""
    stems = pc.utf8_rtrim(words, characters=_MARKS)
    low = pc.utf8_lower(stems)
    one = pc.and_(pc.match_substring_regex(stems, _LATIN), pc.match_substring_regex(low, _LATIN))
    # the marks are what follows the last character that is none
    marks = pc.if_else(one, pc.replace_substring_regex(words, r"^.*[^.,!?;:|*%$&#]", ""), "")
    return pc.if_else(one, low, words), marks, one


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions of integer cells [n, dims] on the Hilbert curve (Skilling's transform)."""
    x = [c.astype(np.int64) for c in cells.T]
    for b in range(bits - 1, 0, -1):
        q = 1 << b
        for i in range(len(x)):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(on, x[0] ^ (q - 1), x[0] ^ t)
            if i:
                x[i] = x[i] ^ t
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t = np.where(x[-1] & (1 << b), t ^ ((1 << b) - 1), t)
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | ((v ^ t) >> b & 1)
    return out


def _plane() -> tuple[np.ndarray, np.ndarray]:
    """Fixed hash id -> bucket and fixed projection buckets -> dimensions."""
    rng = np.random.RandomState(20_240_101)
    return rng.randint(0, BUCKETS, size=1 << 16), rng.standard_normal((BUCKETS, DIMS))


def curve_keys(ids: list[np.ndarray], bucket: np.ndarray, plane: np.ndarray) -> np.ndarray:
    """Hilbert numbers of documents' hashed, centred and scaled vectors."""
    n = np.array([len(a) for a in ids], dtype=np.int64)
    flat = np.concatenate(ids) if len(ids) else np.zeros(0, dtype=np.uint32)
    at = np.repeat(np.arange(len(ids)) * BUCKETS, n) + bucket[flat & 0xFFFF]
    v = np.bincount(at, minlength=len(ids) * BUCKETS).reshape(-1, BUCKETS)
    v = np.where(n[:, None] > 0, v / np.maximum(n, 1)[:, None] - 1 / BUCKETS, 0.0)
    x = v @ plane / np.maximum(np.linalg.norm(v, axis=1), 1e-9)[:, None]
    cells = np.clip(((np.tanh(x) + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    return hilbert(cells, BITS)


def _runs(numbers: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of equal numbers."""
    cut = np.flatnonzero(np.diff(numbers)) + 1
    ends = [0, *cut.tolist(), len(numbers)]
    return [(i, j) for i, j in zip(ends, ends[1:]) if i < j]


def tokenised(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, key, n, ids) of ``docs`` (doc_id, text), read from a written
    table so that tokens are made once.  key: Hilbert number, then 32 bits of a
    hash of the id, so that a crowd of equal documents still spreads."""

    def run(batches):
        gc.disable()  # millions of small strings, no cycles
        try:
            yield from tokenise(batches)
        finally:
            gc.enable()

    def tokenise(batches):
        bucket, plane = _plane()
        words = _table(tokenizer)
        for b in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy()) // _BATCH_BYTES
            for at, end in _runs(sizes):
                arrays = words.arrays(b.column("text").slice(at, end - at))
                spread = b.column("spread").slice(at, end - at).to_numpy()
                yield {
                    "doc_id": b.column("doc_id").slice(at, end - at),
                    "key": curve_keys(arrays, bucket, plane) << 32 | spread,
                    "n": [len(a) + 1 for a in arrays],
                    "ids": [np.append(a, END_ID).astype("<u2" if a.max(initial=0) < 1 << 16 else "<u4").tobytes() for a in arrays],
                }
                del arrays
                pa.default_memory_pool().release_unused()  # else it keeps several groups' memory

    rows = docs.select("doc_id", "text", F.coalesce(F.xxhash64("doc_id"), F.lit(0)).bitwiseAND(F.lit(0xFFFFFFFF)).alias("spread"))
    path = shared_dir(docs.sparkSession, "packing-tokens")
    map_rows(rows, "doc_id long, key long, n long, ids binary", run).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """The pieces (``PIECES``) of all documents (doc_id, text)."""
    spark = docs.sparkSession
    rows = tokenised(docs, tokenizer)
    total = rows.agg(F.sum("n")).first()[0] or 0
    wanted = max(math.ceil(total / task_tokens), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # slice borders from the distribution of the key
    n = SLICES_A_TASK * wanted
    cuts = sorted(set(rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 10 * n)).first()[0] or []))
    border = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.expr("cast(array() as array<long>)")
    rows = rows.withColumn("slice", _rank(F.col("key"), border, len(cuts)))
    totals = {r[0]: r[1] for r in rows.groupBy("slice").agg(F.sum("n")).collect()}  # a number a slice
    first, pos = {}, 0
    for s in sorted(totals):
        first[s], pos = pos, pos + totals[s]
    schema = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])

    def run(batches):
        _forget()  # tokens are made
        now, at = None, 0
        for b in batches:
            out: list = []
            for doc, n, ids, s in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "ids", "slice"))):
                if s != now:
                    now, at = s, first[s]
                a = np.frombuffer(ids, dtype="<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                start = 0
                while start < n:
                    size = min(n - start, sequence - at % sequence)
                    out.append((doc, start, size, zlib.crc32(a[start : start + size].tobytes()), n, at // sequence, at % sequence))
                    start, at = start + size, at + size
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out)], schema=schema)

    dealt = rows.repartition(wanted, "slice").sortWithinPartitions("slice", "key", "doc_id", "ids")
    return dealt.mapInArrow(lambda batches: give_back(run(batches)), PIECES)


def _rank(key: Column, border: Column, n: int) -> Column:
    """Number of borders at or below the key, by halving."""
    steps = F.array(*[F.lit(1 << b) for b in range(n.bit_length() - 1, -1, -1)]) if n else F.expr("cast(array() as array<int>)")
    fits = lambda low, step: F.when(low + step <= n, F.get(border, low + step - 1) <= key).otherwise(False)
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(fits(low, step), low + step).otherwise(low))


def op5_pack(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
