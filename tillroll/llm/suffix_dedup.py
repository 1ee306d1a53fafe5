"""Substring deduplication by bucket-pointer refinement.

Every byte position is a suffix.  Its first bucket is named by the 16 bytes
that start there, refined from 8-byte names by the name of offset 8.  The dealt
method would go on so to 32 and ``WINDOW`` = 50 bytes over all positions; naming
every position to other machines took 1598 MB of shuffle and 2.34 GB of disk on
0.51 GB, beyond the limits.  So the last steps differ: the 16-byte names choose
anchors, and a window's name joins its anchor's name with a rolling hash of the
34 bytes beside it.  Names are 64-bit hashes, so buckets of different machines
agree without exchanging ranks, and two different strings with one name would
count as equal.  A byte goes if a window that covers it lies in a bucket with a
smaller doc_id.

Most buckets are found to be single without naming their windows to others: of
a window's 35 16-byte names the smallest is its anchor, equal windows have
equal anchors, and a first round asks only which anchors occur in several
documents (about one anchor for 18 bytes).  The second round sends, for each
place of such an anchor, those of the ``SIDE`` bytes on either side that its own
windows have; these windows are named and compared where the places meet, at
most 35 for every place sent.  A chunk's places are found once and wait beside
the questions for the answers.  Whole documents take part in the first round as
well: exact copies of a document with a smaller id need no second round.

Defined cases: null text is empty; a document shorter than a window keeps all;
documents with a null id keep all and remove nothing elsewhere; equal ids do
not remove each other's bytes; overlapping windows merge into one span; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm import chunks as C
from tillroll.llm.common import map_rows, saved

WINDOW = 50
GRAM = 16
SIDE = WINDOW - GRAM  # bytes on either side of an anchor that its windows can reach
SPAN = SIDE + 1  # 16-byte names inside a window
NOTE = 1 << 62  # with a chunk's number: the part under which its last step finds its places
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of the bucket (a, then b)."""
    x = a * _A
    x += b
    x ^= x >> np.uint64(29)
    x *= _B
    x ^= x >> np.uint64(32)
    return x


def names(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The 16-byte names of a byte string, and the anchors of its windows."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))  # 8 bytes as one number
        g16 = _join(x[:-8], x[8:])
        m, k = g16, 1
        while 2 * k <= SPAN:
            m = np.minimum(m[:-k], m[k:])
            k *= 2
        m = np.minimum(m[: n], m[SPAN - k : SPAN - k + n])
    return g16, m


def _steps(x: np.ndarray) -> np.ndarray:
    """Where runs of one value start."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))


def _smallest(g16: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Places whose 16-byte name is the anchor of a window around them."""
    x, k = np.concatenate([np.zeros(SIDE, dtype=np.uint64), m, np.zeros(SIDE, dtype=np.uint64)]), 1
    while 2 * k <= SPAN:
        x = np.maximum(x[:-k], x[k:])
        k *= 2
    return np.flatnonzero(g16 == np.maximum(x[: len(g16)], x[SPAN - k : SPAN - k + len(g16)]))


def _among(hot: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``x`` are in the sorted ``hot``, and where there."""
    at = np.searchsorted(hot, x)
    on = np.flatnonzero(hot[np.minimum(at, len(hot) - 1)] == x)
    return on, at[on]


def _counted(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """From each start on, as many numbers as its size."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _distinct(keys: list[np.ndarray]) -> np.ndarray:
    k = np.sort(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.uint64)
    return k[_steps(k)] if len(k) else k


def _digest(t: bytes) -> int:
    return xxhash.xxh64_intdigest(t, seed=WINDOW)


def _named(docs: C.Docs):
    """(position in the chunk, id, text, 16-byte names, anchors) of the documents that take part."""
    for i, (doc, t) in enumerate(zip(docs.ids.tolist(), docs.texts())):
        if doc != C.NULL_ID and len(t) >= WINDOW:
            yield i, doc, t, *names(t)


def _firsts(keys: list[np.ndarray], ids: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys (sorted), their smallest id, and whether several ids have one."""
    if not keys:
        z = np.zeros(0, dtype=np.int64)
        return z.astype(np.uint64), z, z.astype(bool)
    k = np.concatenate(keys)
    d = np.repeat(np.array(ids, dtype=np.int64), [len(x) for x in keys])
    order = np.lexsort((d, k))
    k, d = k[order], d[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    start = np.flatnonzero(new)
    last = np.concatenate([start[1:], [len(k)]]) - 1
    return k[start], d[start], d[last] != d[start]


def _asked(keys: np.ndarray, ids: np.ndarray, several: np.ndarray, kind: int, bits: int):
    """Question blobs: number of keys, keys, ids less the smallest, flags."""
    for part, at in C.pack_keys(keys, bits):
        low = int(ids[at].min())
        off = (ids[at] - low).astype(np.uint64)
        small = off.astype(np.uint32) if off.max(initial=0) < 1 << 32 else off
        head = np.array([at.stop - at.start, low, small.itemsize], dtype=np.int64).tobytes()
        by_byte = np.ascontiguousarray(small.view(np.uint8).reshape(len(small), -1).T).tobytes()
        yield kind << 32 | part, head + C.key_bytes(keys[at], bits) + C.squeeze(by_byte + np.packbits(several[at]).tobytes())


def _question(blob: bytes, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, low, size = np.frombuffer(blob[:24], dtype=np.int64).tolist()
    w = 8 - bits // 8
    rest = C.expand(blob[24 + n * w :])
    off = np.ascontiguousarray(np.frombuffer(rest[: n * size], dtype=np.uint8).reshape(size, n).T).reshape(-1).view(np.uint32 if size == 4 else np.uint64)
    several = np.unpackbits(np.frombuffer(rest[n * size :], dtype=np.uint8), count=n).astype(bool)
    return C.keys_from(blob[24 : 24 + n * w], bits), off.astype(np.int64) + low, several


def _judged(asked: list[tuple[int, bytes]], bits: int):
    """For each chunk, per key: is it shared with another document; is there a
    smaller id than the chunk's own smallest."""
    got = [_question(b, bits) for _, b in asked]
    k = np.concatenate([g[0] for g in got])
    d = np.concatenate([g[1] for g in got])
    several = np.concatenate([g[2] for g in got])
    _, at = np.unique(k, return_inverse=True)
    n = int(at.max()) + 1 if len(at) else 0
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, at, d)
    np.maximum.at(high, at, d)
    more = np.zeros(n, dtype=bool)
    more[at[several]] = True
    shared = ((high > low) | more)[at]
    smaller = (low[at]) < d
    pos = 0
    for (chunk, _), g in zip(asked, got):
        e = pos + len(g[0])
        yield chunk, C.squeeze(np.packbits(shared[pos:e]).tobytes() + np.packbits(smaller[pos:e]).tobytes())
        pos = e


def _answers(parts: dict[int, bytes], kind: int, keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The flags (shared, smaller) of a chunk's sorted keys."""
    shared, smaller = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    for part, at in C.pack_keys(keys, bits):
        b, n = C.expand(parts[kind << 32 | part]), at.stop - at.start
        half = (n + 7) // 8
        shared[at] = np.unpackbits(np.frombuffer(b[:half], dtype=np.uint8), count=n)
        smaller[at] = np.unpackbits(np.frombuffer(b[half:], dtype=np.uint8), count=n)
    return shared, smaller


def _copies(docs: C.Docs) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, int]]:
    """Digests of whole documents, as _firsts gives them, and by position."""
    own = {i: _digest(t) for i, (doc, t) in enumerate(zip(docs.ids.tolist(), docs.texts())) if doc != C.NULL_ID and len(t) >= WINDOW}
    ids = [int(docs.ids[i]) for i in own]
    return *_firsts([np.array([h], dtype=np.uint64) for h in own.values()], ids), own


def _places(t: bytes, g16: np.ndarray, m: np.ndarray, hot: np.ndarray):
    """Windows of a text whose anchor is in ``hot``: their starts, the places
    of their anchors (the first at or after the start), and for each distinct
    place a row: name, bytes to the left and right that there are, the bytes."""
    first = _steps(m)
    end = np.append(first[1:], len(m))
    run, at = _among(hot, m[first])
    first, end = first[run], end[run]
    cand = _smallest(g16, m)
    of, key = _among(hot, g16[cand])
    n = len(g16) + 1
    keys = np.sort(key * n + cand[of])
    # the windows of a run pass one place of their anchor after another
    low = np.searchsorted(keys, at * n + first)
    size = np.searchsorted(keys, at * n + end - 1) + 1 - low
    p = keys[_counted(low, size)] % n
    last = np.cumsum(size) - 1
    stop = p + 1
    stop[last] = end
    start = np.append(0, stop)[:-1]
    start[last - size + 1] = first
    on, place = _counted(start, stop - start), np.repeat(p, stop - start)
    rows = np.zeros((len(p), 10 + 2 * SIDE), dtype=np.uint8)
    rows[:, :8] = g16[p].astype(">u8").view(np.uint8).reshape(-1, 8)
    rows[:, 8] = np.minimum(p, SIDE)
    rows[:, 9] = np.minimum(len(t) - GRAM - p, SIDE)
    padded = np.frombuffer(bytes(SIDE) + t + bytes(SIDE), dtype=np.uint8)
    side = np.concatenate([np.arange(SIDE), np.arange(SIDE + GRAM, 2 * SIDE + GRAM)])
    rows[:, 10:] = padded[p[:, None] + side]
    return on, place, p, rows


def _needed(on: np.ndarray, place: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The bytes to the left and right of each place that its windows have."""
    at = np.searchsorted(place, p)
    last = np.append(at[1:], len(on)) - 1
    return np.stack([p - on[at], SIDE - p + on[last]], axis=1).astype(np.uint8)


def _second(row: dict, parts: dict[int, bytes], bits: int):
    """A chunk after round one: its distinct rows, with the bytes that no window
    has as zeros, and their smallest ids; and what round two does not change, by
    document: is it a copy of a smaller id, how many places; by place: where,
    which row, has the row a smaller id, and if so which bytes its windows have."""
    docs = C.Docs(row)
    keys, low, _, own = _copies(docs)
    _, smaller = _answers(parts, 1, keys, bits)
    gone = np.zeros(len(docs.ids), dtype=bool)
    for i, h in own.items():
        at = int(np.searchsorted(keys, np.uint64(h)))
        gone[i] = smaller[at] or docs.ids[i] > low[at]
    named = list(_named(docs))
    anchors = _distinct([x[4][_steps(x[4])] for x in named])
    shared, _ = _answers(parts, 0, anchors, bits)
    hot = anchors[shared]
    found = {}
    while named:  # the names of a document are given back once its places are known
        i, _, t, g16, m = named.pop()
        if not gone[i] and len(hot) and len((x := _places(t, g16, m, hot))[0]):
            found[i] = x[2], x[3], _needed(*x[:3])
    order = sorted(found, key=lambda i: docs.ids[i])
    count = np.zeros(len(docs.ids), dtype=np.int64)
    count[order] = [len(found[i][0]) for i in order]
    rows = np.concatenate([found[i][1] for i in order]) if order else np.zeros((0, 10 + 2 * SIDE), dtype=np.uint8)
    if order:
        rows[:, 8:10] = np.concatenate([found[i][2] for i in order])
    rows[:, 10 : 10 + SIDE] *= np.arange(SIDE, 0, -1) <= rows[:, 8:9]
    rows[:, 10 + SIDE :] *= np.arange(SIDE) < rows[:, 9:10]
    ids = np.repeat(docs.ids[order], count[order])
    _, first, at = np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").reshape(-1), return_index=True, return_inverse=True)
    p = np.concatenate([found[i][0] for i in order]) if order else np.zeros(0, dtype=np.int64)
    less = ids[first][at] < ids
    return rows[first], ids[first], (gone, np.array(order, dtype=np.uint32), count, p, at, less, rows[less, 8:10])


def _by_byte(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def _from_bytes(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a.T).view("<u4").reshape(-1)


def _note(rows: np.ndarray, known: tuple, bits: int) -> bytes:
    """What the chunk's last step takes from ``_second``."""
    gone, order, count, p, at, less, needed = known
    parts = C.pack_keys(_keys(rows), bits)
    of = np.array([part for part, _ in parts], dtype=np.int64)
    sizes = np.array([x.stop - x.start for _, x in parts], dtype=np.int64)
    out = io.BytesIO()
    for a in (gone, order, count, _by_byte(np.diff(p, prepend=0)), _by_byte(at), np.packbits(less), needed, of, sizes):
        np.save(out, a, allow_pickle=False)
    return C.squeeze(out.getvalue())


def _noted(blob: bytes) -> tuple:
    f = io.BytesIO(C.expand(blob))
    gone, order, count, p, at, less, needed, of, sizes = (np.load(f, allow_pickle=False) for _ in range(9))
    p, at = np.cumsum(_from_bytes(p), dtype=np.uint32).astype(np.int64), _from_bytes(at)
    return gone, order, count, p, at, np.unpackbits(less, count=len(at)).astype(bool), needed, of, sizes


def _keys(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows[:, :8]).view(">u8").reshape(-1).astype(np.uint64)


def _sides(rows: np.ndarray, ids: np.ndarray, bits: int):
    """Questions of round two: (part, blob) of sorted distinct rows."""
    keys = _keys(rows)
    for part, at in C.pack_keys(keys, bits):
        n, low = at.stop - at.start, int(ids[at].min())
        head = np.array([n, low], dtype=np.int64).tobytes()
        off = np.ascontiguousarray((ids[at] - low).view(np.uint8).reshape(n, 8).T).tobytes()
        yield 2 << 32 | part, head + C.key_bytes(keys[at], bits) + C.squeeze(off + rows[at, 8:10].T.tobytes() + rows[at, 10:].tobytes())


def _windows(asked: list[tuple[int, bytes]], bits: int):
    """To each chunk, for each of its rows and each window around the anchor:
    does a document with a smaller id than the row's have the window."""
    keys, ids, left, right, sides, sizes = [], [], [], [], [], []
    for _, b in asked:
        n, low = np.frombuffer(b[:16], dtype=np.int64).tolist()
        w = (8 - bits // 8) * n
        keys.append(C.keys_from(b[16 : 16 + w], bits))
        rest = np.frombuffer(C.expand(b[16 + w :]), dtype=np.uint8)
        ids.append(np.ascontiguousarray(rest[: 8 * n].reshape(8, n).T).reshape(-1).view(np.int64) + low)
        left.append(rest[8 * n : 9 * n])
        right.append(rest[9 * n : 10 * n])
        sides.append(rest[10 * n :].reshape(n, 2 * SIDE))
        sizes.append(n)
    k, d, lo, hi = np.concatenate(keys), np.concatenate(ids), np.concatenate(left), np.concatenate(right)
    side = np.concatenate(sides).T.copy()  # byte by byte
    del sides, keys, ids, left, right
    flags = np.zeros((len(k), SIDE + 1), dtype=bool)
    with np.errstate(over="ignore"):
        power, inverse = (np.uint64(pow(int(_A), e, 1 << 64)) for e in (SIDE, -1))
        # the name of the 34 bytes that a window has beside its anchor: a sum
        # over them, moved on by one byte for every offset
        total = np.zeros(len(k), dtype=np.uint64)
        for i in range(SIDE):
            total = total * _A + side[SIDE + i] + np.uint64(1)
        for o in range(SIDE + 1):  # the window starts o bytes before the anchor
            if o:  # a byte comes in on the left, one goes on the right
                total = (total - side[2 * SIDE - o] - np.uint64(1)) * inverse + (side[SIDE - o] + np.uint64(1)) * (power * inverse)
            on = np.flatnonzero((lo >= o) & (hi >= SIDE - o))
            if len(on) < 2:
                continue
            name = _join(k[on] * _B + np.uint64(o), total[on])
            order = np.argsort(name, kind="stable")
            start = np.flatnonzero(np.concatenate([[True], name[order][1:] != name[order][:-1]]))
            least = np.repeat(np.minimum.reduceat(d[on][order], start), np.diff(np.concatenate([start, [len(on)]])))
            flags[on[order], o] = least < d[on][order]
    pos = 0
    for (chunk, _), n in zip(asked, sizes):
        yield chunk, C.squeeze(np.packbits(flags[pos : pos + n], axis=1).T.tobytes())
        pos += n


def _flags(parts: dict[int, bytes], of: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The answers of round two for a chunk's rows."""
    out = np.zeros((int(sizes.sum()), SPAN), dtype=bool)
    pos = 0
    for part, n in zip(of.tolist(), sizes.tolist()):
        b = np.frombuffer(C.expand(parts[2 << 32 | part]), dtype=np.uint8).reshape(-1, n).T
        out[pos : pos + n] = np.unpackbits(b, axis=1, count=SPAN)
        pos += n
    return out


def _spans(starts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by windows at sorted starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > WINDOW)
    a = np.concatenate([[0], cut + 1])
    b = np.concatenate([cut, [len(starts) - 1]])
    return [(int(starts[i]), int(starts[j]) + WINDOW) for i, j in zip(a, b)]


def _repeated(parts: dict[int, bytes], note: bytes) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]]]:
    """By position in the chunk: is the document a copy of a smaller id; the
    runs covered by windows that a smaller id has."""
    gone, order, count, p, at, less, needed, of, sizes = _noted(note)
    o = np.arange(SIDE, -1, -1)  # a window starts o bytes before its place
    flags = _flags(parts, of, sizes)[:, ::-1][at]
    flags[less] |= (o <= needed[:, :1]) & (SIDE - o <= needed[:, 1:])
    spans, e = {}, 0
    for i in order.tolist():
        b, e = e, e + int(count[i])
        place, c = np.nonzero(flags[b:e])
        spans[i] = _spans(p[b:e][place] - o[c])
    return gone, spans


def deduplicate(docs: DataFrame, chunk_bytes: int = C.CHUNK_BYTES) -> DataFrame:
    """``RESULT`` for every row of ``docs`` (doc_id, text): counts, the hash of
    what is kept, and the byte spans removed."""
    chunks = C.write_chunks(docs.select("doc_id", "text", F.lit(0).alias("kind")), chunk_bytes)
    bits = C.part_bits(chunks)

    def first_round(row):
        d = C.Docs(row)
        named = [(m[_steps(m)], doc) for _, doc, _, _, m in _named(d)]
        keys, _, several = _firsts([m for m, _ in named], [doc for _, doc in named])
        # an anchor only asks whether others have it: the chunk stands for its documents
        yield from _asked(keys, np.full(len(keys), row["chunk"]), several, 0, bits)
        yield from _asked(*_copies(d)[:3], 1, bits)

    anchors = C.ask(chunks, first_round, lambda part, asked: _judged(asked, bits))

    def second_round(row, parts):
        rows, ids, known = _second(row, parts, bits)
        got = [*_sides(rows, ids, bits), (NOTE | row["chunk"], _note(rows, known, bits))]
        return {"part": [p for p, _ in got], "chunk": [row["chunk"]] * len(got), "blob": [b for _, b in got]}

    def reply(batches):
        for g in C.grouped(C.rows_of(batches), "part"):
            got = [(r["chunk"], r["blob"]) for r in g]
            if g[0]["part"] < NOTE:
                got = list(_windows(got, bits))
            yield {"part": [g[0]["part"]] * len(got), "chunk": [c for c, _ in got], "blob": [b for _, b in got]}

    sent = C.meet(chunks, anchors, C.ASKED, second_round).repartition("part").sortWithinPartitions("part", "chunk")
    windows = saved(map_rows(sent, C.ASKED, reply), "answers")

    def last(row, parts):
        d = C.Docs(row)
        gone, repeated = _repeated(parts, parts[NOTE | row["chunk"]])
        out: dict = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
        for i, (doc, t) in enumerate(zip(d.ids.tolist(), d.texts())):
            spans = [(0, len(t))] if gone[i] else repeated.get(i, [])
            kept, pos = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(t[pos:a])
                pos = b
            kept.update(t[pos:])
            row_out = (None if doc == C.NULL_ID else doc, len(t), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [{"start": a, "end": b} for a, b in spans])
            for col, v in zip(out.values(), row_out):
                col.append(v)
        return out

    return C.meet(chunks, windows, RESULT, last)


def op9_suffix_dedup(docs: DataFrame) -> DataFrame:
    return deduplicate(docs.select("doc_id", "text")).drop("spans")
