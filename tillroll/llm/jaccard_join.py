"""N-gram Jaccard self-join with chosen paths.

A document is the set of its 5-word shingles.  Sets are embedded by ``T``
min-hash coordinates; two sets agree on a coordinate with the probability of
their Jaccard similarity.  A run starts every set at one root; at a node each
coordinate is chosen with probability 1 / (LAMBDA * T) by a hash of the path,
so all sets at a node choose the same ones, and a set moves to the children
named by (coordinate, its value).  Sets that share a path of ``DEPTHS[0]``
choices meet in a bucket.  Small buckets are brute-forced; larger ones are
split further, down to ``DEPTHS[-1]``; what is still large there (sets that
agree on that many coordinates) is dealt into blocks that all hold the bucket's
first set, and sets of different blocks that are in no common group by then are
compared block by block, each pair of blocks one unit of work.  Runs are
repeated until a pair at the threshold meets at the last depth and passes the
estimate with probability ``RECALL``; all runs choose among the same
coordinates, so that probability is the mean over how many of them agree.

Brute force on the coordinates links candidates (estimate at least
``ESTIMATE``).  Their groups are then compared exactly on whole shingle sets,
in blocks of ``BLOCK`` sets, each pair of blocks one unit of work, so that a
group of any size spreads over tasks; only counts and each set's link to the
smallest set of its part leave a block pair, never all pairs.  Equal sets are one set
from the start (``copies``).

Defined cases: a text of fewer than 5 words is one shingle of all its words;
null, empty or white-space texts have no shingle, link to nothing and are
classes of their own; a null id gets a null class and no links; rows with the
same id and text count as copies (of an id with several texts one stands for
the others in exact comparisons); other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import map_rows, saved

WORDS = 5
THRESHOLD = 0.8
T = 64
LAMBDA = 0.8
DEPTHS = (4, 8)
SMALL = 512
RECALL = 0.995
ESTIMATE = 0.65
BLOCK = 256
BLOCK_SHINGLES = 1 << 20
BROADCAST_ROWS = 1_000_000  # rows of 16 bytes sent to all tasks; beyond, a join
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    w = (text or "").encode("utf-8", "surrogatepass").split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), seed=words)], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), dtype=np.uint64, count=len(w))
    n = len(w) - words + 1
    with np.errstate(over="ignore"):
        s = np.zeros(n, dtype=np.uint64)
        for k in range(words):
            s = s * _M1 + h[k : k + n]
        return np.unique(_mix(s))


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.RandomState(97)
    a = rng.randint(0, 1 << 62, size=T, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.randint(0, 1 << 62, size=T, dtype=np.int64).astype(np.uint64)


def signature(s: np.ndarray, seeds) -> np.ndarray:
    """The ``T`` min-hash coordinates (uint32) of a non-empty set."""
    a, b = seeds
    out = np.full(T, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 4096):
            x = s[at : at + 4096, None] * a + b
            out = np.minimum(out, (x ^ (x >> np.uint64(32))).min(axis=0))
        return (_mix(out) >> np.uint64(32)).astype(np.uint32)


def _meets(agree: int, depths=DEPTHS) -> float:
    """Probability that two sets which agree on ``agree`` of the coordinates
    share a path to the last depth in one run."""
    q = 0.0
    for _ in range(depths[-1]):
        q = (1 - 1 / (LAMBDA * T) * (1 - q)) ** agree
    return 1 - q


def expected_recall(n: int, depths=DEPTHS, sim: float = THRESHOLD) -> float:
    """Probability that a pair at the threshold meets in one of ``n`` runs and
    passes the estimate: the mean over the coordinates it agrees on, which all
    runs share."""
    at = lambda k: math.comb(T, k) * sim**k * (1 - sim) ** (T - k)
    return sum(at(k) * (1 - (1 - _meets(k, depths)) ** n) for k in range(math.ceil(ESTIMATE * T), T + 1))


def runs(recall: float = RECALL) -> int:
    n = 1
    while expected_recall(n) < recall:
        if expected_recall(2 * n) - expected_recall(n) < 1e-12:
            raise ValueError(f"a recall of {recall} is beyond {T} coordinates with an estimate of {ESTIMATE}")
        n += 1
    return n


def _survival(recall: float = RECALL) -> float:
    """The chance of one run if the runs were independent and had the same recall."""
    n = runs(recall)
    return 1 - (1 - expected_recall(n)) ** (1 / n)


def grow(sig: np.ndarray, row: np.ndarray, key: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Paths (row of sig, key) after ``steps`` more choices."""
    odd = np.arange(1, T + 1, dtype=np.uint64) * _M1
    limit = np.uint64(int(1 / (LAMBDA * T) * float(1 << 63)) * 2)
    with np.errstate(over="ignore"):
        for _ in range(steps):
            rows, keys = [], []
            for at in range(0, len(row), 1 << 14):
                r, k = row[at : at + (1 << 14)], key[at : at + (1 << 14)]
                i, c = np.nonzero(_mix(k[:, None] ^ odd) < limit)
                rows.append(r[i])
                keys.append(_mix(_mix(k[i] + odd[c]) ^ sig[r[i], c].astype(np.uint64)))
            row = np.concatenate(rows) if rows else row
            key = np.concatenate(keys) if keys else key
    return row, key


def _groups(batches, key: str):
    """Rows of sorted batches (as {column: list}) group by group."""
    held: dict | None = None
    for b in batches:
        now = b.to_pydict()
        if held:
            now = {c: held[c] + v for c, v in now.items()}
        k = now[key]
        at = 0
        for i in range(1, len(k)):
            if k[i] != k[at]:
                yield {c: v[at:i] for c, v in now.items()}
                at = i
        held = {c: v[at:] for c, v in now.items()}
    if held and held[key]:
        yield held


def _stars(link: np.ndarray) -> list[tuple[int, int]]:
    """(member, smallest position of its connected part) of a boolean matrix,
    for all members but the smallest.  Sets that meet in many buckets mostly
    meet with the same smallest set, so few different links are left."""
    left, out = set(range(len(link))), []
    while left:
        seen, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            seen.add(x)
            more = [int(y) for y in np.flatnonzero(link[x]) if y in left]
            left.difference_update(more)
            todo += more
        first = min(seen)
        out += [(x, first) for x in sorted(seen) if x != first]
    return out


def _signed(docs: DataFrame) -> DataFrame:
    """(doc_id, hi, lo, n, sig) of every document; hi, lo: a 128-bit digest of its set."""

    def run(batches):
        seeds = _seeds()
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            out: dict = {"doc_id": ids, "hi": [], "lo": [], "n": [], "sig": []}
            for t in texts:
                s = shingles(t)
                d = xxhash.xxh128_intdigest(s.tobytes())
                out["hi"].append((d >> 64) - (1 << 63))
                out["lo"].append((d & ((1 << 64) - 1)) - (1 << 63))
                out["n"].append(len(s))
                out["sig"].append(signature(s, seeds).tobytes() if len(s) else b"")
            yield out

    return map_rows(docs.select("doc_id", "text"), "doc_id long, hi long, lo long, n long, sig binary", run)


def _paths(reps: DataFrame, steps: int, first: int) -> DataFrame:
    """(key, rep) after ``steps`` choices; from the roots of ``first`` runs, or
    from the ``key`` that the rows have (first = 0)."""

    def run(batches):
        for b in batches:
            rep = b.column("rep").to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, T)
            for at in range(0, len(rep), 2048):
                n = len(rep[at : at + 2048])
                row = np.arange(n)
                if first:
                    root = _mix(np.arange(1, first + 1, dtype=np.uint64) * _M2)
                    row, key = np.repeat(row, first), np.tile(root, n)
                else:
                    key = b.column("key").to_numpy(zero_copy_only=False)[at : at + n].view(np.uint64)
                row, key = grow(sig[at : at + n], row, key, steps)
                yield {"key": key.view(np.int64), "rep": rep[at : at + n][row]}

    return map_rows(reps, "key long, rep long", run)


def small(df: DataFrame) -> DataFrame:
    """Broadcast if it has at most BROADCAST_ROWS rows, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _bucket_links(members: DataFrame, reps: DataFrame) -> DataFrame:
    """Candidate links (a, b) inside buckets of (key, rep).  Coordinates are
    compared by their low bytes, so only these are sent to the buckets."""
    low = F.concat(*[F.substring("sig", 4 * c + 1, 1) for c in range(T)])
    rows = members.join(reps.select("rep", low.alias("low")), "rep")

    def run(batches):
        for g in _groups(batches, "key"):
            rep = np.array(g["rep"], dtype=np.int64)
            if len(rep) < 2:
                continue
            s = np.frombuffer(b"".join(g["low"]), dtype=np.uint8).reshape(-1, T)
            same = np.zeros((len(rep), len(rep)), dtype=np.int16)
            for c in range(T):
                same += s[:, c, None] == s[None, :, c]
            got = _stars(same >= ESTIMATE * T)
            if got:
                yield {"a": [int(rep[i]) for i, _ in got], "b": [int(rep[j]) for _, j in got]}

    dealt = rows.repartition("key").sortWithinPartitions("key", "rep")
    return map_rows(dealt, "a long, b long", run).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def candidate_links(reps: DataFrame, recall: float = RECALL, small: int = SMALL) -> DataFrame:
    """Candidate links (a, b) between the sets of ``reps`` (rep, sig)."""
    found, hot = [], None
    paths = saved(_paths(reps, DEPTHS[0], runs(recall)), "chosen-paths")
    for level, depth in enumerate(DEPTHS):
        size = paths.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("first")).where("size > 1")
        members = paths.join(size, "key")
        last = level + 1 == len(DEPTHS)
        if last:  # deal large buckets into blocks that all hold the first set
            k = F.ceil(F.col("size") / small).cast("int")
            block = lambda i: F.xxhash64("key", i)
            own = members.select(F.when(F.col("size") <= small, F.col("key")).otherwise(block(F.pmod(F.xxhash64("rep"), k).cast("int"))).alias("key"), "rep")
            pivots = size.where(F.col("size") > small).select("key", "first", F.explode(F.sequence(F.lit(0), k - 1)).alias("i"))
            found.append(_bucket_links(own.union(pivots.select(block(F.col("i")), "first")).distinct(), reps))
            hot = members.where(F.col("size") > small).select("key", "rep").distinct()
        else:
            found.append(_bucket_links(members.where(F.col("size") <= small).select("key", "rep"), reps))
            large = members.where(F.col("size") > small).select("key", "rep").join(reps.select("rep", "sig"), "rep")
            paths = saved(_paths(large, DEPTHS[level + 1] - depth, 0), "chosen-paths")
    links = found[0]
    for f in found[1:]:
        links = links.union(f)
    links = links.distinct()
    if not hot.limit(1).count():
        return links
    links = saved(links, "block-links")
    return links.union(_bucket_links(_across(hot, components(links), small), reps)).distinct()


def _across(hot: DataFrame, classes: DataFrame, small: int) -> DataFrame:
    """(key, rep) of the pairs of blocks that hold every pair of sets of a
    bucket of ``hot`` (key, rep) which is in no common class (v, class).  The
    sets of a bucket's largest class are only paired with the other sets, so a
    bucket of one class costs nothing."""
    placed = saved(hot.join(classes.withColumnRenamed("v", "rep"), "rep", "left").select("key", "rep", F.coalesce("class", "rep").alias("class")), "hot-classes")
    size = placed.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"))
    mixed = size.groupBy("key").agg(F.max(F.struct("n", "class")).alias("top"), F.sum("n").alias("m")).where("m > top.n")
    blocks = lambda n: F.ceil(n / small).cast("int")
    mixed = mixed.select("key", F.col("top.class").alias("top"), blocks(F.col("top.n")).alias("nt"), blocks(F.col("m") - F.col("top.n")).alias("no"))
    rows = placed.join(mixed, "key").withColumn("in_top", F.col("class") == F.col("top"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.when(F.col("in_top"), F.col("nt")).otherwise(F.col("no"))).cast("int"))
    # Blocks of the largest class are numbered -1, -2, ...
    top = F.transform(F.sequence(F.lit(0), F.col("no") - 1), lambda j: F.struct((-1 - F.col("block")).alias("i"), j.alias("j")))
    rest = F.transform(F.sequence(-F.col("nt"), F.col("no") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("i"), F.greatest(j, F.col("block")).alias("j")))
    units = rows.select("key", "rep", F.explode(F.when(F.col("in_top"), top).otherwise(rest)).alias("p"))
    return units.select(F.xxhash64("key", F.lit("pair"), "p.i", "p.j").alias("key"), "rep")


def components(links: DataFrame) -> DataFrame:
    """(v, class): the smallest id reachable over links (a, b), for every id
    with a link.  Labels spread along the links until none changes; each round
    is written, so a lost executor costs one round."""
    both = saved(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("class"), F.lit(True).alias("new")), "labels")
    while labels.where("new").limit(1).count():
        told = both.join(labels.select(F.col("v").alias("b"), "class", "new").where("new").drop("new"), "b").groupBy(F.col("a").alias("v")).agg(F.min("class").alias("m"))
        step = labels.drop("new").join(told, "v", "left")
        labels = saved(step.select("v", F.least("class", "m").alias("class"), F.coalesce(F.col("m") < F.col("class"), F.lit(False)).alias("new")), "labels")
    return labels.drop("new")


def _pair_matrix(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs of sorted sets."""
    m = len(sets)
    if m <= 4:
        out = np.zeros((m, m), dtype=np.int64)
        for i in range(m):
            for j in range(i + 1, m):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n > 1
    col = (np.cumsum(shared) - 1)[at]
    on = shared[at]
    owner, col = owner[on], col[on]
    out = np.zeros((m, m), dtype=np.float64)
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    step = max(1024, (1 << 22) // m)
    total = int(shared.sum())
    for lo in range(0, total, step):
        i, j = np.searchsorted(col, (lo, lo + step))
        x = np.zeros((m, min(step, total - lo)), dtype=np.float32)
        x[owner[i:j], col[i:j] - lo] = 1
        out += x @ x.T
    return np.rint(out).astype(np.int64)


def _verified(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(rep, links, mate) of exact comparisons within ``members`` (rep, class,
    copies, n): per block pair, the linked documents of a set and the
    smallest set of its part there (null for itself)."""
    size = members.groupBy("class").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w")).where("m > 1")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("w") / BLOCK_SHINGLES)).cast("int")
    placed = members.join(size, "class").select("rep", "class", "copies", blocks.alias("nb"))
    placed = saved(placed.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int")), "placed")
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(small(placed), "rep")
    pairs = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("i"), F.greatest(j, F.col("block")).alias("j")))

    def to_sets(batches):
        for b in batches:
            got = {c: b.column(c).to_pylist() for c in ("rep", "class", "copies", "nb", "block")}
            yield got | {"set": [shingles(t).tobytes() for t in b.column("text").to_pylist()]}

    sets = map_rows(texts, "rep long, class long, copies long, nb int, block int, set binary", to_sets)
    work = sets.select("rep", "copies", "block", "set", "class", F.explode(pairs).alias("p")).select("rep", "copies", "block", "set", "p.i", "p.j", F.xxhash64("class", "p.i", "p.j").alias("unit"), "class")

    def run(batches):
        for g in _groups(batches, "unit"):
            once = [k for k, r in enumerate(g["rep"]) if not k or r != g["rep"][k - 1]]  # repeated rows
            if len(once) < 2:
                continue
            g = {c: [v[k] for k in once] for c, v in g.items()}
            s = [np.frombuffer(x, dtype=np.uint64) for x in g["set"]]
            n = np.array([len(x) for x in s])
            inter = _pair_matrix(s)
            link = inter >= THRESHOLD * (n[:, None] + n[None, :] - inter) - 1e-9
            cls, block = np.array(g["class"]), np.array(g["block"])
            link &= cls[:, None] == cls[None, :]
            if g["i"][0] != g["j"][0]:
                link &= block[:, None] != block[None, :]
            np.fill_diagonal(link, False)
            count = link @ np.array(g["copies"], dtype=np.int64)
            rep = np.array(g["rep"], dtype=np.int64)
            mate = dict(_stars(link))
            on = np.flatnonzero(count)
            if len(on):
                yield {"rep": rep[on], "links": count[on], "mate": [int(rep[mate[i]]) if i in mate else None for i in on.tolist()]}

    dealt = work.repartition("unit").sortWithinPartitions("unit", "rep")
    return map_rows(dealt, "rep long, links long, mate long", run)


def jaccard_classes(docs: DataFrame, recall: float = RECALL, small: int = SMALL) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): class_id (smallest id
    linked directly or through others) and n_links (other documents with a
    similarity of ``THRESHOLD`` or more)."""
    signed = saved(_signed(docs), "signed")
    sets = signed.where("doc_id is not null and n > 0").groupBy("hi", "lo")
    reps = saved(sets.agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig")), "reps")
    near = components(candidate_links(reps, recall, small)).withColumnRenamed("v", "rep")
    members = near.join(reps.select("rep", "copies", "n"), "rep")
    found = saved(_verified(docs, members), "verified")
    classes = components(found.where("mate is not null").select(F.col("rep").alias("a"), F.col("mate").alias("b"))).withColumnRenamed("v", "rep")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    result = reps.select("hi", "lo", "rep", "copies").join(classes.join(counts, "rep"), "rep", "left").select("hi", "lo", F.coalesce("class", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rows = signed.select("doc_id", "n", "hi", "lo")
    linked = rows.where("doc_id is not null and n > 0").join(result, ["hi", "lo"]).select("doc_id", "class_id", "n_links")
    alone = rows.where("doc_id is null or n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.union(alone)


def op2_jaccard_join(docs: DataFrame) -> DataFrame:
    return jaccard_classes(docs.select("doc_id", "text"))
