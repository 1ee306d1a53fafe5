"""Phrase collocation mining with broadcast double-array tries.

Texts become chunks of word numbers, written once.  Level by level, as in
Apriori, a phrase can only be frequent if its parts are:

1. words are counted exactly; those with ``min_count`` set bits in a bitmap of
   fixed size (``BITS``), which is broadcast;
2. pairs of such words go by their words' hashes into buckets.  A bucket's sum
   is an upper bound of each of its pairs, so the pairs of buckets with
   ``min_count`` are the candidates of two words, and set a second bitmap;
3. the same for three words whose two pairs have their bits set.

False bits and shared buckets add candidates, they drop none.  The candidates
are dealt by hash over shards of about ``SHARD`` phrases.  A task builds the
double-array trie of a shard (language, then words); the tries are broadcast
one after the other.  numpy advances all positions of a chunk at once, one word
a level, and counts the accepting states by ``bincount``; the counts of all
tasks are summed.  These sums are the phrases' counts: exact, by the words
themselves.  Scores and drops are joins and groupings over the phrases.

A chunk holds at most ``CHUNK_WORDS`` words to start at (a longer text goes on
in further chunks, which overlap by two words), a trie about ``SHARD`` phrases,
a bitmap ``BITS`` bits, whatever the corpus holds.

Defined cases: null text is empty, an empty one has no words; a null ``lang``
is ``und``; repeated rows count as often as they occur; ties go by the
contract (score, count, bytes of the phrase); very long texts are cut into
chunks, very long words are words like others; an empty table gives no rows;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillroll.llm.chunks import expand, rows_of, squeeze
from tillroll.llm.common import map_rows, saved
from tillroll.llm.tries import DoubleArray
from tillroll.session import shared_dir

MIN_COUNT = 10
KEPT = 2000  # rows a language
COVER = 50  # a phrase goes if a longer one has this per cent of its count
SHARD = 1 << 20  # phrases of a trie
BITS = 1 << 26  # of a bitmap: 8 MB
CHUNK_WORDS = 400_000
HELD_BYTES = 16 << 20  # text held by a task before its chunks are cut
BREAK = b"\xff"  # in no UTF-8 text
# A-Z to a-z; the ends of pieces to BREAK.
_FOLD = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
CHUNK = "lang string, chunk long, n_starts long, n_words long, words binary, tokens binary"


def _cut(lang: str, texts: list[bytes], name) -> dict:
    """Chunks of texts of one language: distinct words and the text as their
    numbers (from 1; 0 between pieces)."""
    numbers = defaultdict(count(1).__next__)
    numbers[BREAK] = 0
    data = BREAK.join(t.translate(_FOLD) for t in texts).replace(BREAK, b" \xff ").split()
    tokens = np.fromiter(map(numbers.__getitem__, data), dtype=np.int32, count=len(data))
    words = list(numbers)[1:]
    out = {k.split()[0]: [] for k in CHUNK.split(", ")}
    for at in range(0, len(tokens), CHUNK_WORDS):
        part = tokens[at : at + CHUNK_WORDS + 2]
        starts = min(CHUNK_WORDS, len(part))
        if len(tokens) > CHUNK_WORDS:  # its own words only
            used, part = np.unique(np.append(part, 0), return_inverse=True)
            part, own = part[:-1].astype(np.int32), [words[i - 1] for i in used[1:].tolist()]
        else:
            own = words
        row = (lang, name(), starts, int((part[:starts] > 0).sum()), squeeze(b" ".join(own)), squeeze(part.tobytes()))
        for k, v in zip(out, row):
            out[k].append(v)
    return out


def write_chunks(docs: DataFrame) -> DataFrame:
    """The texts of ``docs`` (text, lang) as chunks, written."""

    def run(batches):
        task, seq = TaskContext.get().partitionId(), count()
        name = lambda: task << 32 | next(seq)
        held, size, total = defaultdict(list), defaultdict(int), 0
        for b in batches:
            for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                if not t:
                    continue
                held[lang].append(t)
                size[lang] += len(t)
                total += len(t)
                if size[lang] >= 2 << 20:
                    total -= size.pop(lang)
                    yield _cut(lang, held.pop(lang), name)
                elif total >= HELD_BYTES:  # many languages
                    for k in list(held):
                        yield _cut(k, held.pop(k), name)
                    size.clear()
                    total = 0
        for k in list(held):
            yield _cut(k, held.pop(k), name)

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    return saved(map_rows(rows, CHUNK, run), "phrase-chunks")


class _Chunk:
    def __init__(self, row: dict):
        self.lang, self.starts = row["lang"], row["n_starts"]
        self.words = [b"", *expand(row["words"]).split(b" ")]
        self.tokens = np.frombuffer(expand(row["tokens"]), dtype=np.int32)

    def hashes(self) -> np.ndarray:
        """``word_hash`` of every word."""
        seed = xxhash.xxh64_intdigest(self.lang.encode(), seed=42)
        return np.fromiter((xxhash.xxh64_intdigest(w, seed=seed) & 0xFFFFFFFF for w in self.words), dtype=np.int64, count=len(self.words))

    def grams(self, n: int) -> np.ndarray:
        """Word numbers of the ``n`` tokens from every start (0 behind the end)."""
        padded = np.concatenate([self.tokens, np.zeros(n, dtype=np.int32)]).astype(np.int64)
        return np.stack([padded[k : k + self.starts] for k in range(n)])


def word_hash() -> Column:
    """The low 32 bits of a hash of the language and the word: buckets may hold
    several phrases, so the hash may be short, and rows of two fit a number."""
    return F.xxhash64("lang", "word").bitwiseAND(F.lit(0xFFFFFFFF))


def word_counts(chunks: DataFrame) -> DataFrame:
    """(lang, word, n) of all words."""

    def run(batches):
        for r in rows_of(batches):
            c = _Chunk(r)
            n = np.bincount(c.tokens[: c.starts], minlength=len(c.words))
            n[0] = 0
            seen = np.flatnonzero(n)
            yield {"lang": [c.lang] * len(seen), "word": [c.words[i] for i in seen.tolist()], "n": n[seen]}

    return map_rows(chunks, "lang string, word binary, n long", run).groupBy("lang", "word").agg(F.sum("n").alias("n"))


def bitmap(df: DataFrame, hashes: Column) -> np.ndarray:
    """Bits set at the hashes, as bytes; at most ``BITS / 8`` reach the driver."""
    at = df.select((F.pmod(hashes, F.lit(BITS)) + 1).alias("at"))  # the functions below count from 1
    at = at.select(F.bitmap_bucket_number("at").alias("block"), F.bitmap_bit_position("at").alias("bit"))
    out = np.zeros(BITS // 8, dtype=np.uint8)
    for r in at.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        b = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        out[(r["block"] - 1) * len(b) :][: len(b)] = b
    return out


def _set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & (BITS - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A place in a bitmap for a pair of word hashes; ``_mix_column`` is the same in Spark."""
    return a ^ (b >> 6)


def _mix_column(a: str, b: str) -> Column:
    return F.col(a).bitwiseXOR(F.shiftright(b, 6))


def bucket_sums(chunks: DataFrame, bits: list, n: int) -> DataFrame:
    """(h0, .., n): occurrences of ``n`` words whose bits are set, by the words'
    hashes, which hold the language (an upper bound for each phrase of the
    bucket).  Two hashes travel as one number.

    ``bits``: broadcast bitmaps, of the frequent words and, for three words,
    of the candidate pairs."""
    keys = ["h01", "h2"][: n - 1]

    def run(batches):
        for r in rows_of(batches):
            c = _Chunk(r)
            h = c.hashes()
            known = _set(bits[0].value, h)
            known[0] = False
            g = c.grams(n)
            ok = np.logical_and.reduce([known[x] for x in g])
            if n > 2:
                pair = _set(bits[1].value, _mix(h[g[0]], h[g[1]])) & ok
                ok = pair & _set(bits[1].value, _mix(h[g[1]], h[g[2]]))
            g = g[:, ok]
            own, g = np.unique(g, return_inverse=True)  # a dense numbering keeps the codes in 64 bits
            g = g.reshape(n, -1)
            code = g[0]
            for x in g[1:]:
                code = code * len(own) + x
            _, first, times = np.unique(code, return_index=True, return_counts=True)
            found = [h[own[x[first]]] for x in g]
            yield {"n": times, "h01": found[0] << 32 | found[1], "h2": found[-1]}

    sums = map_rows(chunks, "n int, " + ", ".join(f"{k} long" for k in keys), run).groupBy(*keys).agg(F.sum("n").alias("n"))
    parts = [F.shiftrightunsigned("h01", 32).alias("h0"), F.col("h01").bitwiseAND(F.lit(0xFFFFFFFF)).alias("h1"), *keys[1:]]
    return sums.select(*parts, "n")


def _named(found: DataFrame, words: DataFrame, n: int) -> DataFrame:
    """Hashes back to words.  Words that share a hash all come back."""
    for k in range(n):
        on = ["lang", f"h{k}"] if k else ["h0"]
        found = found.join(words.select("lang", F.col("h").alias(f"h{k}"), F.col("word").alias(f"w{k}")), on)
    return found


PHRASE = "shard int, lang string, w0 binary, w1 binary, w2 binary"


def write_tries(candidates: DataFrame, shard: int) -> tuple[DataFrame, int]:
    """Rows (shard, lang, w0, w1, w2, idx, trie): the phrases of each shard and,
    with ``idx`` -1, its trie; and the number of shards."""
    n = max(1, math.ceil(candidates.count() / shard))

    def build(t: pa.Table) -> pa.Table:
        columns = [t.column(c).combine_chunks() for c in ("w0", "w1", "w2")]
        words = pc.unique(pa.chunked_array(columns)).drop_null()
        langs = pc.unique(t.column("lang")).drop_null()
        # the languages' symbols follow the words'
        paths = [pc.index_in(t.column("lang"), value_set=langs).to_numpy() + len(words)]
        paths += [pc.fill_null(pc.index_in(c, value_set=words, skip_nulls=True), -1).to_numpy() for c in columns]
        names = words.to_pylist() + [k.encode() for k in langs.to_pylist()]
        blob = DoubleArray.build(np.column_stack(paths).astype(np.int64)).to_bytes([*names, len(langs)])
        t = t.append_column("idx", pa.array(np.arange(len(t)), pa.int64())).append_column("trie", pa.nulls(len(t), pa.binary()))
        last = {"shard": t.column("shard")[0].as_py(), "idx": -1, "trie": blob}
        return pa.concat_tables([t, pa.Table.from_pylist([last], schema=t.schema)])

    dealt = candidates.withColumn("shard", F.pmod(F.xxhash64("lang", "w0", "w1", "w2"), F.lit(n)).cast("int"))
    made = dealt.select(*[c.split()[0] for c in PHRASE.split(", ")]).groupBy("shard").applyInArrow(build, PHRASE + ", idx long, trie binary")
    return saved(made, "phrase-tries"), n


def trie_counts(chunks: DataFrame, trie) -> DataFrame:
    """(idx, n): occurrences of the phrases of a broadcast trie, summed."""

    def run(batches):
        found, words = DoubleArray.from_bytes(trie.value)
        n_langs = words.pop()
        langs = {k.decode(): len(words) - n_langs + i for i, k in enumerate(words[len(words) - n_langs :])}
        at = {w: i for i, w in enumerate(words[: len(words) - n_langs])}
        sums = np.zeros(int(found.accept.max(initial=-1)) + 1, dtype=np.int64)
        for r in rows_of(batches):
            if r["lang"] not in langs:
                continue
            c = _Chunk(r)
            state = int(found.step(np.zeros(1, dtype=np.int32), np.array([langs[c.lang]]))[0])
            own = np.fromiter((at.get(w, -1) for w in c.words), dtype=np.int32, count=len(c.words))
            own[0] = -1
            for states in found.walk(state, own[c.tokens], c.starts, 3):
                hit = found.accept[states]
                sums += np.bincount(hit[hit >= 0], minlength=len(sums))
        seen = np.flatnonzero(sums)
        yield {"idx": seen, "n": sums[seen]}

    return map_rows(chunks, "idx long, n long", run).groupBy("idx").agg(F.sum("n").alias("n"))


def count_phrases(chunks: DataFrame, candidates: DataFrame, shard: int = SHARD) -> DataFrame:
    """(lang, w0, w1, w2, a): exact counts of the candidates, written; ``w2`` is
    null for two words."""
    spark = chunks.sparkSession
    tries, n = write_tries(candidates, shard)
    path = shared_dir(spark, "phrase-counts")
    for s in range(n):
        blob = tries.where((F.col("shard") == s) & (F.col("idx") == -1)).select("trie").first()
        if blob is None:
            continue
        trie = spark.sparkContext.broadcast(bytes(blob[0]))
        trie_counts(chunks, trie).withColumn("shard", F.lit(s)).write.mode("append").parquet(path)
        trie.destroy()
    ddl = "idx long, n long, shard int"
    sums = spark.createDataFrame([], ddl) if tries.isEmpty() else spark.read.schema(ddl).parquet(path)
    return saved(tries.where("idx >= 0").join(sums, ["shard", "idx"]).select("lang", "w0", "w1", "w2", F.col("n").alias("a")), "phrases")


def candidates(chunks: DataFrame, words: DataFrame, min_count: int) -> DataFrame:
    """(lang, w0, w1, w2): all phrases that can have ``min_count`` occurrences
    (and few others), written."""
    sc = chunks.sparkSession.sparkContext
    word_bits = sc.broadcast(bitmap(words, F.col("h")))
    enough = F.col("n") >= min_count
    pairs = saved(bucket_sums(chunks, [word_bits], 2).where(enough), "pair-buckets")
    pair_bits = sc.broadcast(bitmap(pairs, _mix_column("h0", "h1")))
    triples = saved(bucket_sums(chunks, [word_bits, pair_bits], 3).where(enough), "triple-buckets")
    none = F.lit(None).cast("binary").alias("w2")
    found = _named(pairs, words, 2).select("lang", "w0", "w1", none).union(_named(triples, words, 3).select("lang", "w0", "w1", "w2"))
    found = saved(found, "phrase-candidates")
    word_bits.destroy()
    pair_bits.destroy()
    return found


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, w0, w1, w2, a, l, r, score) of the lowest-scoring cut."""
    word = lambda w, n: words.select("lang", F.col("word").alias(w), F.col("n").alias(n))
    pairs, triples = phrases.where("w2 is null"), phrases.where("w2 is not null")
    two = pairs.join(word("w0", "l"), ["lang", "w0"]).join(word("w1", "r"), ["lang", "w1"]).withColumn("k", F.lit(1))
    head = pairs.select("lang", "w0", "w1", F.col("a").alias("l2"))
    tail = pairs.select("lang", F.col("w0").alias("w1"), F.col("w1").alias("w2"), F.col("a").alias("r1"))
    three = triples.join(word("w0", "l1"), ["lang", "w0"]).join(tail, ["lang", "w1", "w2"]).join(head, ["lang", "w0", "w1"]).join(word("w2", "r2"), ["lang", "w2"])
    cuts = F.explode(F.array(*[F.struct(F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"), F.lit(k).alias("k")) for k in (1, 2)])).alias("cut")
    names = ["lang", "w0", "w1", "w2", "a"]
    three = three.select(*names, cuts).select(*names, "cut.*")
    # exact: a * a has 36 digits at most, the quotient is at most a million
    score = F.expr("(1000000 * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    both = two.select(*names, "l", "r", "k").union(three.select(*names, "l", "r", "k")).withColumn("score", score)
    least = both.groupBy(*names).agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return least.select(*names, "cut.l", "cut.r", "cut.score")


def without_covered(rows: DataFrame, phrases: DataFrame, cover: int) -> DataFrame:
    """``rows`` but for the pairs inside a phrase of three with ``cover`` per
    cent of their count."""
    triples = phrases.where("w2 is not null")
    inner = triples.select("lang", "w0", "w1", "a").union(triples.select("lang", "w1", "w2", "a"))
    most = inner.groupBy("lang", "w0", "w1").agg(F.max("a").alias("longer"))
    open_ = F.col("longer").isNull() | F.col("w2").isNotNull() | (100 * F.col("longer") < cover * F.col("a"))
    return rows.join(most, ["lang", "w0", "w1"], "left").where(open_).drop("longer")


def mine(docs: DataFrame, min_count: int = MIN_COUNT, kept: int = KEPT, cover: int = COVER, shard: int = SHARD) -> DataFrame:
    """Phrases of two and three words of ``docs`` (text, lang), the first
    ``kept`` of each language: lang, rank, phrase, a, l, r, n, score."""
    chunks = write_chunks(docs)
    counts = word_counts(chunks).where(F.col("n") >= min_count).withColumn("h", word_hash())
    words = saved(counts, "frequent-words")
    phrases = count_phrases(chunks, candidates(chunks, words, min_count), shard).where(F.col("a") >= min_count)
    rows = without_covered(scored(phrases, words), phrases, cover)
    text = F.when(F.col("w2").isNull(), F.concat_ws(" ", F.col("w0").cast("string"), F.col("w1").cast("string"))).otherwise(
        F.concat_ws(" ", *[F.col(f"w{k}").cast("string") for k in range(3)])
    )
    first = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = rows.withColumn("phrase", text).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= kept)
    n = chunks.groupBy("lang").agg(F.sum("n_words").alias("n"))
    out = top.join(n, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op11_collocations(docs: DataFrame) -> DataFrame:
    """The contract's columns: each language's first phrases."""
    return mine(docs.select("text", "lang"))


ORACLE_SQL = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM texts),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
one AS (SELECT lang, w[i] AS p, count(*) AS f FROM places GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM one GROUP BY lang),
two AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, count(*) AS f FROM places WHERE i + 1 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
three AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, count(*) AS f FROM places WHERE i + 2 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT lang, w1 || ' ' || w2 AS phrase, two.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM two JOIN one x USING (lang) JOIN one y USING (lang) WHERE x.p = w1 AND y.p = w2
  UNION ALL
  SELECT three.lang, three.w1 || ' ' || three.w2 || ' ' || three.w3, three.f, 1, x.f, y.f
  FROM three JOIN one x ON x.lang = three.lang AND x.p = w1 JOIN two y ON y.lang = three.lang AND y.w1 = three.w2 AND y.w2 = three.w3
  UNION ALL
  SELECT three.lang, three.w1 || ' ' || three.w2 || ' ' || w3, three.f, 2, x.f, y.f
  FROM three JOIN two x ON x.lang = three.lang AND x.w1 = three.w1 AND x.w2 = three.w2 JOIN one y ON y.lang = three.lang AND y.p = w3
),
scores AS (SELECT *, (1000000 * a::HUGEINT * a::HUGEINT) // (l::HUGEINT * r::HUGEINT) AS score FROM cuts),
least AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
covered AS (
  SELECT DISTINCT two.lang, two.w1 || ' ' || two.w2 AS phrase FROM two JOIN three t ON two.lang = t.lang
  AND ((two.w1 = t.w1 AND two.w2 = t.w2) OR (two.w1 = t.w2 AND two.w2 = t.w3)) AND 100 * t.f >= 50 * two.f
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM least ANTI JOIN covered USING (lang, phrase)
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
