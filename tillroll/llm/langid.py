"""Language identification by compression.

A language is a raw-content zstandard dictionary made from text labelled with
it.  A document's letters (lower-cased, runs of anything else become one
space) are compressed piece by piece with every language's dictionary; the
language with the smallest total wins.  A constant filler after each piece
keeps zstandard from storing short pieces uncompressed, so that even a few
words can be told apart.  A document is rejected when the runner-up is within
``MARGIN_BYTES`` + ``MARGIN_SHARE`` of the smallest size.

The dictionaries come from a bounded sample of labelled rows (the classifier's
fit): at most ``SAMPLE_DOCS`` documents a language in hash order of the id,
one slice of ``SLICE`` characters each, ``DICT_BYTES`` in all.  Everything
else reads whole texts.

Defined cases: null text or text without a letter is ``und`` with score 0 and
rejected; equal sizes go to the first language in alphabetical order and are
rejected; with nothing to learn from every document is ``und``; null labels
and null ids are not learned from; repeated rows are judged alike; other
columns pass through, and columns named like the results are replaced.
"""

from __future__ import annotations

import math
import re

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import is_fold, with_columns

SAMPLE_DOCS = 512
SLICE = 1000
DICT_BYTES = 64 << 10
LEVEL = 6
PIECE = 2048
MARGIN_BYTES = 1
MARGIN_SHARE = 0.005
TEMPERATURE = 0.35  # of the score: weight of a language exp(-bytes more than the smallest * this)
FILLER = bytes(64)
_OTHER = re.compile(r"[\W\d_]+")
_encoders: dict = {}  # of this worker process


def normalise(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def fit(docs: DataFrame, learn: Column, sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """{language: dictionary} from the rows of ``docs`` (doc_id, text, lang)
    where ``learn``.  As many rows as distinct languages, and the bounded
    sample, reach the driver."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}
    order = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30))
    # about twice the sample passes; the exact bound is applied to what arrives
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (2 * sample_docs + 32) / n))])
    start = F.pmod(F.xxhash64(F.lit("slice"), "doc_id"), F.greatest(F.length("text") - SLICE, F.lit(1)))
    sample = (
        rows.withColumn("_o", order)
        .where(F.col("_o") < F.element_at(share, F.col("lang")) * (1 << 30))
        .select("lang", "_o", "doc_id", F.substring("text", start.cast("int") + 1, F.lit(SLICE)).alias("t"))
        .collect()
    )
    found: dict[str, list[bytes]] = {}
    for r in sorted(sample, key=lambda r: (r["_o"], r["doc_id"], r["t"])):
        found.setdefault(r["lang"], []).append(normalise(r["t"]).encode("utf-8", "replace"))
    made = {k: b" ".join(x for x in v[:sample_docs] if x)[:dict_bytes] for k, v in found.items()}
    return {k: v for k, v in sorted(made.items()) if len(v) >= 8}


def _load(dictionaries: dict[str, bytes]):
    key = hash(tuple(dictionaries.items()))
    if key not in _encoders:
        made = []
        for k, v in dictionaries.items():
            d = zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            p = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
            made.append((k, zstandard.ZstdCompressor(dict_data=d, compression_params=p)))
        _encoders.clear()
        _encoders[key] = made
    return _encoders[key]


def judge(encoders, text: str | None) -> tuple[str, float, int, bool]:
    """Language, score, margin in bytes, rejected."""
    norm = normalise(text)
    if not encoders or not any(c.isalpha() for c in norm):
        return "und", 0.0, 0, True
    b = norm.encode("utf-8", "replace")
    pieces = [b[i : i + PIECE] + FILLER for i in range(0, len(b), PIECE)]
    sizes = [sum(len(c.compress(p)) for p in pieces) for _, c in encoders]
    best = min(sizes)
    at = sizes.index(best)
    margin = min((s for i, s in enumerate(sizes) if i != at), default=2 * best) - best
    score = 1 / sum(math.exp(-TEMPERATURE * (s - best)) for s in sizes)
    return encoders[at][0], score, margin, margin < MARGIN_BYTES + MARGIN_SHARE * best


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """``docs`` (``text``) with lang_pred, score (0 to 1), margin (bytes) and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # dict_bytes a language

    def run(texts):
        e = _load(shared.value)
        got = [judge(e, t) for t in texts]
        return dict(zip(("lang_pred", "score", "margin", "rejected"), zip(*got))) if got else {k: [] for k in ("lang_pred", "score", "margin", "rejected")}

    return with_columns(docs, ["text"], "lang_pred string, score double, margin long, rejected boolean", run)


def op8_language_id(docs: DataFrame) -> DataFrame:
    """Contract: learns outside crc32 fold 1 of 3, predicts every document."""
    docs = docs.select("doc_id", "text", "lang")
    held = is_fold(F.col("doc_id"), 3, 1)
    found = identify(docs.select("doc_id", "text"), fit(docs, ~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "margin", "rejected")
