"""Small frames for the tests of the training-data operators."""

from __future__ import annotations

import random

WORDS = "the of and to in is that it for was on with as by at from this are be or an".split()
SYLLABLES = "tra mon bel ki su ren dor pa lis cu ven ast ole min gra".split()


def prose(rng: random.Random, n: int) -> str:
    out = []
    for _ in range(n):
        out.append(rng.choice(WORDS) if rng.random() < 0.45 else "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))))
        if rng.random() < 0.1:
            out[-1] += rng.choice([".", ",", ".\n"])
    return " ".join(out)


def edge_rows(rng: random.Random | None = None) -> list[tuple]:
    """(doc_id, text, lang): nulls, empties, one letter, symbols, repeats, a very long text."""
    rng = rng or random.Random(5)
    long = prose(rng, 30_000)
    same = prose(rng, 120)
    return [
        (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "x", "en"), (5, "###  $$$", "de"), (6, same, "en"), (7, same, "en"),
        (7, same, "en"), (None, same, "en"), (8, long, "en"), (9, "a" * 60_000, None), (10, "\U0001f600 é́   z", "fr"),
        (11, "1.2.3.4 " * 300, "en"), (12, "o " * 5000, None),
    ]


def frame(spark, rows, extra: str = ""):
    """doc_id, text, lang and columns whose names clash with inner ones."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    return df.selectExpr("*", "cast(doc_id as string) as source", "length(text) as n_chars", "'own' as rep", "'own' as score", "'own' as part", "'own' as kind", "'own' as _base", "'own' as spans") if extra else df
