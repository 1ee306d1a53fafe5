"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from tillroll.llm import collocations, decontamination, html_extract, jaccard_join, langid, lm_scoring, packing, pii, quality, secret_scan, suffix_dedup, toxicity, variants
from tillroll.sources.tables import read_table


def _docs(spark, d):
    return read_table(spark, d, "documents")


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op4_lm_score": lambda s, d: lm_scoring.op4_lm_score(_docs(s, d)),
    "op9_suffix_dedup": lambda s, d: suffix_dedup.op9_suffix_dedup(_docs(s, d)),
    "op2_jaccard_join": lambda s, d: jaccard_join.op2_jaccard_join(_docs(s, d)),
    "op7_extract": lambda s, d: html_extract.op7_extract(read_table(s, d, "pages")),
    "op5_pack": lambda s, d: packing.op5_pack(_docs(s, d)),
    "op1_toxicity": lambda s, d: toxicity.op1_toxicity(_docs(s, d), read_table(s, d, "labels")),
    "op10_pii": lambda s, d: pii.op10_pii(_docs(s, d)),
    "op3_quality": lambda s, d: quality.op3_quality(_docs(s, d)),
    "op8_language_id": lambda s, d: langid.op8_language_id(_docs(s, d)),
    "op6_decontaminate": lambda s, d: decontamination.op6_decontaminate(_docs(s, d), read_table(s, d, "benchmark")),
    "op11_collocations": lambda s, d: collocations.op11_collocations(_docs(s, d)),
    "op12_secrets": lambda s, d: secret_scan.op12_secrets(_docs(s, d)),
    "op13_variants": lambda s, d: variants.op13_variants(_docs(s, d)),
}

# Queries whose method SQL cannot express have none; tests/llm holds their brute force.
ORACLE = {
    "op6_decontaminate": decontamination.ORACLE_SQL,
    "op11_collocations": collocations.ORACLE_SQL,
    "op13_variants": variants.ORACLE_SQL,
}
