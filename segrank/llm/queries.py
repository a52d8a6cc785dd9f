"""Registered queries of this package and their SQL."""

from __future__ import annotations

from segrank.llm import (decontaminate, divergence, exact_dedup, html_crf, langid, line_rules, mixing, ngram_join, spelling,
                         suffix_dedup, token_orc, toxicity, warc)

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_warc": warc.op5_warc,
    "op6_mixing": mixing.op6_mixing,
    "op7_main_text": html_crf.op7_main_text,
    "op8_token_ids": token_orc.op8_token_ids,
    "op9_language": langid.op9_language,
    "op10_ngram_join": ngram_join.op10_ngram_join,
    "op11_quality_lines": line_rules.op11_quality_lines,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_source_divergence": divergence.op13_source_divergence,
}
SQL = {
    "op2_decontaminate": decontaminate.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op10_ngram_join": ngram_join.SQL,
    "op12_spelling_variants": spelling.SQL,
    "op13_source_divergence": divergence.SQL,
}
