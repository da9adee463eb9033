"""The queries opN_<name> and pipeline, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

#: Operator number: (module, function, name of its SQL or None).
_OPERATORS = {
    1: ("html_extract", "op1_html_extract", None),
    2: ("line_dedup", "op2_line_dedup", "OP2_SQL"),
    3: ("packing", "op3_best_fit_packing", None),
    4: ("exact_dedup", "op4_exact_dedup", "OP4_SQL"),
    5: ("warc", "op5_warc", "OP5_SQL"),
    6: ("sentencepiece_codec", "op6_sentencepiece", None),
    7: ("suffix_dedup", "op7_suffix_dedup", "OP7_SQL"),
    8: ("ngram_join", "op8_ngram_join", "OP8_SQL"),
    9: ("language_id", "op9_language_id", None),
    10: ("top_k", "op10_top_k", "OP10_SQL"),
    11: ("spelling_variants", "op11_spelling_variants", "OP11_SQL"),
    12: ("quality_crf", "op12_quality_crf", None),
    13: ("centroid_clusters", "op13_centroid_clusters", "OP13_SQL"),
}


def _modules():
    for module, function, sql in _OPERATORS.values():
        m = importlib.import_module(f"{__package__}.{module}")
        yield function, getattr(m, function), sql and getattr(m, sql)


def queries() -> dict:
    return {name: f for name, f, _ in _modules()}


def oracle_sql() -> dict:
    return {name: sql for name, _, sql in _modules() if sql}
