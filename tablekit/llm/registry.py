"""The queries of this package, each with its twin in SQL where there is one."""

from __future__ import annotations

from tablekit.llm import (
    chat,
    collocations,
    leaks,
    licenses,
    near,
    negatives,
    packing,
    privacy,
    quality_model,
    rules,
    secrets,
    substring,
    suffixes,
)
from tablekit.registry.base import Query

QUERIES = [
    Query("op1_substring_dedup", substring.query),
    Query("op2_minhash_near_dedup", near.query),
    Query("op3_chat_format", chat.query),
    Query("op4_decontamination", leaks.query),
    Query("op5_best_fit_packing", packing.query),
    Query("op6_suffix_dedup", suffixes.query),
    Query("op7_quality_classifier", quality_model.query),
    Query("op8_pii", privacy.query),
    Query("op9_quality_rules", rules.query, rules.SQL),
    Query("op10_secret_scan", secrets.query, secrets.SQL),
    Query("op11_license_scan", licenses.query),
    Query("op12_hard_negatives", negatives.query, negatives.SQL),
    Query("op13_phrase_collocation", collocations.query, collocations.SQL),
]
