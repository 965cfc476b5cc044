"""Registered queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from . import queries_dedup, queries_native, queries_text

QUERIES = {
    "op1_language_id": queries_text.op1_language_id,
    "op3_pii": queries_native.op3_pii,
    "op6_chat_formatting": queries_native.op6_chat_formatting,
    "op5_decontamination": queries_native.op5_decontamination,
    "op2_line_dedup": queries_dedup.op2_line_dedup,
    "op7_quality_classifier": queries_text.op7_quality_classifier,
    "op8_warc": queries_text.op8_warc,
    "op9_document_fingerprints": queries_dedup.op9_document_fingerprints,
    "op4_packing": queries_text.op4_packing,
    "op10_simhash_dedup": queries_dedup.op10_simhash_dedup,
}

SQL: dict[str, str] = {
    "op6_chat_formatting": queries_native.OP6_SQL,
    "op8_warc": queries_text.OP8_SQL,
}
