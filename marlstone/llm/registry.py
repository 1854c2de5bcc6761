"""The queries of this subpackage, and the DuckDB text of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import chat, exact_dedup, html_text, mixing, near_dedup, neighbours, packing, quality, records, substrings

QUERIES = (
    mixing.op1_mixing,
    html_text.op2_html_text,
    records.op3_token_records,
    chat.op4_chat_format,
    substrings.op5_substring_dedup,
    quality.op6_quality,
    neighbours.op7_nearest,
    near_dedup.op8_near_dedup,
    packing.op9_packing,
    exact_dedup.op10_exact_dedup,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {
        "op5_substring_dedup": substrings.ORACLE_SQL,
        "op8_near_dedup": near_dedup.ORACLE_SQL,
        "op10_exact_dedup": exact_dedup.ORACLE_SQL,
    }
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
