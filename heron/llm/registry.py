"""Queries of the training-data operators and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

import corpus_pipeline
from heron.llm import (
    op01_mixing,
    op02_html,
    op03_sharding,
    op04_order_minhash,
    op05_media,
    op06_language_id,
    op07_packing,
    op08_line_dedup,
    op09_near_dedup,
    op10_token_counts,
    op11_merkle,
    op12_filter_audit,
    op13_exact_dedup,
)

SQL = {"op1_mixing": op01_mixing.SQL, "op3_sharding": op03_sharding.SQL, "op9_near_dedup": op09_near_dedup.SQL, "op11_merkle": op11_merkle.SQL, "op12_filter_audit": op12_filter_audit.SQL, "op13_exact_dedup": op13_exact_dedup.SQL}


def queries() -> dict:
    return {
        "op1_mixing": op01_mixing.query,
        "op2_html_extraction": op02_html.query,
        "op3_sharding": op03_sharding.query,
        "op4_order_minhash": op04_order_minhash.query,
        "op5_media": op05_media.query,
        "op6_language_id": op06_language_id.query,
        "op7_packing": op07_packing.query,
        "op8_line_dedup": op08_line_dedup.query,
        "op9_near_dedup": op09_near_dedup.query,
        "op10_token_counts": op10_token_counts.query,
        "op11_merkle": op11_merkle.query,
        "op12_filter_audit": op12_filter_audit.query,
        "op13_exact_dedup": op13_exact_dedup.query,
        "pages_language": op06_language_id.pages_query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
