"""Queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module of this subpackage; each has query(spark, sf_dir), and SQL where SQL can express it.
MODULES = {
    "op1_packing": "packing",
    "op2_suffix_dedup": "suffix_dedup",
    "op3_byte_bpe": "bpe",
    "op4_winnowing_fingerprints": "fingerprints",
    "op5_simhash_near_dedup": "simhash",
    "op6_pivot_top_k": "topk",
    "op7_url_filters": "urls",
    "op8_language_id": "language",
    "op9_token_counts": "token_counts",
    "op10_toxicity": "toxicity",
}


def _module(name: str):
    return import_module(f"{__package__}.{MODULES[name]}")


def queries() -> dict:
    return {name: _module(name).query for name in MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in MODULES if (sql := getattr(_module(name), "SQL", None))}
