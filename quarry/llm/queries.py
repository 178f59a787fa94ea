"""The queries of the llm operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import importlib

#: Query name and its module; each module defines a function of the query's name.
MODULES = {
    "op1_minhash": "minhash",
    "op2_secrets": "secrets",
    "op3_urls": "urls",
    "op4_lines": "lines",
    "op5_substrings": "substrings",
    "op6_quality": "quality",
    "op7_pii": "pii",
    "op8_packing": "packing",
    "op9_decontamination": "decontamination",
    "op10_embeddings": "embeddings",
    "op11_bestfit": "bestfit",
    "op12_negatives": "negatives",
    "op13_infilling": "infilling",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"quarry.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL of those operators whose module has some."""
    found = {name: getattr(importlib.import_module(f"quarry.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
