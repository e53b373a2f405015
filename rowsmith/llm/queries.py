"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: Query names by module.
NAMES = {
    "op1_language": "language",
    "op2_simhash": "simhash",
    "op3_token_files": "token_files",
    "op4_quality": "quality",
    "op5_warc": "warc",
    "op6_bpe": "bpe",
    "op7_substrings": "substrings",
    "op8_fingerprints": "fingerprints",
    "op9_packing": "packing",
    "op10_toxicity": "toxicity",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"rowsmith.llm.{module}"), name) for name, module in NAMES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query; tests hold the others against brute force."""
    from rowsmith.llm.substrings import OP7_SQL
    from rowsmith.llm.warc import OP5_SQL

    return {"op5_warc": OP5_SQL, "op7_substrings": OP7_SQL}
