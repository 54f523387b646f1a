"""The queries of this subpackage, and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

import importlib

#: Module, and name of the query function in it.
_QUERIES = {
    "op1_token_counts": "token_counts",
    "op2_permutation_index": "permutation_index",
    "op3_line_dedup": "line_dedup",
    "op4_toxicity": "toxicity",
    "op5_decontaminate": "decontaminate",
    "op6_ngram_jaccard": "near_duplicates",
    "op7_bpe": "bpe",
    "op8_sharding": "sharding",
    "op9_html_extract": "html_extract",
    "op10_pii": "pii",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from .decontaminate import OP5_SQL
    from .line_dedup import OP3_SQL

    return {"op3_line_dedup": OP3_SQL, "op5_decontaminate": OP5_SQL}
