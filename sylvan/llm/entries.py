"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

_QUERIES = {
    "op1_suffix_dedup": "suffix",
    "op2_jaccard_join": "jaccard",
    "op3_warc": "warc",
    "op4_exact_dedup": "exact",
    "op5_fingerprints": "fingerprint",
    "op6_brown_lm": "brown",
    "op7_line_dedup": "lines",
    "op8_toxicity": "toxicity",
    "op9_retrieval_packing": "packing",
    "op10_nbest_pieces": "pieces",
}


def queries() -> dict:
    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in _QUERIES.items()}
    return found


def oracle_sql() -> dict[str, str]:
    from . import exact, warc

    return {"op3_warc": warc.SQL, "op4_exact_dedup": exact.SQL}
