"""The registered queries of this package, and their SQL."""

from __future__ import annotations

from . import bpe, itq, licenses, packing, quality, sharding, simhash, substrings, topk, toxicity

MODULES = (itq, packing, topk, quality, bpe, toxicity, substrings, licenses, simhash, sharding)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.ORACLE_SQL.items()}
