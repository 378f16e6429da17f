"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from tidemill.llm import langid, licenses, ngram, packing, phrases, pieces, pii, quality, repair, resample, rules, simhash, topk

_MODULES = (topk, packing, phrases, pieces, licenses, pii, ngram, quality, langid, simhash, rules, resample, repair, phrases)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
