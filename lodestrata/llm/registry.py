"""Queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import audit, dedup, fingerprints, html, language, leaks, lm, media, middles, mixing, packing, secrets, urls

MODULES = (audit, dedup, fingerprints, html, language, leaks, lm, media, middles, mixing, packing, secrets, urls)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
