"""Registered queries of the library's own operators."""

from __future__ import annotations


def _modules():
    from . import ingest, intake, market, research

    return [market, research, ingest, intake]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.ORACLE.items()}
