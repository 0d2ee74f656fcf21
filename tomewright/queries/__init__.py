"""Registered queries: every entry is (Spark function, DuckDB SQL or None)."""

from __future__ import annotations


def registry() -> dict:
    from tomewright.queries import audits, digests, exchange, people, planning, quoting, shelf, splitting
    out: dict = {}
    for m in (splitting, planning, quoting, digests, people, shelf, audits, exchange):
        overlap = out.keys() & m.QUERIES.keys()
        if overlap:
            raise ValueError(f"duplicate query names: {overlap}")
        out.update(m.QUERIES)
    return out
