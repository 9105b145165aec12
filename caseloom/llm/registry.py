"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import bpe, decontam, linededup, neardup, pii, quality, repair, secrets, suffixdedup, tokens

MODULES = (bpe, quality, repair, decontam, linededup, pii, secrets, tokens, neardup, suffixdedup)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
