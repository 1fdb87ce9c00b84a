"""Query catalogue: each name has a Spark plan and, where SQL can say it, the same query as DuckDB SQL."""

from __future__ import annotations

from . import contracts, evaluation, files, ledger, retrieval, text

MODULES = (retrieval, evaluation, ledger, text, contracts, files)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
