"""The thirteen operators' queries over whole tables, with their production parameters, and SQL where SQL can say them."""

from __future__ import annotations

from . import query_op1, query_op2, query_op3, query_op4, query_op5, query_op6, query_op7, query_op8, query_op9, query_op10, query_op11, query_op12, query_op13

MODULES = (query_op1, query_op2, query_op3, query_op4, query_op5, query_op6, query_op7, query_op8, query_op9, query_op10, query_op11, query_op12, query_op13)


def queries() -> dict:
    return {m.NAME: m.run for m in MODULES}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.SQL for m in MODULES if getattr(m, "SQL", None)}
