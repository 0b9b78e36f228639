"""Builds the oracle SQL: a query over the domain tables, as one WITH chain."""

from __future__ import annotations

import re

from ledgerloom.sources.domain import SQL_TABLES

#: Views that several oracles share, beside the domain tables; modules add to it.
SQL_VIEWS: dict[str, str] = dict(SQL_TABLES)


def oracle(sql: str) -> str:
    """The query, with the definitions of all tables and views that it names in front."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in SQL_VIEWS:
            if name not in order and re.search(rf"\b{name}\b", text):
                need(SQL_VIEWS[name])
                if name not in order:
                    order.append(name)

    need(sql)
    # MATERIALIZED keeps a table that is named twice from being computed twice.
    parts = [f"{name} AS MATERIALIZED ({SQL_VIEWS[name]})" for name in order]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql
