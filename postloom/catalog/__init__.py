"""Queries over the shared test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from postloom.catalog import base, evaluation, features, labels, masks, text

MODULES = [base, labels, text, masks, features, evaluation]


def all_queries() -> dict:
    return {name: fn for m in MODULES for name, (fn, _) in m.BOOK.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.BOOK.items() if sql}
