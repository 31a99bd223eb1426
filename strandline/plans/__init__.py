"""Queries of the library's operators, with their SQL."""

from __future__ import annotations

import importlib

MODULES = ("scalars", "segments", "align", "catalogue", "signal", "lexicon", "streams", "io", "surface")


def collected() -> tuple[dict, dict]:
    """All queries by name, and the SQL of those that SQL can express."""
    queries, sql = {}, {}
    for name in MODULES:
        r = importlib.import_module(f"strandline.plans.{name}").R
        queries |= r.queries
        sql |= r.sql
    return queries, sql
