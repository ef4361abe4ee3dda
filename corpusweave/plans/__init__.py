"""Registered queries: an operator bound to the driver tables, and the SQL that checks it."""

from __future__ import annotations

from importlib import import_module

AREAS = ["files", "text", "edits", "references", "code", "packages", "signals"]


def registered() -> dict:
    """name -> (query(spark, sf_dir) -> DataFrame, checking SQL or None), over all areas."""
    found: dict = {}
    for area in AREAS:
        found.update(import_module(f"{__name__}.{area}").QUERIES)
    return found
