"""Registered queries of this subpackage: name -> (query, checking SQL or None)."""

from __future__ import annotations

from importlib import import_module

MODULES = [
    "substring_dedup", "language_id", "line_dedup", "suffix_dedup", "quality", "jaccard_join", "license_scan", "decontamination", "chat_format", "packing", "merkle_manifest", "lexical_search", "line_quality_crf",
]


def registered() -> dict:
    found: dict = {}
    for module in MODULES:
        found.update(import_module(f"corpusweave.llm.{module}").QUERIES)
    return found
