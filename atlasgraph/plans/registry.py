"""All queries of the core, with the SQL that checks them."""

from __future__ import annotations

import importlib

MODULES = ("general", "graph_queries", "text_queries", "retrieval_queries", "semantic_queries", "extract_queries", "derived_queries")


def collect(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{name}"), attribute)
    return out
