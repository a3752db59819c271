"""Registered queries, one module per family: QUERIES and SQL."""

from __future__ import annotations

import importlib

FAMILIES = ("orphans", "relational", "text", "retrieval", "graph")


def modules() -> list:
    return [importlib.import_module(f"{__name__}.{family}") for family in FAMILIES]
