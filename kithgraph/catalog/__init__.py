"""Named queries over the given tables, each with the SQL that checks it."""

from __future__ import annotations

import importlib

from kithgraph.catalog.registry import CATALOG, Given

for _part in ("tables", "scalars", "graph", "joins", "aggregates", "temporal", "structure", "model", "questions", "stored"):
    importlib.import_module(f"kithgraph.catalog.{_part}")

__all__ = ["CATALOG", "Given"]
