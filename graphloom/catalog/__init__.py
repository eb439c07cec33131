"""Queries of the reference's operators, bound to the driver's tables."""

from __future__ import annotations

from importlib import import_module

for _name in ("triples", "sparql", "joins", "aggregates", "windows", "traversal", "dag", "reasoning", "memory", "scalars", "surfaces"):
    import_module(f"{__name__}.{_name}")
