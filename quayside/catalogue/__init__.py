"""Registered queries: each operator on the provided tables, with the SQL that must agree."""

from __future__ import annotations

from importlib import import_module

from quayside.catalogue.registry import ORACLES, QUERIES

for _name in ("relational", "zones", "maps", "replies", "text", "merges", "ranking", "status", "messages", "report", "flows"):
    import_module(f"quayside.catalogue.{_name}")

__all__ = ["ORACLES", "QUERIES"]
