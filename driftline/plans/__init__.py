"""Bound queries: each key maps an operator to the star-schema tables."""

import importlib

from .registry import QUERIES, oracle_statements

for _name in ("texts", "lifecycle", "relational", "bins", "scoring", "adoption", "fits", "entities", "topic_plans", "io_plans"):
    importlib.import_module(f"{__name__}.{_name}")

ORACLE_SQL = oracle_statements()

__all__ = ["QUERIES", "ORACLE_SQL"]
