"""All registered queries of the core, with their SQL."""

from __future__ import annotations

import importlib

#: Modules of this package that hold QUERIES and ORACLE.
MODULES = ["sequences", "periods", "relational", "entities", "texts", "ledgers", "research", "flows", "audits"]


def collect() -> tuple[dict, dict]:
    queries: dict = {}
    oracle: dict = {}
    for name in MODULES:
        module = importlib.import_module(f"vellum.plans.{name}")
        queries.update(module.QUERIES)
        oracle.update(module.ORACLE)
    return queries, oracle
