"""All registered queries."""

from __future__ import annotations

import importlib

MODULES = ("particles", "comparison", "tokens", "metrics", "runs", "files")


def collect():
    queries, oracle = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"eventspark.plans.{name}")
        queries |= module.QUERIES
        oracle |= module.ORACLE
    return queries, oracle
