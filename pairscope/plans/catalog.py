"""Registry of the runnable queries: key -> (callable on Tables, output contract)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from pairscope.functions.shaping import shape
from pairscope.plans.tables import Tables

QUERIES: dict[str, tuple[Callable[[Tables], DataFrame], str]] = {}


def query(key: str, spec: str):
    def register(fn: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = (fn, spec)
        return fn

    return register


def run(key: str, tables: Tables) -> DataFrame:
    fn, spec = QUERIES[key]
    return shape(fn(tables), spec)
