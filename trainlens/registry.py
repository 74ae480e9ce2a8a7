"""Registered queries and their DuckDB oracle statements.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the driver tables. The
oracle is an independent SQL statement over the same tables (views named
after them). Both alias every computed column identically and round
doubles to 6 decimals so value hashes agree across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from trainlens.catalog import (  # noqa: F401
        attribution_q, data_q, evaluation_q, gates_q, vectors_q,
    )
