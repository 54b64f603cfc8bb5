"""Registry of named queries: key -> Spark builder (spark, sf_dir) and DuckDB oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}
# Ops checked against a brute-force / handwritten fixture in tests instead of SQL.
NO_ORACLE_REASON: dict[str, str] = {}


def register(name: str, oracle: str | None = None, no_oracle: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query key {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        elif no_oracle:
            NO_ORACLE_REASON[name] = no_oracle
        return fn
    return deco
