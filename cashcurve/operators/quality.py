"""Data-quality operators from the declared constraints: M1-M6.

Each check is an aggregate (or an anti-join followed by an aggregate) that
returns counts per rule; the offending rows themselves are available from
the ``*_rows`` helpers for drill-down.  Nothing is collected to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def duplicate_key_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """M1: keys that occur more than once, with their multiplicity."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def unique_summary(name: str, df: DataFrame, keys: list[str]) -> DataFrame:
    """M1 summary: rows, distinct keys and duplicated keys of one declared unique constraint."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_keys"),
                 F.count(F.when(F.col("n") > 1, True)).alias("duplicate_keys")).select(
        F.lit(name).alias("constraint_name"), "rows", "distinct_keys", "duplicate_keys")


def orphan_rows(child: DataFrame, fk: str, parent: DataFrame, pk: str = "id") -> DataFrame:
    """M2: child rows whose non-NULL foreign key has no parent."""
    p = parent.select(F.col(pk).alias(fk))
    return child.filter(F.col(fk).isNotNull()).join(p, fk, "left_anti")


def orphan_summary(name: str, child: DataFrame, fk: str, parent: DataFrame, pk: str = "id") -> DataFrame:
    o = orphan_rows(child, fk, parent, pk)
    return o.agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(name).alias("relation"), "orphans")


def domain_summary(name: str, df: DataFrame, ok: Column) -> DataFrame:
    """M3: rows checked and rows violating a NOT NULL / domain predicate (NULL predicate = violation)."""
    return df.agg(F.count(F.lit(1)).alias("checked"),
                  F.count(F.when(~F.coalesce(ok, F.lit(False)), True)).alias("violations")).select(
        F.lit(name).alias("rule"), "checked", "violations")


def month_grain_summary(name: str, df: DataFrame, col: str) -> DataFrame:
    """M4: dates that are not the 1st of their month."""
    c = F.col(col)
    return df.agg(F.count(c).alias("checked"),
                  F.count(F.when(c != F.trunc(c, "MM"), True)).alias("off_grain")).select(
        F.lit(name).alias("column_name"), "checked", "off_grain")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def evolve(df: DataFrame, target: StructType, defaults: dict | None = None) -> DataFrame:
    """M6: bring rows of an older schema to ``target`` (missing columns NULL, then defaults)."""
    empty = df.sparkSession.createDataFrame([], target)
    out = empty.unionByName(df, allowMissingColumns=True)
    return out.na.fill(defaults) if defaults else out
