"""A1: scans of the landed parquet tables with explicit (never inferred) schemas.

Column pruning and filter pushdown are left to Catalyst: callers ``select`` /
``filter`` on the returned DataFrame and the parquet scan only reads what is
used (check ``ReadSchema`` / ``PushedFilters`` in ``explain``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (
    ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType,
    StructField, StructType, TimestampNTZType,
)


def _s(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


I, L, D, S, TS = IntegerType(), LongType(), DoubleType(), StringType(), TimestampNTZType()

RAW_SCHEMAS: dict[str, StructType] = {
    "region": _s(("r_regionkey", I), ("r_name", S)),
    "nation": _s(("n_nationkey", I), ("n_name", S), ("n_regionkey", I)),
    "customer": _s(("c_custkey", L), ("c_name", S), ("c_nationkey", I), ("c_acctbal", D),
                   ("c_mktsegment", S)),
    "supplier": _s(("s_suppkey", L), ("s_name", S), ("s_nationkey", I), ("s_acctbal", D)),
    "part": _s(("p_partkey", L), ("p_name", S), ("p_brand", S), ("p_type", S), ("p_size", I),
               ("p_retailprice", D)),
    "orders": _s(("o_orderkey", L), ("o_custkey", L), ("o_orderstatus", S), ("o_totalprice", D),
                 ("o_orderdate", TS), ("o_orderpriority", S)),
    "lineitem": _s(("l_orderkey", L), ("l_partkey", L), ("l_suppkey", L), ("l_linenumber", I),
                   ("l_quantity", D), ("l_extendedprice", D), ("l_discount", D), ("l_tax", D),
                   ("l_returnflag", S), ("l_linestatus", S), ("l_shipdate", TS)),
    "events": _s(("event_id", L), ("ts", TS), ("user_id", L), ("event_type", S), ("value", D),
                 ("props", S)),
    "documents": _s(("doc_id", L), ("text", S), ("lang", S), ("source", S), ("n_chars", L)),
    "embeddings": _s(("vec_id", L), ("embedding", ArrayType(FloatType())), ("label", I)),
    "pages": _s(("page_id", L), ("url", S), ("html", S)),
    "benchmark": _s(("item_id", L), ("text", S)),
    "labels": _s(("doc_id", L), ("quality", I), ("toxic", I)),
    "conversations": _s(("conv_id", L), ("turn", L), ("role", S), ("text", S)),
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one landed table with its declared schema."""
    return spark.read.schema(RAW_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class RawTables:
    """Lazy accessor: ``raw.orders`` is a scan DataFrame (nothing is read until an action)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in RAW_SCHEMAS:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = read_table(self.spark, self.sf_dir, name)
        return self._cache[name]
