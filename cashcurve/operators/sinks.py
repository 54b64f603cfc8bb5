"""A6 / A9 result sinks.

A6: API-shaped output rows -- decimals as float, dates as ISO text -- either as
typed columns (``to_api_columns``) or as one JSON document per row
(``to_json_rows``), written with ``df.write.json`` / parquet by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DateType, DecimalType, MapType, StructType, TimestampNTZType, TimestampType


def api_value(c: Column, kind: DataType) -> Column:
    """A value as the API writes it, inside structs, arrays and maps too: decimals as double, dates and timestamps as
    ISO text (the fraction of a second only if there is one)."""
    if isinstance(kind, DecimalType):
        return c.cast("double")
    if isinstance(kind, DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        return F.when(F.date_format(c, "SSSSSS") == "000000", whole).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[api_value(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: api_value(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda _, v: api_value(v, kind.valueType))
    return c


def to_api_columns(df: DataFrame) -> DataFrame:
    """Every column as ``api_value`` writes it."""
    return df.select(*[api_value(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def to_json_rows(df: DataFrame, key_cols: list[str]) -> DataFrame:
    """One JSON document per row (NULL fields kept as null), keyed by ``key_cols``."""
    api = to_api_columns(df)
    return api.select(*key_cols, F.to_json(F.struct(*api.columns), {"ignoreNullFields": "false"}).alias("json"))
