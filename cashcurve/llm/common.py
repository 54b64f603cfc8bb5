"""Helpers shared by the training-data operators: table access, folds, stable row keys, bounded broadcasts."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashcurve.session import checkpoint_dir

#: Rows of one Arrow batch handed to a Python task, and the text bytes after which a batch is cut earlier.
ARROW_ROWS, ARROW_BYTES = 2_000, 16 << 20
_DEFAULTS: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Prepare the session for Python tasks.

    An Arrow batch is bounded by bytes as well as rows, so that very long texts cannot pile up in one.  Workers find this
    package where the driver has it (local mode, shared installations); on a cluster without either, pass it with ``--py-files``.
    """
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join(p for p in (root, *paths) if p)
    for name, value in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if key not in _DEFAULTS:
            _DEFAULTS[key] = str(spark._jvm.org.apache.spark.sql.internal.SQLConf().getConfString(key))
        if spark.conf.get(key) == _DEFAULTS[key]:             # a caller's own setting stays
            spark.conf.set(key, str(value))


def reliable(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint in the shared folder named by ``spark.checkpoint.dir``."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fold_is(id_col: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32(id as text) mod ``modulus`` is ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % F.lit(modulus) == F.lit(remainder), F.lit(False))


def fresh(df: DataFrame, base: str) -> str:
    """A column name starting with ``base`` that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def one_per_id(df: DataFrame, text_col: str = "text", id_col: str = "id") -> DataFrame:
    """Of the rows of an id the one with the smallest hash of its text, so that a sample of ids bounds the rows as well."""
    rest = [c for c in df.columns if c not in (id_col, text_col)]
    least = F.min(F.struct(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"), *rest))
    return df.groupBy(id_col).agg(least.alias("_least")).select(id_col, F.col("_least.t").alias(text_col), *[f"_least.{c}" for c in rest])


def text_key(id_col: Column, text: Column) -> list[Column]:
    """Columns that identify an (id, whole text) row: the id and two independent 64-bit hashes of the text."""
    return [id_col, F.xxhash64(text), F.xxhash64(F.lit("#"), text)]


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]):
    """A ``mapInArrow`` function from a function of one batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)
    return run


def with_fields(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    out = T.StructType(list(schema.fields))
    for name, kind in fields:
        out = out.add(name, kind)
    return out


def scalar(df: DataFrame):
    """The single value of a one-row, one-column aggregate."""
    return df.first()[0]
