"""Skew-safe per-group running aggregates.

``Window.partitionBy(g).orderBy(o)`` processes each group in ONE task; a
group holding a third of all rows becomes a single straggler.  The running
count here is a distributed prefix sum instead:

1. range-partition on (group, order): a hot group is split across many
   partitions in order;
2. running count inside each (partition, group) slice -- bounded by the
   partition size, not by the group size;
3. per (partition, group) totals (at most partitions x groups-spanning rows),
   prefix-summed over earlier partitions of the same group;
4. add the offset back with an equi-join on (partition, group).
"""

from __future__ import annotations

import contextlib
import os
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pinned_partitions(df: DataFrame) -> DataFrame:
    """Tag rows with their partition id and pin that assignment.

    The tagged rows are read twice (per-partition totals and the rows
    themselves); a range repartition planned twice could sample different
    bounds, so the tagged rows are checkpointed (reliably, to the shared
    ``spark.checkpoint.dir``) and both readers see the same files, also after
    an executor loss.
    """
    from cashcurve.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return df.withColumn("_p", F.spark_partition_id()).checkpoint(eager=True)


def running_count(df: DataFrame, group: str, order: list[str], predicate: Column, out: str) -> DataFrame:
    """``out`` = number of rows of the same ``group`` with ``predicate`` true, up to and including this row."""
    flag = F.when(predicate, F.lit(1)).otherwise(F.lit(0))
    r = pinned_partitions(df.repartitionByRange(group, *order).withColumn("_f", flag))
    local_w = (Window.partitionBy("_p", group).orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    r = r.withColumn("_local", F.sum("_f").over(local_w))
    totals = r.groupBy("_p", group).agg(F.sum("_f").alias("_t"))
    off_w = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_p", group, F.coalesce(F.sum("_t").over(off_w), F.lit(0)).alias("_off"))
    return (r.join(offsets, ["_p", group]).withColumn(out, (F.col("_local") + F.col("_off")).cast("long"))
            .drop("_p", "_f", "_local", "_off"))


@contextlib.contextmanager
def numbered(df: DataFrame, group: str, order: list[str], out: str):
    """The rows with ``out``, their place (from 1) in their group.  Within the context: the rows lie in a folder that goes at its end.

    Rows are range-partitioned and sorted once and written (parquet) with their place in their task; a group's slices, at most one per
    task and group, give the offsets.
    """
    from cashcurve.session import checkpoint_dir
    from cashcurve.sources.files import SharedFiles
    spark = df.sparkSession
    folder = os.path.join(checkpoint_dir(spark), "numbered", uuid.uuid4().hex)
    placed = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id())
    placed.write.parquet(folder)
    rows = spark.read.schema(placed.schema).parquet(folder).withColumn("_p", F.shiftright("_at", 33))
    slices = rows.groupBy("_p", group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = slices.select("_p", group, (before - F.col("_first") + 1).alias("_shift"))
    try:
        yield rows.join(shift, ["_p", group]).withColumn(out, F.col("_at") + F.col("_shift")).drop("_p", "_at", "_shift")
    finally:
        SharedFiles(spark).remove(folder)


def listed(df: DataFrame, *order, whole: bool) -> DataFrame:
    """The rows of a list endpoint in their order: ``whole`` for one tenant's answer; for all tenants at once each partition is sorted for
    itself, as nobody reads an order across tenants, and no row is shuffled for it."""
    return df.orderBy(*order) if whole else df.sortWithinPartitions(*order)
