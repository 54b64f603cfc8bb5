"""Skew: one key holding a third of all rows must still give exact results across many partitions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cashcurve.functions.grouped import running_count
from cashcurve.operators import upsert as up


def _skewed(spark, n=30000):
    # session 0 holds a third of the rows; the rest spread over 2000 sessions
    return spark.range(0, n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 2000 + 1).alias("session_id"),
        F.col("id"), F.when(F.col("id") % 5 < 2, "user").otherwise("assistant").alias("role")).repartition(32)


def test_running_count_matches_window_on_a_hot_group(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")   # keep the range split visible
    try:
        _check_running_count(spark)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def _check_running_count(spark):
    df = _skewed(spark)
    fast = running_count(df, "session_id", ["id"], F.col("role") == "user", "n")
    w = Window.partitionBy("session_id").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    brute = df.withColumn("n", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w).cast("long"))
    assert fast.exceptAll(brute).count() == 0 and brute.exceptAll(fast).count() == 0
    # the hot session really was split over several range partitions
    parts = (df.repartitionByRange("session_id", "id").withColumn("p", F.spark_partition_id())
             .filter(F.col("session_id") == 0).select("p").distinct().count())
    assert parts > 1


def test_upsert_with_a_hot_key_group(spark):
    base = _skewed(spark).select("session_id", "id", F.lit(1).alias("v"))
    delta = base.filter(F.col("session_id") == 0).select("session_id", "id", F.lit(2).alias("v"))
    out = up.upsert(base, delta, ["session_id", "id"], replace=["v"])
    got = {r.session_id == 0: r.c for r in out.groupBy((F.col("session_id") == 0).alias("hot"))
           .agg(F.sum("v").alias("c")).withColumnRenamed("hot", "session_id").collect()}
    assert got[True] == 2 * 10000 and got[False] == 20000
