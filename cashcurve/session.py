"""Session settings shared by tests, the bench and the driver entry point.

Only settings a Spark user would set are touched.  Cluster deployments pass
their own ``spark.sql.shuffle.partitions`` / ``spark.checkpoint.dir``; the
values here are defaults for local runs and are applied only when unset.
"""

from __future__ import annotations

import contextlib
import os
import re
import tempfile

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession

# Settings every operator relies on (semantics, not tuning).
SEMANTIC_CONF = {
    # All date truncation / epoch-millis parsing is done in UTC.
    "spark.sql.session.timeZone": "UTC",
    # ANSI stays on: every division goes through nullif/try_divide instead.
    "spark.sql.ansi.enabled": "true",
}

# Tuning defaults: AQE re-plans joins from runtime sizes (broadcast only when
# the *measured* side is under the threshold, sort-merge otherwise), coalesces
# small shuffle partitions and splits skewed ones.
TUNING_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def _submitted() -> set[str]:
    """Settings that spark-submit or the environment has made already."""
    names = set(re.findall(r"--conf[ =]+'?\"?([\w.]+)=", args := os.environ.get("PYSPARK_SUBMIT_ARGS", "")))
    if "--driver-memory" in args:
        names.add("spark.driver.memory")
    if "PYSPARK_GATEWAY_PORT" in os.environ:        # started by spark-submit: its JVM has the defaults and --conf values
        SparkContext._ensure_initialized()
        names |= {k for k, _ in SparkConf().getAll()}
    return names


def build_session(master: str | None = None, app: str = "cashcurve",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Get or create a session with the engine's semantic settings applied.

    Tuning values are defaults: an existing session keeps its own, and so does whatever spark-submit has set.
    ``extra`` and ``shuffle_partitions`` are the caller's and always apply.
    """
    builder = SparkSession.builder.appName(app)
    defaults = {}
    if SparkSession.getActiveSession() is None:
        defaults = {"spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("CASHCURVE_DRIVER_MEMORY", "3g"), **TUNING_CONF}
        taken = _submitted()
        defaults = {k: v for k, v in defaults.items() if k not in taken}
    if master:
        builder = builder.master(master)
    for k, v in {**defaults, **SEMANTIC_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    apply_semantics(spark)
    return spark


def apply_semantics(spark: SparkSession) -> None:
    """Apply the settings results depend on to an existing session."""
    for k, v in SEMANTIC_CONF.items():
        spark.conf.set(k, v)


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """Within it, a setting of the session has the value; the caller's comes back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def unsorted_partitions(spark: SparkSession, values: int = 32):
    """Within it, a write partitioned by a column of few values keeps one file open per value instead of sorting whole rows by it
    (rows of further values are sorted); the caller's setting comes back."""
    return setting(spark, "spark.sql.maxConcurrentOutputFileWriters", str(values))


def partitioned_by_part_of_key(spark: SparkSession):
    """Within it, a join takes its left side as it is partitioned if that is by some of the join's columns, and shuffles only the right one."""
    return setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")


def shuffles_released(spark: SparkSession):
    """Within it, the shuffle files of a job go when it ends (from Spark 4.1 on), not when the driver happens to collect its garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def sorted_groups(spark: SparkSession):
    """Within it, lists are collected over sorted rows: with many small groups, the hash aggregate sorts a buffer per row instead."""
    return setting(spark, "spark.sql.execution.useObjectHashAggregateExec", "false")


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared directory for lineage cuts and snapshot versions.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (a shared
    filesystem / object store); a cluster session without it is an error.  Only
    a local-mode session with the setting unset (tests, local runs) gets a
    scratch directory created and registered.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - e.g. a Spark Connect session has no SparkContext
        sc = None
    configured = sc.getConf().get("spark.checkpoint.dir", None) if sc is not None else None
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset conf raises on some versions
            configured = None
    if not configured:
        try:
            master = spark.conf.get("spark.master")
        except Exception:  # noqa: BLE001
            master = ""
        if not str(master).startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: snapshots, stored model tables and stream "
                               "checkpoints need a shared folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="cashcurve-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", configured)
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured
