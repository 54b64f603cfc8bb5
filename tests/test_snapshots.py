"""Tables of change sets: whole or not at all, replayed without effect, and no column lost."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from cashcurve.operators import upsert as up
from cashcurve.session import checkpoint_dir
from cashcurve.sources.batches import BatchTable
from cashcurve.sources.files import SharedFiles


def _root(spark, name):
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:8]}")


def _rows(spark, *pairs):
    return spark.createDataFrame([(1, k, v) for k, v in pairs], "company_id int, k string, v int")


def _table(spark, **options):
    return BatchTable(spark, _root(spark, "batches"), ["company_id", "k"], options.pop("replace", ["v"]), **options)


def _content(t):
    return sorted((r.k, r.v) for r in t.read().collect())


def test_change_sets_fold_and_a_rewritten_base_changes_nothing(spark):
    t = _table(spark)
    assert t.read() is None and t.base() is None and not t.applied(0) and t.rewrite_base() is None
    t.write(0, _rows(spark, ("a", 1), ("b", 1)))
    t.write(1, _rows(spark, ("b", 2), ("c", 2)))
    assert _content(t) == [("a", 1), ("b", 2), ("c", 2)] and t.batches() == [0, 1]
    assert t.rewrite_base() == 1 and t.base() == 1 and t.applied(0)
    assert _content(t) == [("a", 1), ("b", 2), ("c", 2)]
    t.write(2, _rows(spark, ("a", 3)))
    assert _content(t) == [("a", 3), ("b", 2), ("c", 2)] and not t.applied(3)


def test_a_change_set_costs_its_own_rows(spark):
    t = _table(spark)
    t.write(0, spark.range(5000).select(F.lit(1).alias("company_id"), F.col("id").cast("string").alias("k"), F.lit(1).alias("v")))
    t.write(1, _rows(spark, ("7", 2)))
    assert spark.read.parquet(t._path("changes", 1)).count() == 1            # also for a tenant with all rows
    assert t.read().count() == 5000


def test_a_batch_written_again_replaces_itself(spark):
    t = _table(spark)
    t.write(0, _rows(spark, ("a", 1)))
    t.write(1, _rows(spark, ("a", 2), ("b", 2)))
    once = _content(t)
    t.write(1, _rows(spark, ("a", 2), ("b", 2)))
    assert _content(t) == once == [("a", 2), ("b", 2)]


def test_an_unfinished_folder_is_not_read(spark):
    t = _table(spark)
    t.write(0, _rows(spark, ("a", 1)))
    t.write(1, _rows(spark, ("a", 9), ("z", 9)))
    os.remove(t._path("changes", 1) + "/_SUCCESS")                           # as a write that died leaves it
    assert _content(t) == [("a", 1)] and not t.applied(1)
    t.write(1, _rows(spark, ("b", 2)))
    assert _content(t) == [("a", 1), ("b", 2)]
    t.rewrite_base()
    os.remove(t._path("base", 1) + "/_SUCCESS")
    assert t.base() is None and _content(t) == [("a", 1), ("b", 2)]


def test_read_failures_are_not_an_empty_table(spark):
    t = _table(spark)
    t.write(0, _rows(spark, ("a", 1)))
    for name in os.listdir(t._path("changes", 0)):
        if name.endswith(".parquet"):
            with open(os.path.join(t._path("changes", 0), name), "w") as f:
                f.write("{")
    with pytest.raises(Exception, match="(?i)parquet|corrupt|footer|crc|checksum"):
        t.read().collect()


def test_no_column_is_lost_and_none_is_blanked(spark):
    t = _table(spark, replace=["v", "w", "flag"], defaults={"flag": True, "w": 7})
    t.write(0, _rows(spark, ("a", 1), ("b", 1), ("c", 1)))
    t.write(1, spark.createDataFrame([(1, "a", 2, 5, None), (1, "d", 2, None, False)], "company_id int, k string, v int, w int, flag boolean"))
    t.write(2, spark.createDataFrame([(1, "a", 6), (1, "b", 6), (1, "e", 6)], "company_id int, k string, w int"))
    want = {"a": (2, 6, None), "b": (1, 6, True), "c": (1, 7, True), "d": (2, None, False), "e": (None, 6, True)}
    for _ in range(2):
        assert {r.k: (r.v, r.w, r.flag) for r in t.read().collect()} == want   # v outlives its absence, w and flag reach back as defaults
        t.rewrite_base()


def test_a_changed_type_is_an_error(spark):
    t = _table(spark)
    t.write(0, _rows(spark, ("a", 1)))
    t.rewrite_base()
    t.write(1, spark.createDataFrame([(1, "a", "x")], "company_id int, k string, v string"))
    with pytest.raises(ValueError, match="another type"):
        t.read()


def test_fingerprint_follows_the_files(spark):
    root = _root(spark, "files")
    _rows(spark, ("a", 1)).write.parquet(root)
    files = SharedFiles(spark)
    one = files.fingerprint(root)
    assert files.fingerprint(root) == one
    _rows(spark, ("b", 1)).write.mode("append").parquet(root)
    assert files.fingerprint(root) != one and files.names(root + "-none") == []


def test_sequences_above_two_to_the_53_keep_their_order(spark):
    base = _rows(spark, ("a", 10))
    big = 2 ** 53
    delta = spark.createDataFrame([(1, "a", 20, big + 1), (1, "a", 15, big)], "company_id int, k string, v int, seq long")
    for d in (delta, delta.orderBy("seq")):
        assert up.upsert(base, d, ["company_id", "k"], replace=["v"], delta_seq="seq").first().v == 20
