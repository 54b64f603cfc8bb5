"""What is shuffled for a stored table goes with the job that needed it, and no row is shuffled for a table of a row per company."""

import os
import time
import uuid

from pyspark.sql import functions as F

from cashcurve.plans import ledger_queries as lq
from cashcurve.plans.update_queries import lead_patches
from cashcurve.session import checkpoint_dir, setting
from cashcurve.sources.model import ensure_stored


def _shuffled(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().toList()
    return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}


def _gone(spark, before: set[str]) -> bool:
    until = time.time() + 20
    while (left := _shuffled(spark) - before) and time.time() < until:
        time.sleep(0.2)
    return not left


def test_shuffles_of_a_stored_table_go_when_it_is_stored(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old, before, most = spark.conf.get(key, None), _shuffled(spark), []
    rows = spark.range(20000).select((F.col("id") % 7).alias("k"), "id")

    def write(path):
        rows.repartition(4, "k").write.parquet(path + "/a")
        most.append(_gone(spark, before))                       # the first job's files are gone before the second begins
        rows.repartition(4, "id").write.parquet(path + "/b")
    root = os.path.join(checkpoint_dir(spark), "disk", uuid.uuid4().hex)
    ensure_stored(spark, root, write)
    assert most == [True] and _gone(spark, before) and spark.conf.get(key, None) == old
    assert spark.read.parquet(root + "/a").count() == spark.read.parquet(root + "/b").count() == 20000


def test_lines_are_stored_by_month_and_nothing_else_stays(spark):
    lines = spark.range(300).select(
        (F.col("id") % 3).cast("int").alias("company_id"), F.lit(1).cast("long").alias("connection_id"), F.lit("xero").alias("provider"), F.lit("cash").alias("basis"),
        F.lit("invoice_payment").alias("line_kind"), F.when(F.col("id") % 2 == 0, "I").alias("external_invoice_id"), F.lit(None).cast("string").alias("external_payment_id"),
        F.lit("C").alias("external_contact_id"), F.lit("n").alias("contact_name"), F.col("id").cast("decimal(19,4)").alias("amount"), F.lit("GBP").alias("currency"),
        F.date_add(F.lit("2024-01-20").cast("date"), (F.col("id") % 40).cast("int")).alias("posted_date"), F.col("id").cast("string").alias("idempotency_key"),
        F.lit(None).cast("long").alias("lead_id"))
    lines = lines.unionByName(lines.limit(1))                    # a line of two leads may stand twice
    folder = os.path.join(checkpoint_dir(spark), "disk", uuid.uuid4().hex)
    lq.write_by_month(lines, f"{folder}/lines")
    assert os.listdir(folder) == ["lines"] and {n for n in os.listdir(f"{folder}/lines") if "=" in n} == {"posted_month=2024-01-01", "posted_month=2024-02-01"}
    back = spark.read.parquet(f"{folder}/lines").select(lines.columns)
    assert back.exceptAll(lines).count() == 0 and back.count() == 301


def test_lines_are_not_shuffled_by_company_for_their_patches(spark):
    lines = spark.createDataFrame([(1, "a", "cash"), (1, "b", "accrual"), (24, "c", "accrual"), (None, "d", "cash"), (2, "e", "accrual")], "company_id int, idempotency_key string, basis string")
    leads = spark.createDataFrame([(7, 1), (5, 1), (9, 0), (4, None)], "id long, company_id int")
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        patches = lead_patches(lines, leads)
        plan = patches._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
        assert {r.idempotency_key: r.lead_id for r in patches.collect()} == {"a": 5, "b": None, "c": 9, "d": None, "e": None}
