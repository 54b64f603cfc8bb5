"""Project budgets, payment schedules and timeline: A8 C11 C13 D9 D10 D13 D14 I21 I22 P1-P5.

Scale notes
* Budget and actual totals are aggregated *before* they meet the project
  table (no fan-out join), each with map-side partial aggregation.
* The item x month grid (C13) is emitted sparse -- only cells with a positive
  sum, as the reference displays them -- plus a per-project month spine.  No
  cross join of items with months is materialised.
* The schedule generator explodes at most ``splits`` rows per budget item;
  splits is a per-item request argument, not data-sized.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashcurve.functions.exprs import dbl, month_from_text, round_dp
from cashcurve.functions.grouped import listed, running_count


def project_variance(projects: DataFrame, budgets: DataFrame, one_off_expenses: DataFrame) -> DataFrame:
    """I21 + I22 (+ D9, D10): budget vs actual spend per project, status band and burn %."""
    b = budgets.groupBy("project_id").agg(F.sum("total_amount").alias("b"))
    a = (one_off_expenses.filter(F.col("project_id").isNotNull())
         .groupBy("project_id").agg(F.sum("amount").alias("a")))
    p = projects.select(F.col("id").alias("project_id"), "company_id", "project_name")
    j = p.join(b, "project_id", "left").join(a, "project_id", "left")
    budget = F.coalesce(dbl("b"), F.lit(0.0))
    actual = F.coalesce(dbl("a"), F.lit(0.0))
    var = budget - actual
    return j.select(
        "project_id", "company_id", "project_name", budget.alias("total_budget"), actual.alias("total_actuals"),
        var.alias("variance"),
        F.when(var < 0, "Over Budget").when((var > 0) & (actual > 0), "Under Budget").otherwise("On Budget")
         .alias("status"),
        F.when(budget > 0, F.least(actual / budget * 100, F.lit(100.0))).otherwise(F.lit(0.0)).alias("burn_percent"))


def project_cashflow(budgets: DataFrame, installments: DataFrame, whole: bool = True) -> DataFrame:
    """C11 (flat): budget items with their installments, by start date then payment date.

    Items without installments keep one row with NULL installment columns
    (the reference's empty list).
    """
    i = installments.select("budget_item_id", "payment_amount", "expected_payment_date")
    j = budgets.join(i, budgets.id == i.budget_item_id, "left")
    rows = j.select("project_id", F.col("id").alias("budget_item_id"), "item_name", "grouping_category", dbl("total_amount").alias("total_amount"),
                    "start_date", dbl("payment_amount").alias("payment_amount"), "expected_payment_date")
    return listed(rows, "project_id", "start_date", "budget_item_id", "expected_payment_date", "payment_amount", whole=whole)


def project_cashflow_nested(budgets: DataFrame, installments: DataFrame) -> DataFrame:
    """C11: one row per budget item with its installments as a date-ordered list ([] when none).

    A list holds one item's installments, never a project's or a tenant's.
    """
    kids = (installments.join(budgets.select(F.col("id").alias("budget_item_id")), "budget_item_id", "left_semi")
            .groupBy("budget_item_id").agg(F.array_sort(F.collect_list(F.struct(
                "expected_payment_date", dbl("payment_amount").alias("payment_amount")))).alias("installments")))
    empty = F.array().cast("array<struct<expected_payment_date:date,payment_amount:double>>")
    j = budgets.join(kids, budgets.id == kids.budget_item_id, "left")
    return j.select(F.col("id").alias("budget_item_id"), "project_id", "item_name", "grouping_category",
                    dbl("total_amount").alias("total_amount"), "start_date", F.coalesce("installments", empty).alias("installments"))


def project_cashflow_chunks(budgets: DataFrame, installments: DataFrame, size: int = 500) -> DataFrame:
    """C11 for all projects: the nested form with lists of at most ``size`` installments, numbered per item.

    The installments of an item are numbered in date order by a distributed running count, so an item with a third of all of them is no
    single list and no single task; an item without any keeps one row with an empty list.
    """
    rows = installments.select("budget_item_id", "expected_payment_date", dbl("payment_amount").alias("payment_amount"))
    numbered = running_count(rows, "budget_item_id", ["expected_payment_date", "payment_amount"], F.lit(True), "n")
    chunk = F.floor((F.col("n") - 1) / size).cast("int")
    lists = numbered.groupBy("budget_item_id", chunk.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct(
        "n", "expected_payment_date", "payment_amount"))).alias("numbered"))
    entries = F.transform("numbered", lambda x: F.struct(x["expected_payment_date"].alias("expected_payment_date"), x["payment_amount"].alias("payment_amount")))
    empty = F.array().cast("array<struct<expected_payment_date:date,payment_amount:double>>")
    j = budgets.join(lists, budgets.id == lists.budget_item_id, "left")
    return j.select(F.col("id").alias("budget_item_id"), "project_id", "item_name", "grouping_category", dbl("total_amount").alias("total_amount"),
                    "start_date", F.coalesce("chunk", F.lit(0)).alias("chunk"), F.coalesce(entries, empty).alias("installments"))


def item_month_sums(budgets: DataFrame, installments: DataFrame) -> DataFrame:
    """Installments summed per item x 'YYYY-MM' (exact), keyed by project."""
    i = installments.select("budget_item_id", F.date_format("expected_payment_date", "yyyy-MM").alias("month"),
                            "payment_amount")
    s = i.groupBy("budget_item_id", "month").agg(F.sum("payment_amount").alias("amount"))
    return s.join(budgets.select(F.col("id").alias("budget_item_id"), "project_id"), "budget_item_id")


def timeline_matrix(budgets: DataFrame, installments: DataFrame) -> DataFrame:
    """P3 / C13 (sparse): the filled cells of the item x month matrix (sum > 0)."""
    s = item_month_sums(budgets, installments)
    return s.filter(F.col("amount") > 0).select("project_id", "budget_item_id", "month",
                                                dbl("amount").alias("amount"))


def timeline_spine(budgets: DataFrame, installments: DataFrame, pad_left: int = 0, pad_right: int = 0) -> DataFrame:
    """P2 + D14 + P4: contiguous months from the first to the last payment month per project.

    ``pad_left`` / ``pad_right`` extend the spine like the Expand buttons.  The
    spine is bounded by the calendar span, not by the number of payments.
    """
    i = installments.select("budget_item_id", F.trunc("expected_payment_date", "MM").alias("m"))
    b = budgets.select(F.col("id").alias("budget_item_id"), "project_id")
    span = i.join(b, "budget_item_id").groupBy("project_id").agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    lo = F.add_months("lo", -pad_left)
    hi = F.add_months("hi", pad_right)
    months = F.sequence(lo, hi, F.expr("INTERVAL 1 MONTH"))
    e = span.select("project_id", F.posexplode(months).alias("pos", "m"))
    return e.select("project_id", (F.col("pos") + 1).alias("month_index"), F.date_format("m", "yyyy-MM").alias("month"))


def schedule_requests(budgets: DataFrame) -> DataFrame:
    """Split requests derived from the budget rows: splits in -1..5 and an interval of 0/15/30/45 days.

    Deterministic per item, so every edge case of the generator is exercised
    (0 -> 1 split, negative -> none) on the full budget table.
    """
    return budgets.select(F.col("id").alias("budget_item_id"), "total_amount", "start_date",
                          ((F.col("id") % 7) - 1).cast("int").alias("splits"),
                          ((F.col("id") % 4) * 15).cast("int").alias("days"))


def equal_split_payload(requests: DataFrame) -> DataFrame:
    """Nested payload (item + array of installments) from (total, start, splits, days).

    amount = round(total / n, 2) on the float value, as ``toFixed(2)``; a blank
    or 0 split count means 1, a negative one gives no installments (V14 guard
    before ``sequence``); the i-th installment is due start + i*days.
    """
    n = F.when(F.col("splits").isNull() | (F.col("splits") == 0), F.lit(1)).otherwise(F.col("splits"))
    days = F.coalesce(F.col("days"), F.lit(0))
    amt = round_dp(dbl("total_amount") / n, 2)
    idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    inst = F.transform(idx, lambda i: F.struct((i + 1).alias("installment_no"), amt.alias("payment_amount"),
                                               F.date_add("start_date", i * days).alias("expected_payment_date")))
    return requests.select("budget_item_id", dbl("total_amount").alias("total_amount"), "start_date",
                           n.alias("splits"), inst.alias("installments"),
                           (dbl("total_amount") - amt * F.greatest(n, F.lit(0))).alias("residual"))


def split_parent_child(payload: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One nested input -> parent rows (without the list) and child rows (exploded list)."""
    parent = payload.drop("installments")
    child = payload.select("budget_item_id", "residual", F.explode("installments").alias("i")).select(
        "budget_item_id", "i.installment_no", "i.payment_amount", "i.expected_payment_date", "residual")
    return parent, child


def move_requests(budgets: DataFrame, installments: DataFrame) -> DataFrame:
    """P5 requests derived from the data: every item moves its first payment month to its start month.

    Items whose first payment already falls in the start month are the
    "move to the same month" case (a no-op that still matches).
    """
    first = installments.groupBy("budget_item_id").agg(F.min("expected_payment_date").alias("d"))
    b = budgets.select(F.col("id").alias("budget_item_id"), "start_date")
    j = b.join(first, "budget_item_id")
    return j.select("budget_item_id", F.date_format("d", "yyyy-MM").alias("old_month"),
                    F.date_format("start_date", "yyyy-MM").alias("new_month"))


def move_payments(installments: DataFrame, moves: DataFrame) -> DataFrame:
    """P5: installments of (item, old month) move to the 1st of the new month; others unchanged."""
    i = installments.withColumn("ym", F.date_format("expected_payment_date", "yyyy-MM"))
    mv = moves.select("budget_item_id", F.col("old_month").alias("ym"), "new_month")
    j = i.join(mv, ["budget_item_id", "ym"], "left")
    moved = F.col("new_month").isNotNull()
    return j.select("budget_item_id", dbl("payment_amount").alias("payment_amount"),
                    F.when(moved, month_from_text("new_month")).otherwise(F.col("expected_payment_date"))
                    .alias("expected_payment_date"), moved.alias("moved"))
