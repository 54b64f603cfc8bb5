"""Accounting actuals reports: B3 B4 C4 C5 D7 F4 F5.

Inputs are the accepted ledger lines (``operators.ledger``).  Every report is
computed for all companies at once; per-company row limits (the reference's
``LIMIT``) are ``row_number() <= n`` windows, which Spark plans as a partial
``WindowGroupLimit`` before the shuffle, so a hot company sends at most n rows
per task to the final ranking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cashcurve.functions.exprs import clamp, dbl
from cashcurve.functions.grouped import listed

BASES = ("accrual", "cash")


def actuals_summary(lines: DataFrame) -> DataFrame:
    """Actuals by company x month x basis x currency (currencies never converted, S11)."""
    return (lines.groupBy("company_id", F.trunc("posted_date", "MM").alias("month"), "basis", "currency")
            .agg(dbl(F.sum("amount")).alias("total_amount")))


def actuals_lines(lines: DataFrame, leads: DataFrame, basis: str | None = None, limit: int = 200) -> DataFrame:
    """B3 + C4: newest lines per company (optional basis filter, limit clamped 1..2000) with the lead's name."""
    n = clamp(limit, 1, 2000, 200)
    l = lines.filter(F.col("basis") == basis) if basis in BASES else lines
    w = Window.partitionBy("company_id").orderBy(F.col("posted_date").desc(), F.col("idempotency_key").desc())
    top = l.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)
    ld = leads.select(F.col("id").alias("lead_id"), F.col("client_name").alias("linked_lead_name"))
    j = top.join(ld, "lead_id", "left")
    return j.select("company_id", "position", "provider", "basis", "line_kind", "external_invoice_id",
                    "external_payment_id", "contact_name", dbl("amount").alias("amount"), "currency", "posted_date",
                    "idempotency_key", "lead_id", "linked_lead_name")


def actuals_snapshot(lines: DataFrame, as_of: str) -> DataFrame:
    """Accrual and cash totals of the as-of month per company and currency (currency kept as key, S22).

    The month is a range of ``posted_date`` applied before the aggregate, so it reaches the scan of the lines.
    """
    month = F.trunc(F.lit(as_of).cast("date"), "MM")
    m = actuals_summary(lines.filter((F.col("posted_date") >= month) & (F.col("posted_date") < F.add_months(month, 1))))
    return m.groupBy("company_id", "currency").agg(
        F.max(F.when(F.col("basis") == "accrual", F.col("total_amount"))).alias("accrual_total"),
        F.max(F.when(F.col("basis") == "cash", F.col("total_amount"))).alias("cash_total"))


def lead_links_list(links: DataFrame, leads: DataFrame, whole: bool = True) -> DataFrame:
    """Contact links with the lead's client name (inner join), newest link first."""
    ld = leads.select(F.col("id").alias("lead_id"), "client_name")
    rows = links.join(ld, "lead_id", "inner").select("company_id", "id", "lead_id", "provider", "external_contact_id", "client_name")
    return listed(rows, "company_id", F.col("id").desc(), whole=whole)


def recent_actuals(summary: DataFrame, months: int = 6) -> DataFrame:
    """the first 2 x months summary rows per company by (month desc, basis) -- a row limit."""
    n = clamp(months, 1, 24, 6)
    w = Window.partitionBy("company_id").orderBy(F.col("month").desc(), F.col("basis"), F.col("currency"))
    return (summary.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= 2 * n)
            .select("company_id", "position", "month", "basis", "currency", "total_amount"))
