"""Metrics the reference declares (glossaries, empty fields) but does not compute: X1-X4.

All are two-level aggregates (per entity, then per company) with map-side
partial aggregation; no distinct-count over a whole company in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cashcurve.functions.exprs import dbl, first_of_month, money, round_dp


def gmv_aov(order_company: DataFrame) -> DataFrame:
    """Gross merchandise value and average order value per company x month."""
    o = order_company.select(F.col("c_nationkey").alias("company_id"), first_of_month("o_orderdate").alias("month"),
                             money("o_totalprice").alias("v"))
    g = o.groupBy("company_id", "month").agg(F.sum("v").alias("gmv"), F.count(F.lit(1)).alias("orders"))
    return g.select("company_id", "month", dbl("gmv").alias("gmv"), "orders",
                    round_dp(dbl("gmv") / F.col("orders"), 2).alias("aov"))


def conversion_rate(events: DataFrame, n_companies: int) -> DataFrame:
    """Share of visitors (users with a view) who also purchased, per company (user_id % n)."""
    u = events.groupBy((F.col("user_id") % n_companies).cast("int").alias("company_id"), "user_id").agg(
        F.bool_or(F.col("event_type") == "view").alias("viewed"),
        F.bool_or(F.col("event_type") == "purchase").alias("bought"))
    g = u.groupBy("company_id").agg(F.count(F.when(F.col("viewed"), True)).alias("visitors"),
                                    F.count(F.when(F.col("viewed") & F.col("bought"), True)).alias("converted"))
    return g.select("company_id", "visitors", "converted",
                    F.when(F.col("visitors") > 0, round_dp(F.col("converted") / F.col("visitors") * 100, 2))
                    .alias("conversion_percent"))


def repeat_rate(order_company: DataFrame) -> DataFrame:
    """Customers with two or more orders over customers with any order, per company."""
    c = order_company.groupBy(F.col("c_nationkey").alias("company_id"), "o_custkey").agg(
        F.count(F.lit(1)).alias("n"))
    g = c.groupBy("company_id").agg(F.count(F.lit(1)).alias("customers"),
                                    F.count(F.when(F.col("n") >= 2, True)).alias("repeat_customers"))
    return g.select("company_id", "customers", "repeat_customers",
                    round_dp(F.col("repeat_customers") / F.col("customers") * 100, 2).alias("repeat_percent"))


def retention(order_company: DataFrame) -> DataFrame:
    """Per company and month, the share of customers with an order who order again in the next calendar month.

    One window per customer over its months; a customer's months are bounded by the calendar.
    """
    months = order_company.select(F.col("c_nationkey").alias("company_id"), "o_custkey", first_of_month("o_orderdate").alias("month")).distinct()
    w = Window.partitionBy("company_id", "o_custkey").orderBy("month")
    again = F.lead("month").over(w) == F.add_months("month", 1)
    g = months.withColumn("again", F.coalesce(again, F.lit(False))).groupBy("company_id", "month").agg(
        F.count(F.lit(1)).alias("customers"), F.count(F.when(F.col("again"), True)).alias("retained"))
    return g.select("company_id", "month", "customers", "retained",
                    round_dp(F.col("retained") / F.col("customers") * 100, 2).alias("retention_percent"))


def ltv(kpi_rows: DataFrame) -> DataFrame:
    """LTV = ARPA x gross margin / monthly logo churn, per company x month (NULL without churn).

    ``kpi_rows`` are KPI rows that carry ``mau``.
    """
    arpa = F.col("mrr") / F.col("mau")
    val = arpa * (F.col("gross_margin_percent") / 100.0) / (F.col("monthly_churn_percent") / 100.0)
    return kpi_rows.select("company_id", "month_date", round_dp(arpa, 2).alias("arpa"),
                           F.when((F.col("monthly_churn_percent") > 0) & F.col("gross_margin_percent").isNotNull(),
                                  round_dp(val, 2)).alias("ltv"))
