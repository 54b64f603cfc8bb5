"""Runway and list operators: B7-B9 C12 D3-D5 E3 I6-I8 I23.

The reference answers one company with five sequential queries.  Here every
input is pre-aggregated to one row per company (partial + final hash
aggregates, so a tenant holding a third of all rows is combined map-side) and
the five single-row aggregates are left-joined to the company dimension.
"Latest row" lookups use ``max_by`` over a (date, id) struct instead of a
window, which keeps them inside the same aggregate and skew-proof.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashcurve.functions.exprs import dbl, one_decimal
from cashcurve.functions.grouped import listed

INFINITE_MESSAGE = "Infinite runway - no expenses logged"


def latest_by(df: DataFrame, key: str, order_cols: list[str], value_cols: list[str]) -> DataFrame:
    """Value columns of the newest row per ``key`` (ties broken by the later order columns, S9)."""
    order = F.struct(*order_cols)
    return df.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in value_cols],
                               F.max(order).alias("_latest"))


def latest_cash(cash_balances: DataFrame) -> DataFrame:
    """Newest balance per company: ORDER BY balance_date DESC, id DESC LIMIT 1."""
    l = latest_by(cash_balances, "company_id", ["balance_date", "id"], ["total_cash"])
    return l.select("company_id", "total_cash", F.col("_latest.balance_date").alias("balance_date"))


def capex_total(one_off_expenses: DataFrame) -> DataFrame:
    """Total one-off spend per company."""
    return one_off_expenses.groupBy("company_id").agg(F.sum("amount").alias("capex"))


def latest_month_revenue(health: DataFrame) -> DataFrame:
    """Revenue of the latest forecast month per company (from I1)."""
    l = latest_by(health, "company_id", ["forecast_month"], ["revenue", "gross_margin_percent", "net_profit"])
    return l.select("company_id", F.col("revenue").alias("latest_month_revenue"),
                    F.col("gross_margin_percent").alias("latest_gross_margin_percent"),
                    F.col("net_profit").alias("latest_net_profit"),
                    F.col("_latest.forecast_month").alias("latest_forecast_month"))


def runway_inputs(companies: DataFrame, cash_balances: DataFrame, fixed_expenses: DataFrame,
                  leads: DataFrame, one_off_expenses: DataFrame, health: DataFrame) -> DataFrame:
    """One row per company with every runway input; absent or zero sums are 0.0 (`or 0`)."""
    from cashcurve.operators.forecast import all_frequency_burn, weighted_pipeline
    c = companies.select(F.col("id").alias("company_id"))
    j = (c.join(latest_cash(cash_balances), "company_id", "left")
         .join(all_frequency_burn(fixed_expenses), "company_id", "left")
         .join(weighted_pipeline(leads).withColumnRenamed("weighted_pipeline_value", "expected"),
               "company_id", "left")
         .join(capex_total(one_off_expenses), "company_id", "left")
         .join(latest_month_revenue(health), "company_id", "left"))
    z = F.lit(0.0)
    return j.select(
        "company_id",
        F.coalesce(dbl("total_cash"), z).alias("starting_cash"),
        F.coalesce(dbl("burn"), z).alias("burn_rate"),
        F.coalesce(dbl("expected"), z).alias("expected_cash"),
        F.coalesce(dbl("capex"), z).alias("capex"),
        F.coalesce(dbl("latest_month_revenue"), z).alias("latest_month_revenue"),
    )


def runway(inputs: DataFrame) -> DataFrame:
    """I6 + I7: pipeline-adjusted runway months, message and colour band."""
    burn = F.col("burn_rate")
    months = F.when(burn != 0, (F.col("starting_cash") + F.col("expected_cash") - F.col("capex")) / burn)
    return inputs.select(
        "company_id", "starting_cash", "burn_rate", "expected_cash", "capex",
        months.alias("estimated_months_left"),
        F.when(burn == 0, F.lit(INFINITE_MESSAGE))
         .otherwise(F.concat(one_decimal(months), F.lit(" months"))).alias("status_message"),
        F.when(burn == 0, "Green").when(months >= 6, "Green").when(months >= 3, "Yellow")
         .otherwise("Red").alias("status_color"),
    )


def net_burn_runway(inputs: DataFrame) -> DataFrame:
    """I8: net burn = gross burn - latest month revenue; runway = cash / net burn if > 0."""
    nb = F.col("burn_rate") - F.col("latest_month_revenue")
    return inputs.select(
        "company_id", "starting_cash", F.col("burn_rate").alias("gross_burn"), "latest_month_revenue",
        nb.alias("net_burn"),
        F.when(nb > 0, F.col("starting_cash") / nb).alias("runway_net_burn_months"))


def liquidity(inputs: DataFrame) -> DataFrame:
    """The four liquidity tile figures per company."""
    return inputs.select("company_id", "starting_cash", "burn_rate", "expected_cash", "capex")


def weighted_leads(leads: DataFrame) -> DataFrame:
    """Per-lead weighted value as the planner computes it (float value x probability/100)."""
    return leads.select("id", "company_id", "client_name", dbl("contract_value").alias("contract_value"),
                        "probability",
                        (dbl("contract_value") * (F.col("probability") / F.lit(100.0))).alias("weighted_value"))


def lead_list(leads: DataFrame, whole: bool = True) -> DataFrame:
    """Leads by company, probability desc (NULLs first as in PostgreSQL, id as tie-break)."""
    rows = leads.select("company_id", "id", "client_name", dbl("contract_value").alias("contract_value"), "probability", "expected_close_date")
    return listed(rows, F.col("company_id"), F.col("probability").desc_nulls_first(), F.col("id"), whole=whole)


def cash_history(cash_balances: DataFrame, whole: bool = True) -> DataFrame:
    """Balances per company, newest first (id desc breaks same-day ties)."""
    rows = cash_balances.select("company_id", "id", "balance_date", dbl("total_cash").alias("total_cash"))
    return listed(rows, "company_id", F.col("balance_date").desc(), F.col("id").desc(), whole=whole)


def one_off_history(one_off_expenses: DataFrame, whole: bool = True) -> DataFrame:
    """One-off expenses per company, oldest first (name breaks same-day ties)."""
    rows = one_off_expenses.select("company_id", "project_id", "name", dbl("amount").alias("amount"), "expense_date")
    return listed(rows, "company_id", "expense_date", "name", whole=whole)


def project_list(projects: DataFrame, whole: bool = True) -> DataFrame:
    """Projects per company, id desc."""
    return listed(projects.select("company_id", "id", "project_name", "status"), "company_id", F.col("id").desc(), whole=whole)
