"""Forecast P&L operators: B2 B5 B6 B11 C1-C3 C8 D1-D4 D8 D12 E1 E4 F1-F3 I1-I5.

Plan shape (all tenants at once): entries are aggregated to company x month
first (partial + final hash aggregate); everything joined afterwards is bounded
by companies x months.  Windows partition by ``company_id`` and only ever see
company-month rows, so a tenant holding a third of all entries is still only
~100 rows per window partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cashcurve.functions.exprs import round_dp, dbl, ratio


def forecast_details(entries: DataFrame, products: DataFrame) -> DataFrame:
    """B5 + C1: override-or-default price/COGS and per-entry revenue, cost, gross profit."""
    p = products.select(F.col("id").alias("p_id"), F.col("name").alias("product_name"),
                        "default_sales_price", "default_cogs")
    j = entries.join(p, entries.product_id == p.p_id, "inner")
    price = F.coalesce("price_override", "default_sales_price")
    cogs = F.coalesce("cogs_override", "default_cogs")
    rev = F.col("units_forecasted") * price
    vc = F.col("units_forecasted") * cogs
    return j.select(
        F.col("id").alias("forecast_id"), "company_id", "forecast_month", "product_name",
        "units_forecasted", price.alias("final_price"), cogs.alias("final_cogs"),
        rev.alias("total_revenue"), vc.alias("total_variable_cost"), (rev - vc).alias("gross_profit"),
    )


def monthly_pl(details: DataFrame) -> DataFrame:
    """Revenue, variable costs and gross profit per company x month (exact decimal sums)."""
    return details.groupBy("company_id", "forecast_month").agg(
        F.sum("total_revenue").alias("revenue"),
        F.sum("total_variable_cost").alias("variable_costs"),
        F.sum("gross_profit").alias("gross_profit"),
    )


def monthly_fixed_costs(fixed_expenses: DataFrame) -> DataFrame:
    """Only frequency = 'monthly' bills count here."""
    return (fixed_expenses.filter(F.col("frequency") == "monthly")
            .groupBy("company_id").agg(F.sum("amount").alias("total_bills")))


def all_frequency_burn(fixed_expenses: DataFrame) -> DataFrame:
    """D3: every frequency summed un-normalised (S1); NULL -> 0 is applied by the consumer."""
    return fixed_expenses.groupBy("company_id").agg(F.sum("amount").alias("burn"))


def weighted_pipeline(leads: DataFrame) -> DataFrame:
    """D4 + B7: sum(contract_value * probability / 100), exact in decimal."""
    w = F.col("contract_value") * F.col("probability") * F.lit("0.01").cast("decimal(3,2)")
    return leads.groupBy("company_id").agg(F.coalesce(F.sum(w), F.lit(0)).alias("weighted_pipeline_value"))


def financial_health_exact(details: DataFrame, fixed_expenses: DataFrame, leads: DataFrame) -> DataFrame:
    """I1 with decimal money columns (internal form used by the other operators)."""
    md = monthly_pl(details)
    core = (md.join(monthly_fixed_costs(fixed_expenses), "company_id", "left")
            .join(weighted_pipeline(leads), "company_id", "left"))
    fixed = F.coalesce(F.col("total_bills"), F.lit(0).cast("decimal(19,4)"))
    gp, rev = F.col("gross_profit"), F.col("revenue")
    margin = ratio(gp, rev)
    w = (Window.partitionBy("company_id").orderBy("forecast_month")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (core.select(
        "company_id", "forecast_month", "revenue", "variable_costs", "gross_profit",
        fixed.alias("fixed_costs"),
        (gp - fixed).alias("net_profit"),
        round_dp(margin * 100, 2).alias("gross_margin_percent"),
        # Fixed / (gp / rev) when gp > 0 else 0; rev = 0 -> NULL
        F.when(gp > 0, round_dp(dbl(fixed) / margin, 2)).otherwise(F.lit(0.0)).alias("revenue_needed_to_break_even"),
        F.coalesce(F.col("weighted_pipeline_value"), F.lit(0)).alias("weighted_pipeline_value"),
    ).withColumn("ytd_net_profit", F.sum("net_profit").over(w)))


MONEY_COLS_I1 = ["revenue", "variable_costs", "gross_profit", "fixed_costs", "net_profit",
                 "weighted_pipeline_value", "ytd_net_profit"]


def to_output(df: DataFrame, money_cols: list[str]) -> DataFrame:
    """Decimals leave as double (the API's float); other columns unchanged."""
    return df.select(*[dbl(c).alias(c) if c in money_cols else F.col(c) for c in df.columns])


def financial_health(details: DataFrame, fixed_expenses: DataFrame, leads: DataFrame) -> DataFrame:
    """I1 (view_financial_health) as API output."""
    return to_output(financial_health_exact(details, fixed_expenses, leads), MONEY_COLS_I1)


def break_even(health: DataFrame) -> DataFrame:
    """I2 projection: the break-even revenue and the inputs it is computed from."""
    return health.select("company_id", "forecast_month", "revenue", "gross_profit", "fixed_costs",
                         "gross_margin_percent", "revenue_needed_to_break_even")


def monthly_summary(details: DataFrame, fixed_expenses: DataFrame) -> DataFrame:
    """I3 / C8 (view_monthly_summary): all-frequency fixed costs, pre-aggregated and joined (V2)."""
    md = details.groupBy("company_id", "forecast_month").agg(
        F.sum("total_revenue").alias("monthly_revenue"),
        F.sum("total_variable_cost").alias("monthly_cogs"),
        F.sum("gross_profit").alias("gp"))
    burn = all_frequency_burn(fixed_expenses)
    j = md.join(burn, "company_id", "left")
    fixed = F.coalesce(F.col("burn"), F.lit(0).cast("decimal(19,4)"))
    return j.select("company_id", "forecast_month", dbl("monthly_revenue").alias("monthly_revenue"),
                    dbl("monthly_cogs").alias("monthly_cogs"), dbl(fixed).alias("monthly_fixed_costs"),
                    dbl(F.col("gp") - fixed).alias("net_profit"))


def month_drilldown(entries: DataFrame, products: DataFrame, month: str) -> DataFrame:
    """B2: entries of one month (every company) with product name and revenue at override-or-default price."""
    e = entries.filter(F.col("forecast_month") == F.lit(month).cast("date"))
    p = products.select(F.col("id").alias("p_id"), "name", "default_sales_price")
    j = e.join(p, e.product_id == p.p_id, "inner")
    return j.select("company_id", "id", "name", "units_forecasted",
                    dbl(F.col("units_forecasted") * F.coalesce("price_override", "default_sales_price")).alias("revenue"))


def unit_margin(details: DataFrame) -> DataFrame:
    """Contribution margin per unit and its ratio (NULL unless price > 0)."""
    price, cogs = F.col("final_price"), F.col("final_cogs")
    return details.select(
        "company_id", "forecast_id", "product_name", "forecast_month", "units_forecasted",
        dbl(price).alias("final_price"), dbl(cogs).alias("final_cogs"), dbl(price - cogs).alias("cm_per_unit"),
        F.when(price > 0, round_dp(ratio(price - cogs, price) * 100.0, 2)).alias("cm_ratio_percent"))


def trend_series(health: DataFrame) -> DataFrame:
    """Month, revenue and break-even revenue (chart series)."""
    return health.select("company_id", "forecast_month", "revenue", "revenue_needed_to_break_even")


def afloat_status(health: DataFrame) -> DataFrame:
    """I4: Afloat when revenue >= break-even revenue; a NULL break-even compares false -> Sinking."""
    be = F.col("revenue_needed_to_break_even")
    return health.select(
        "company_id", "forecast_month", "revenue", "revenue_needed_to_break_even", "net_profit",
        F.when(F.col("revenue") >= be, "Afloat").otherwise("Sinking").alias("status"))


def product_revenue(entries: DataFrame, products: DataFrame) -> DataFrame:
    """Revenue by product *name* per company (same-named products merge, S10)."""
    p = products.select(F.col("id").alias("p_id"), "name", "default_sales_price")
    j = entries.join(p, entries.product_id == p.p_id, "inner")
    rev = F.col("units_forecasted") * F.coalesce("price_override", "default_sales_price")
    return j.groupBy("company_id", "name").agg(F.sum(rev).alias("total_revenue"))


def top_products(entries: DataFrame, products: DataFrame, k: int = 5) -> DataFrame:
    """top-k product names by revenue per company (row_number per company; ties by name)."""
    from cashcurve.functions.exprs import clamp
    k = clamp(k, 1, 10, 5)
    r = product_revenue(entries, products)
    w = Window.partitionBy("company_id").orderBy(F.col("total_revenue").desc_nulls_first(), F.col("name").asc())
    return (r.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("company_id", "rank", "name", dbl("total_revenue").alias("total_revenue")))


def recent_months(health: DataFrame, months: int = 3) -> DataFrame:
    """the last n forecast months per company (n clamped to 1..12)."""
    from cashcurve.functions.exprs import clamp
    n = clamp(months, 1, 12, 3)
    w = Window.partitionBy("company_id").orderBy(F.col("forecast_month").desc())
    return (health.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= n)
            .select("company_id", "recency", "forecast_month", "revenue", "net_profit",
                    "gross_margin_percent", "revenue_needed_to_break_even"))


def pipeline_coverage(health_exact: DataFrame) -> DataFrame:
    """I5 + D12 + E4: shortfall over loss months vs the pipeline, banded.

    One aggregate per company over the *decimal* health rows: shortfall =
    sum(|net profit|) over loss months, pipeline = value of the first month
    (constant per company), fixed costs = first row (S19), YTD = last row.
    No collect, no per-company loop.
    """
    np_ = F.col("net_profit")
    g = health_exact.groupBy("company_id").agg(
        F.coalesce(F.sum(F.when(np_ < 0, -np_)), F.lit(0).cast("decimal(19,4)")).alias("shortfall_d"),
        F.min_by("weighted_pipeline_value", "forecast_month").alias("pipeline"),
        F.min_by("fixed_costs", "forecast_month").alias("fixed_costs"),
        F.max_by("ytd_net_profit", "forecast_month").alias("ytd_net_profit"),
        F.count(F.lit(1)).alias("months"),
    )
    g = g.select("company_id", "months", dbl("shortfall_d").alias("shortfall"), dbl("pipeline").alias("pipeline"),
                 dbl("fixed_costs").alias("fixed_costs"), dbl("ytd_net_profit").alias("ytd_net_profit"))
    cov = F.when(F.col("shortfall") > 0, F.col("pipeline") / F.col("shortfall") * 100).otherwise(F.lit(100.0))
    return g.select(
        "company_id", "months", "shortfall", "pipeline", "fixed_costs", "ytd_net_profit",
        cov.alias("coverage_percent"),
        F.when(cov >= 100, "HEALTHY").when(cov >= 50, "AT RISK").otherwise("CRITICAL").alias("coverage_status"))
