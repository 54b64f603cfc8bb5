"""Query keys for steps 1-2 (forecast P&L): I1 I2 B5 I3 B2 B6 B11 D8/F1 F3 I4 I5."""

from __future__ import annotations

from pyspark.sql import functions as F

from cashcurve.operators import forecast as fc
from cashcurve.plans.oracle_tables import with_tables
from cashcurve.plans.registry import register
from cashcurve.sources.model import tenant_group, ModelTables

DRILLDOWN_MONTH = "1998-06-01"   # B2 parameter (the drill-down month; every company)
TOP_K = 5                        # F1 fixed k
RECENT_MONTHS = 3                # F3 default n


def details_of(m: ModelTables):
    return fc.forecast_details(m.forecast_entries, m.products)


def health_exact_of(m: ModelTables):
    return fc.financial_health_exact(details_of(m), m.fixed_expenses, m.leads)


def health_of(m: ModelTables):
    return fc.financial_health(details_of(m), m.fixed_expenses, m.leads)


@register("financial_health", oracle=with_tables(["health"], "SELECT * FROM health"))
def q_financial_health(spark, sf_dir):
    return health_of(ModelTables(spark, sf_dir))


@register("forecast_details", oracle=with_tables(["details"], """
    SELECT forecast_id, company_id, forecast_month, product_name, units_forecasted,
           CAST(final_price AS DOUBLE) AS final_price, CAST(final_cogs AS DOUBLE) AS final_cogs,
           CAST(total_revenue AS DOUBLE) AS total_revenue,
           CAST(total_variable_cost AS DOUBLE) AS total_variable_cost,
           CAST(gross_profit AS DOUBLE) AS gross_profit
    FROM details"""))
def q_forecast_details(spark, sf_dir):
    d = details_of(ModelTables(spark, sf_dir))
    return fc.to_output(d, ["final_price", "final_cogs", "total_revenue", "total_variable_cost", "gross_profit"])


@register("break_even", oracle=with_tables(["health"], """
    SELECT company_id, forecast_month, revenue, gross_profit, fixed_costs, gross_margin_percent,
           revenue_needed_to_break_even
    FROM health"""))
def q_break_even(spark, sf_dir):
    return fc.break_even(health_of(ModelTables(spark, sf_dir)))


@register("monthly_summary", oracle=with_tables(["details", "fixed_expenses"], """
    SELECT d.company_id, d.forecast_month,
           CAST(SUM(d.total_revenue) AS DOUBLE) AS monthly_revenue,
           CAST(SUM(d.total_variable_cost) AS DOUBLE) AS monthly_cogs,
           CAST(COALESCE(fx.burn, 0) AS DOUBLE) AS monthly_fixed_costs,
           CAST(SUM(d.gross_profit) - COALESCE(fx.burn, 0) AS DOUBLE) AS net_profit
    FROM details d
    LEFT JOIN (SELECT company_id, SUM(amount) AS burn FROM fixed_expenses GROUP BY company_id) fx
      ON fx.company_id = d.company_id
    GROUP BY d.company_id, d.forecast_month, fx.burn"""))
def q_monthly_summary(spark, sf_dir):
    m = ModelTables(spark, sf_dir)
    return fc.monthly_summary(details_of(m), m.fixed_expenses)


@register("month_drilldown", oracle=with_tables(["forecast_entries", "products"], f"""
    SELECT f.company_id, f.id, p.name, f.units_forecasted,
           CAST(f.units_forecasted * COALESCE(f.price_override, p.default_sales_price) AS DOUBLE) AS revenue
    FROM forecast_entries f JOIN products p ON f.product_id = p.id
    WHERE f.forecast_month = DATE '{DRILLDOWN_MONTH}'"""))
def q_month_drilldown(spark, sf_dir):
    m = ModelTables(spark, sf_dir)
    return fc.month_drilldown(m.forecast_entries, m.products, DRILLDOWN_MONTH)


@register("unit_margin", oracle=with_tables(["details"], """
    SELECT company_id, forecast_id, product_name, forecast_month, units_forecasted,
           CAST(final_price AS DOUBLE) AS final_price, CAST(final_cogs AS DOUBLE) AS final_cogs,
           CAST(final_price - final_cogs AS DOUBLE) AS cm_per_unit,
           CASE WHEN final_price > 0 THEN
             ROUND(CAST(final_price - final_cogs AS DOUBLE) / CAST(final_price AS DOUBLE) * 100.0, 2)
           END AS cm_ratio_percent
    FROM details"""))
def q_unit_margin(spark, sf_dir):
    return fc.unit_margin(details_of(ModelTables(spark, sf_dir)))


@register("trend_series", oracle=with_tables(["health"], """
    SELECT company_id, forecast_month, revenue, revenue_needed_to_break_even FROM health"""))
def q_trend_series(spark, sf_dir):
    return fc.trend_series(health_of(ModelTables(spark, sf_dir)))


@register("top_products", oracle=with_tables(["forecast_entries", "products"], f"""
    SELECT company_id, rank, name, CAST(total_revenue AS DOUBLE) AS total_revenue FROM (
      SELECT company_id, name, total_revenue,
             CAST(row_number() OVER (PARTITION BY company_id ORDER BY total_revenue DESC NULLS FIRST, name ASC) AS INTEGER) AS rank
      FROM (SELECT f.company_id, p.name,
                   SUM(f.units_forecasted * COALESCE(f.price_override, p.default_sales_price)) AS total_revenue
            FROM forecast_entries f JOIN products p ON f.product_id = p.id
            GROUP BY f.company_id, p.name) r) t
    WHERE rank <= {TOP_K}"""))
def q_top_products(spark, sf_dir):
    m = ModelTables(spark, sf_dir)
    return fc.top_products(m.forecast_entries, m.products, TOP_K)


@register("recent_months", oracle=with_tables(["health"], f"""
    SELECT company_id, recency, forecast_month, revenue, net_profit, gross_margin_percent,
           revenue_needed_to_break_even FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY company_id ORDER BY forecast_month DESC) AS INTEGER) AS recency
      FROM health) t
    WHERE recency <= {RECENT_MONTHS}"""))
def q_recent_months(spark, sf_dir):
    return fc.recent_months(health_of(ModelTables(spark, sf_dir)), RECENT_MONTHS)


@register("afloat_status", oracle=with_tables(["health"], """
    SELECT company_id, forecast_month, revenue, revenue_needed_to_break_even, net_profit,
           CASE WHEN revenue >= revenue_needed_to_break_even THEN 'Afloat' ELSE 'Sinking' END AS status
    FROM health"""))
def q_afloat_status(spark, sf_dir):
    return fc.afloat_status(health_of(ModelTables(spark, sf_dir)))


@register("pipeline_coverage", oracle=with_tables(["health_exact"], """
    SELECT company_id, months, shortfall, pipeline, fixed_costs, ytd_net_profit, coverage_percent,
           CASE WHEN coverage_percent >= 100 THEN 'HEALTHY' WHEN coverage_percent >= 50 THEN 'AT RISK'
                ELSE 'CRITICAL' END AS coverage_status
    FROM (
      SELECT *, CASE WHEN shortfall > 0 THEN pipeline / shortfall * 100 ELSE 100.0 END AS coverage_percent
      FROM (
        SELECT company_id, count(*) AS months,
               CAST(COALESCE(SUM(CASE WHEN net_profit < 0 THEN -net_profit END), 0) AS DOUBLE) AS shortfall,
               CAST(arg_min(weighted_pipeline_value, forecast_month) AS DOUBLE) AS pipeline,
               CAST(arg_min(fixed_costs, forecast_month) AS DOUBLE) AS fixed_costs,
               CAST(arg_max(ytd_net_profit, forecast_month) AS DOUBLE) AS ytd_net_profit
        FROM health_exact GROUP BY company_id) a) b"""))
def q_pipeline_coverage(spark, sf_dir):
    return fc.pipeline_coverage(health_exact_of(ModelTables(spark, sf_dir)))


@register("dashboard_json", no_oracle="JSON text formatting differs between engines; tests parse it back")
def q_dashboard_json(spark, sf_dir):
    """The dashboard rows (I1) as API JSON documents, one per company-month."""
    from cashcurve.operators.sinks import to_json_rows
    return to_json_rows(health_of(ModelTables(spark, sf_dir)), ["company_id", "forecast_month"])


@register("dashboard_json_parsed", oracle=with_tables(["health"], "SELECT * REPLACE (strftime(forecast_month, '%Y-%m-%d') AS forecast_month) FROM health"))
def q_dashboard_json_parsed(spark, sf_dir):
    """The documents of ``dashboard_json`` parsed back."""
    docs = q_dashboard_json(spark, sf_dir)
    health = health_of(ModelTables(spark, sf_dir))
    kinds = ", ".join(f"{f.name} {'string' if f.name == 'forecast_month' else f.dataType.simpleString()}" for f in health.schema.fields)
    return docs.select(F.from_json("json", kinds).alias("d")).select("d.*")


@register("financial_health_v1", oracle=with_tables(["health"], """
    SELECT company_id, forecast_month, revenue, gross_profit, fixed_costs, net_profit, gross_margin_percent,
           revenue_needed_to_break_even
    FROM health"""))
def q_financial_health_v1(spark, sf_dir):
    """The earlier view version (no variable costs, pipeline or running total) -- a projection of I1."""
    return health_of(ModelTables(spark, sf_dir)).select(
        "company_id", "forecast_month", "revenue", "gross_profit", "fixed_costs", "net_profit",
        "gross_margin_percent", "revenue_needed_to_break_even")


@register("tenant_list_forecast", oracle=with_tables(["forecast_entries"], """
    SELECT f.company_id, f.forecast_month, count(*) AS entries, CAST(sum(f.units_forecasted) AS BIGINT) AS units
    FROM forecast_entries f JOIN nation n ON n.n_nationkey = f.company_id WHERE n.n_regionkey = 2 GROUP BY 1, 2"""))
def q_tenant_list_forecast(spark, sf_dir):
    """B1 for a list of tenants: a request table names the companies, and only their directories of the clustered store are read."""
    m = ModelTables(spark, sf_dir)
    asked = m.raw.nation.filter(F.col("n_regionkey") == 2).select(F.col("n_nationkey").cast("int").alias("company_id"))
    asked = asked.withColumn("tenants", tenant_group("company_id"))
    return (m.forecast_by_tenant.join(asked, ["tenants", "company_id"]).groupBy("company_id", "forecast_month")
            .agg(F.count(F.lit(1)).alias("entries"), F.sum("units_forecasted").alias("units")))
