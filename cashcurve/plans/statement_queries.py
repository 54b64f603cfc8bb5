"""Query keys for step 4 (statements): I9 I10 I11 I12 I13 X5."""

from __future__ import annotations

from pyspark.sql import functions as F

from cashcurve.operators import statements as st
from cashcurve.plans.actuals_queries import lines_of
from cashcurve.plans.forecast_queries import health_exact_of, health_of
from cashcurve.plans.ledger_queries import LEDGER_CTES
from cashcurve.plans.oracle_tables import with_tables
from cashcurve.plans.registry import ORACLE, register
from cashcurve.sources.model import ModelTables

R40_CTE = ("r40", """
    SELECT company_id, forecast_month, revenue, net_profit, yoy AS yoy_growth_percent, margin AS net_margin_percent,
           CASE WHEN yoy IS NOT NULL AND margin IS NOT NULL THEN round_even(yoy + margin, 2) END AS rule_of_40
    FROM (SELECT *, CASE WHEN pos > 12 AND prev > 0 THEN round_even((revenue - prev) / prev * 100, 2) END AS yoy,
                 CASE WHEN revenue > 0 THEN round_even(net_profit / revenue * 100, 2) END AS margin
          FROM (SELECT *, row_number() OVER w AS pos, COALESCE(lag(revenue, 12) OVER w, 0) AS prev
                FROM health WINDOW w AS (PARTITION BY company_id ORDER BY forecast_month)) a) b""")
DOL_CTE = ("dol_t", """
    SELECT company_id, forecast_month, gross_profit, net_profit,
           CASE WHEN COALESCE(net_profit, 0) <> 0
                THEN round_even(COALESCE(gross_profit, 0) / COALESCE(net_profit, 0), 4) END AS dol
    FROM health""")
LATEST_CASH_CTE = ("latest_cash", """
    SELECT company_id, balance_date, total_cash FROM (
      SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY balance_date DESC, id DESC) AS rn
      FROM cash_balances) WHERE rn = 1""")
BS_CTE = ("bs", """
    SELECT co.id AS company_id, lc.balance_date AS as_of, t.line_order, t.section, t.line_key, t.label,
           CASE WHEN t.line_key = 'cash' THEN CAST(lc.total_cash AS DOUBLE) END AS amount, t.note
    FROM companies co LEFT JOIN latest_cash lc ON lc.company_id = co.id
    CROSS JOIN (VALUES
      (1, 'assets', 'cash', 'Cash and cash equivalents', NULL),
      (2, 'assets', 'receivables', 'Accounts receivable', 'Connect Xero / accounting sync'),
      (3, 'assets', 'inventory', 'Inventory', 'Connect Xero / accounting sync'),
      (4, 'assets', 'other_current_assets', 'Other current assets', NULL),
      (5, 'assets', 'non_current_assets', 'Non-current assets', NULL),
      (6, 'liabilities', 'payables', 'Accounts payable', 'Connect Xero / accounting sync'),
      (7, 'liabilities', 'current_liabilities', 'Other current liabilities', NULL),
      (8, 'liabilities', 'non_current_liabilities', 'Non-current liabilities', NULL),
      (9, 'equity', 'equity', 'Equity (plug)', NULL)) AS t(line_order, section, line_key, label, note)""")


@register("dol", oracle=with_tables(["health"], "SELECT * FROM dol_t", [DOL_CTE]))
def q_dol(spark, sf_dir):
    return st.dol(health_of(ModelTables(spark, sf_dir)))


@register("rule_of_40", oracle=with_tables(["health"], "SELECT * FROM r40", [R40_CTE]))
def q_rule_of_40(spark, sf_dir):
    return st.rule_of_40(health_of(ModelTables(spark, sf_dir)))


@register("pl_matrix_long", oracle=with_tables(["health"], """
    SELECT company_id, forecast_month, 'revenue' AS line_key, 'Revenue' AS line_label, 1 AS line_order,
           revenue AS value FROM health
    UNION ALL SELECT company_id, forecast_month, 'variable_costs', 'Variable costs (COGS)', 2, variable_costs FROM health
    UNION ALL SELECT company_id, forecast_month, 'contribution_margin', 'Contribution margin', 3, gross_profit FROM health
    UNION ALL SELECT company_id, forecast_month, 'fixed_costs', 'Fixed costs (monthly)', 4, fixed_costs FROM health
    UNION ALL SELECT company_id, forecast_month, 'net_profit', 'Net profit (operating-style)', 5, net_profit FROM health
    UNION ALL SELECT company_id, forecast_month, 'gross_margin_percent', 'Gross margin %', 6, gross_margin_percent
              FROM health
    UNION ALL SELECT company_id, forecast_month, 'dol', 'DOL (CM / net profit, approximate)', 7, dol FROM dol_t
    UNION ALL SELECT company_id, forecast_month, 'rule_of_40', 'Rule of 40 (YoY rev % + net margin % proxy)', 8,
              rule_of_40 FROM r40""", [DOL_CTE, R40_CTE]))
def q_pl_matrix_long(spark, sf_dir):
    return st.pl_matrix_long(health_of(ModelTables(spark, sf_dir)))


@register("pl_matrix", no_oracle="array-valued cells; tests compare it with pl_matrix_long")
def q_pl_matrix(spark, sf_dir):
    return st.pl_matrix(st.pl_matrix_long(health_of(ModelTables(spark, sf_dir))))


@register("pl_matrix_flat", oracle=ORACLE["pl_matrix_long"])
def q_pl_matrix_flat(spark, sf_dir):
    """The matrix taken apart again, so that its cells can be compared."""
    mx = st.pl_matrix(st.pl_matrix_long(health_of(ModelTables(spark, sf_dir))))
    cells = F.arrays_zip(F.col("columns").alias("m"), F.col("cells").alias("v"))
    return mx.select("company_id", "line_order", "line_key", "line_label", F.explode(cells).alias("c")).select(
        "company_id", F.col("c.m").alias("forecast_month"), "line_key", "line_label", "line_order", F.col("c.v").alias("value"))


@register("cashflow_proxy", oracle=with_tables(["health", "one_off_expenses"], """
    SELECT h.company_id, h.forecast_month, COALESCE(h.net_profit, 0.0) AS operating_cash_proxy,
           COALESCE(CAST(c.capex AS DOUBLE), 0.0) AS capex,
           COALESCE(h.net_profit, 0.0) - COALESCE(CAST(c.capex AS DOUBLE), 0.0) AS net_cash_flow_proxy
    FROM health h LEFT JOIN (
      SELECT company_id, CAST(date_trunc('month', expense_date) AS DATE) AS m, SUM(amount) AS capex
      FROM one_off_expenses GROUP BY 1, 2) c ON c.company_id = h.company_id AND c.m = h.forecast_month"""))
def q_cashflow_proxy(spark, sf_dir):
    m = ModelTables(spark, sf_dir)
    return st.cashflow_proxy(health_of(m), m.one_off_expenses)


@register("balance_sheet", oracle=with_tables(["companies", "cash_balances"], "SELECT * FROM bs",
                                              [LATEST_CASH_CTE, BS_CTE]))
def q_balance_sheet(spark, sf_dir):
    m = ModelTables(spark, sf_dir)
    return st.balance_sheet(m.companies, m.cash_balances)


@register("working_capital", oracle=with_tables(["companies", "cash_balances"], """
    SELECT company_id,
           CAST(NULL AS DOUBLE) AS net_working_capital, CAST(NULL AS DOUBLE) AS current_ratio,
           CAST(NULL AS DOUBLE) AS quick_ratio, CAST(NULL AS DOUBLE) AS asset_turnover, CAST(NULL AS DOUBLE) AS roa
    FROM bs GROUP BY company_id""", [LATEST_CASH_CTE, BS_CTE]))
def q_working_capital(spark, sf_dir):
    m = ModelTables(spark, sf_dir)
    return st.working_capital(st.balance_sheet(m.companies, m.cash_balances))


def synced_amounts(m: ModelTables):
    """Balance-sheet lines from the app's own tables: unpaid invoices, stock at cost, CAPEX, and a month of bills."""
    line = lambda df, key, amount: df.groupBy("company_id").agg(F.sum(amount).cast("double").alias("amount")).select(
        "company_id", F.lit(key).alias("line_key"), "amount")
    sign = F.when(F.col("basis") == "accrual", F.col("amount")).otherwise(-F.col("amount"))
    monthly = m.fixed_expenses.filter(F.col("frequency") == "monthly")
    other = m.fixed_expenses.filter(F.col("frequency") != "monthly")
    return (line(lines_of(m), "receivables", sign).unionByName(line(m.products, "inventory", F.col("default_cogs")))
            .unionByName(line(m.one_off_expenses, "non_current_assets", F.col("amount")))
            .unionByName(line(m.products, "other_current_assets", F.lit(0))).unionByName(line(monthly, "payables", F.col("amount")))
            .unionByName(line(other, "current_liabilities", F.col("amount"))))


@register("working_capital_filled", oracle=with_tables(["companies", "cash_balances", "products", "fixed_expenses", "one_off_expenses", "health_exact", "lead_links"], """
    SELECT company_id, current - owed AS net_working_capital, current / NULLIF(owed, 0) AS current_ratio,
           (current - inventory) / NULLIF(owed, 0) AS quick_ratio, revenue / NULLIF(current + fixed, 0) AS asset_turnover,
           profit / NULLIF(current + fixed, 0) * 100 AS roa
    FROM (SELECT co.id AS company_id, inventory, CAST(lc.total_cash AS DOUBLE) + due + inventory + 0.0 AS current, fixed, bills + others AS owed, revenue, profit
          FROM companies co
          LEFT JOIN latest_cash lc ON lc.company_id = co.id
          LEFT JOIN (SELECT company_id, CAST(SUM(IF(basis = 'accrual', amount, -amount)) AS DOUBLE) AS due FROM all_lines GROUP BY 1) r ON r.company_id = co.id
          LEFT JOIN (SELECT company_id, CAST(SUM(default_cogs) AS DOUBLE) AS inventory FROM products GROUP BY 1) p ON p.company_id = co.id
          LEFT JOIN (SELECT company_id, CAST(SUM(amount) AS DOUBLE) AS fixed FROM one_off_expenses GROUP BY 1) o ON o.company_id = co.id
          LEFT JOIN (SELECT company_id, CAST(SUM(amount) FILTER (frequency = 'monthly') AS DOUBLE) AS bills,
                            CAST(SUM(amount) FILTER (frequency <> 'monthly') AS DOUBLE) AS others FROM fixed_expenses GROUP BY 1) f ON f.company_id = co.id
          LEFT JOIN (SELECT company_id, CAST(SUM(revenue) AS DOUBLE) AS revenue, CAST(SUM(net_profit) AS DOUBLE) AS profit
                     FROM health_exact GROUP BY 1) h ON h.company_id = co.id)""", [LATEST_CASH_CTE, *LEDGER_CTES]))
def q_working_capital_filled(spark, sf_dir):
    """X5 over a balance sheet whose lines are filled."""
    m = ModelTables(spark, sf_dir)
    results = health_exact_of(m).groupBy("company_id").agg(F.sum("revenue").alias("revenue"), F.sum("net_profit").alias("net_profit"))
    return st.working_capital(st.filled_balance_sheet(st.balance_sheet(m.companies, m.cash_balances), synced_amounts(m)), results)
