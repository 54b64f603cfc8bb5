"""DuckDB text of the model tables (FIXTURES.md section 2) for the oracle queries.

Written from the table definitions, independently of the DataFrame code: the
oracle must be able to disagree with the engine.  Each entry is the body of a
CTE; ``with_tables`` prepends the ones a query needs, in dependency order.
"""

from __future__ import annotations

# name -> (dependencies, CTE body)
TABLES: dict[str, tuple[list[str], str]] = {
    "companies": ([], "SELECT n_nationkey AS id, n_name AS name FROM nation"),
    "products": ([], """
        SELECT p_partkey AS id, CAST(p_partkey % 25 AS INTEGER) AS company_id, p_name AS name,
               p_brand AS sku, CAST(p_retailprice AS DECIMAL(19,4)) AS default_sales_price,
               CAST(p_retailprice * 0.6 AS DECIMAL(19,4)) AS default_cogs, TRUE AS is_active
        FROM part"""),
    "forecast_entries": ([], """
        SELECT g.company_id || '-' || g.product_id || '-' || strftime(g.forecast_month, '%Y-%m') AS id,
               g.company_id, g.product_id, g.forecast_month,
               CAST(g.qty AS INTEGER) AS units_forecasted,
               CASE WHEN g.min_disc >= 0.05 THEN CAST(g.max_price * (1 - g.min_disc) AS DECIMAL(19,4)) END
                 AS price_override,
               CASE WHEN g.max_tax >= 0.08 THEN CAST(g.max_price * 1.1 AS DECIMAL(19,4)) END AS cogs_override
        FROM (
          SELECT c.c_nationkey AS company_id, l.l_partkey AS product_id,
                 CAST(date_trunc('month', l.l_shipdate) AS DATE) AS forecast_month,
                 SUM(l.l_quantity) AS qty, MAX(p.p_retailprice) AS max_price,
                 MIN(l.l_discount) AS min_disc, MAX(l.l_tax) AS max_tax
          FROM lineitem l
          JOIN orders o ON l.l_orderkey = o.o_orderkey
          JOIN customer c ON o.o_custkey = c.c_custkey
          JOIN part p ON l.l_partkey = p.p_partkey
          GROUP BY 1, 2, 3) g"""),
    "fixed_expenses": ([], """
        SELECT s_suppkey AS id, s_nationkey AS company_id, s_name AS name,
               CAST(abs(s_acctbal) * 25 AS DECIMAL(19,4)) AS amount,
               CASE s_suppkey % 4 WHEN 0 THEN 'quarterly' WHEN 1 THEN 'annually' ELSE 'monthly' END AS frequency,
               CAST(1 + s_suppkey % 28 AS INTEGER) AS payment_day
        FROM supplier"""),
    "leads": ([], """
        SELECT o.o_orderkey AS id, c.c_nationkey AS company_id, c.c_name AS client_name,
               CAST(CAST(o.o_totalprice AS DECIMAL(19,4)) * 0.0125 AS DECIMAL(19,4)) AS contract_value,
               CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 90 WHEN '2' THEN 70 WHEN '3' THEN 50
                    WHEN '4' THEN 25 WHEN '5' THEN 10 END AS probability,
               CAST(o.o_orderdate AS DATE) AS expected_close_date, o.o_custkey AS custkey
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
        WHERE o.o_orderstatus IN ('O', 'P')"""),
    "cash_balances": ([], """
        SELECT c.c_custkey AS id, c.c_nationkey AS company_id, CAST(max(o.o_orderdate) AS DATE) AS balance_date,
               CAST(c.c_acctbal * 500 AS DECIMAL(19,4)) AS total_cash
        FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey
        GROUP BY c.c_custkey, c.c_nationkey, c.c_acctbal"""),
    "one_off_expenses": ([], """
        SELECT c.c_nationkey AS company_id, o.o_custkey AS project_id,
               'capex-' || l.l_orderkey || '-' || l.l_linenumber || '-' || l.l_partkey || '-' || l.l_suppkey AS name,
               CAST(CAST(l.l_extendedprice AS DECIMAL(19,4)) * 0.007 AS DECIMAL(19,4)) AS amount,
               CAST(l.l_shipdate AS DATE) AS expense_date
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
        WHERE l.l_returnflag = 'R'"""),
    "projects": ([], """
        SELECT c_custkey AS id, c_nationkey AS company_id, c_name AS project_name,
               CASE WHEN c_custkey % 2 = 0 THEN 'active' ELSE 'planned' END AS status
        FROM customer"""),
    "project_budgets": ([], """
        SELECT o_orderkey AS id, o_custkey AS project_id, 'order-' || o_orderkey AS item_name,
               CAST(NULL AS VARCHAR) AS supplier, o_orderpriority AS grouping_category,
               CAST(CAST(o_totalprice AS DECIMAL(19,4)) * 0.0025 AS DECIMAL(19,4)) AS total_amount,
               CAST(o_orderdate AS DATE) AS start_date
        FROM orders"""),
    "installments": ([], """
        SELECT l_orderkey AS budget_item_id,
               CAST(CAST(l_extendedprice AS DECIMAL(19,4)) * 0.0025 AS DECIMAL(19,4)) AS payment_amount,
               CAST(l_shipdate AS DATE) AS expected_payment_date
        FROM lineitem"""),
    "lead_links": (["leads"], """
        SELECT min(id) AS id, company_id, min(id) AS lead_id,
               CASE WHEN custkey % 2 = 0 THEN 'xero' ELSE 'quickbooks' END AS provider,
               'C' || custkey AS external_contact_id
        FROM leads GROUP BY company_id, custkey"""),
    "connections": ([], """
        SELECT company_id * 2 + pidx AS id, company_id,
               CASE WHEN pidx = 0 THEN 'xero' ELSE 'quickbooks' END AS service_name,
               CASE WHEN pidx = 0 THEN 'T' || company_id END AS tenant_id,
               CASE WHEN pidx = 1 THEN 'T' || company_id END AS realm_id
        FROM (SELECT DISTINCT c.c_nationkey AS company_id, CAST(o.o_custkey % 2 AS INTEGER) AS pidx
              FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey) d"""),
    "sessions": ([], """
        SELECT conv_id AS id, CAST(conv_id % 25 AS INTEGER) AS company_id,
               CASE WHEN conv_id % 25 < 15 AND conv_id % 2 = 0 THEN 'completed' ELSE 'in_progress' END AS status,
               (conv_id % 25 < 15 AND conv_id % 2 = 0) AS is_completed
        FROM (SELECT DISTINCT conv_id FROM conversations) c"""),
    "messages": ([], """
        SELECT conv_id * 1000000000 + turn AS id, conv_id AS session_id, turn, role, text AS content
        FROM conversations"""),
    "profile_patches": ([], """
        SELECT CAST(user_id % 25 AS INTEGER) AS company_id, event_id AS seq, event_type AS key, value
        FROM events"""),
    # ---- shared derived views: unit economics per entry (B5, D1), then company months (I1) ----
    "unit_economics": (["forecast_entries", "products"], """
        SELECT entry.id AS forecast_id, entry.company_id, entry.forecast_month, item.name AS product_name,
               entry.units_forecasted AS units,
               CASE WHEN entry.price_override IS NULL THEN item.default_sales_price ELSE entry.price_override END AS unit_price,
               CASE WHEN entry.cogs_override IS NULL THEN item.default_cogs ELSE entry.cogs_override END AS unit_cost
        FROM products item, forecast_entries entry WHERE item.id = entry.product_id"""),
    "details": (["unit_economics"], """
        SELECT forecast_id, company_id, forecast_month, product_name, units AS units_forecasted,
               unit_price AS final_price, unit_cost AS final_cogs, units * unit_price AS total_revenue,
               units * unit_cost AS total_variable_cost, units * (unit_price - unit_cost) AS gross_profit
        FROM unit_economics"""),
    "company_months": (["unit_economics"], """
        SELECT company_id, forecast_month, SUM(units * unit_price) AS sales, SUM(units * unit_cost) AS costs,
               SUM(units * (unit_price - unit_cost)) AS margin
        FROM unit_economics GROUP BY ALL"""),
    "monthly_bills": (["fixed_expenses"], """
        SELECT company_id, SUM(amount) FILTER (frequency = 'monthly') AS bills FROM fixed_expenses GROUP BY company_id"""),
    "pipeline": (["leads"], """
        SELECT company_id, SUM(contract_value * probability * 0.01) AS expected FROM leads GROUP BY company_id"""),
    "health_core": (["company_months", "monthly_bills", "pipeline"], """
        SELECT company_id, forecast_month, sales AS revenue, costs AS variable_costs, margin AS gross_profit,
               IFNULL(bills, 0) AS fixed_costs, margin - IFNULL(bills, 0) AS net_profit,
               ROUND(share * 100, 2) AS gross_margin_percent,
               IF(margin > 0, ROUND(CAST(IFNULL(bills, 0) AS DOUBLE) / share, 2), 0) AS revenue_needed_to_break_even,
               IFNULL(expected, 0) AS weighted_pipeline_value
        FROM (SELECT *, CAST(margin AS DOUBLE) / NULLIF(CAST(sales AS DOUBLE), 0) AS share FROM company_months)
        LEFT JOIN monthly_bills USING (company_id) LEFT JOIN pipeline USING (company_id)"""),
    "health_exact": (["health_core"], """
        SELECT *, SUM(net_profit) OVER (PARTITION BY company_id ORDER BY forecast_month
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ytd_net_profit
        FROM health_core"""),
    "health": (["health_exact"], """
        SELECT company_id, forecast_month, CAST(revenue AS DOUBLE) AS revenue,
               CAST(variable_costs AS DOUBLE) AS variable_costs, CAST(gross_profit AS DOUBLE) AS gross_profit,
               CAST(fixed_costs AS DOUBLE) AS fixed_costs, CAST(net_profit AS DOUBLE) AS net_profit,
               gross_margin_percent, CAST(revenue_needed_to_break_even AS DOUBLE) AS revenue_needed_to_break_even,
               CAST(weighted_pipeline_value AS DOUBLE) AS weighted_pipeline_value,
               CAST(ytd_net_profit AS DOUBLE) AS ytd_net_profit
        FROM health_exact"""),
}


def _order(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in TABLES[n][0]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_tables(needs: list[str], sql: str, ctes: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``sql`` with the model-table CTEs it needs (and extra named CTEs)."""
    parts = [f"{n} AS ({TABLES[n][1]})" for n in _order(needs)]
    parts += [f"{n} AS ({body})" for n, body in (ctes or [])]
    return ("WITH " + ",\n".join(parts) + "\n" + sql) if parts else sql
