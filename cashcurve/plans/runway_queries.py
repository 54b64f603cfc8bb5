"""Query keys for step 3 (runway and lists): I6 I7 I8 I23 B7 B8 B9."""

from __future__ import annotations

from cashcurve.operators import runway as rw
from cashcurve.plans.forecast_queries import health_exact_of
from cashcurve.plans.oracle_tables import with_tables
from cashcurve.plans.registry import register
from cashcurve.sources.model import ModelTables

# Oracle CTE: one row per company with the five runway inputs (S9 tie-break id desc).
RUNWAY_INPUTS = ("runway_inputs", """
    SELECT co.id AS company_id,
           COALESCE(CAST(cb.total_cash AS DOUBLE), 0.0) AS starting_cash,
           COALESCE(CAST(fx.burn AS DOUBLE), 0.0) AS burn_rate,
           COALESCE(CAST(pl.expected AS DOUBLE), 0.0) AS expected_cash,
           COALESCE(CAST(cx.capex AS DOUBLE), 0.0) AS capex,
           COALESCE(CAST(lr.revenue AS DOUBLE), 0.0) AS latest_month_revenue
    FROM companies co
    LEFT JOIN (SELECT company_id, total_cash FROM (
                 SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY balance_date DESC, id DESC) AS rn
                 FROM cash_balances) WHERE rn = 1) cb ON cb.company_id = co.id
    LEFT JOIN (SELECT company_id, SUM(amount) AS burn FROM fixed_expenses GROUP BY company_id) fx
      ON fx.company_id = co.id
    LEFT JOIN (SELECT company_id, SUM(contract_value * probability * 0.01) AS expected FROM leads
               GROUP BY company_id) pl ON pl.company_id = co.id
    LEFT JOIN (SELECT company_id, SUM(amount) AS capex FROM one_off_expenses GROUP BY company_id) cx
      ON cx.company_id = co.id
    LEFT JOIN (SELECT company_id, revenue FROM (
                 SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY forecast_month DESC) AS rn
                 FROM health_exact) WHERE rn = 1) lr ON lr.company_id = co.id""")
RUNWAY_NEEDS = ["companies", "cash_balances", "fixed_expenses", "leads", "one_off_expenses", "health_exact"]


def inputs_of(m: ModelTables):
    return rw.runway_inputs(m.companies, m.cash_balances, m.fixed_expenses, m.leads, m.one_off_expenses,
                            health_exact_of(m))


@register("runway", oracle=with_tables(RUNWAY_NEEDS, """
    SELECT company_id, starting_cash, burn_rate, expected_cash, capex, months AS estimated_months_left,
           CASE WHEN burn_rate = 0 THEN 'Infinite runway - no expenses logged'
                ELSE printf('%.1f', months) || ' months' END AS status_message,
           CASE WHEN burn_rate = 0 THEN 'Green' WHEN months >= 6 THEN 'Green' WHEN months >= 3 THEN 'Yellow'
                ELSE 'Red' END AS status_color
    FROM (SELECT *, CASE WHEN burn_rate <> 0 THEN (starting_cash + expected_cash - capex) / burn_rate END AS months
          FROM runway_inputs) r""", [RUNWAY_INPUTS]))
def q_runway(spark, sf_dir):
    return rw.runway(inputs_of(ModelTables(spark, sf_dir)))


@register("net_burn_runway", oracle=with_tables(RUNWAY_NEEDS, """
    SELECT company_id, starting_cash, burn_rate AS gross_burn, latest_month_revenue,
           burn_rate - latest_month_revenue AS net_burn,
           CASE WHEN burn_rate - latest_month_revenue > 0
                THEN starting_cash / (burn_rate - latest_month_revenue) END AS runway_net_burn_months
    FROM runway_inputs""", [RUNWAY_INPUTS]))
def q_net_burn_runway(spark, sf_dir):
    return rw.net_burn_runway(inputs_of(ModelTables(spark, sf_dir)))


@register("liquidity", oracle=with_tables(RUNWAY_NEEDS, """
    SELECT company_id, starting_cash, burn_rate, expected_cash, capex FROM runway_inputs""", [RUNWAY_INPUTS]))
def q_liquidity(spark, sf_dir):
    return rw.liquidity(inputs_of(ModelTables(spark, sf_dir)))


@register("weighted_leads", oracle=with_tables(["leads"], """
    SELECT id, company_id, client_name, CAST(contract_value AS DOUBLE) AS contract_value, probability,
           CAST(contract_value AS DOUBLE) * (probability / 100.0) AS weighted_value
    FROM leads"""))
def q_weighted_leads(spark, sf_dir):
    return rw.weighted_leads(ModelTables(spark, sf_dir).leads)


@register("lead_list", oracle=with_tables(["leads"], """
    SELECT company_id, id, client_name, CAST(contract_value AS DOUBLE) AS contract_value, probability,
           expected_close_date
    FROM leads ORDER BY company_id, probability DESC NULLS FIRST, id"""))
def q_lead_list(spark, sf_dir):
    return rw.lead_list(ModelTables(spark, sf_dir).leads, whole=False)


@register("cash_history", oracle=with_tables(["cash_balances"], """
    SELECT company_id, id, balance_date, CAST(total_cash AS DOUBLE) AS total_cash
    FROM cash_balances ORDER BY company_id, balance_date DESC, id DESC"""))
def q_cash_history(spark, sf_dir):
    return rw.cash_history(ModelTables(spark, sf_dir).cash_balances, whole=False)


@register("one_off_history", oracle=with_tables(["one_off_expenses"], """
    SELECT company_id, project_id, name, CAST(amount AS DOUBLE) AS amount, expense_date
    FROM one_off_expenses ORDER BY company_id, expense_date, name"""))
def q_one_off_history(spark, sf_dir):
    return rw.one_off_history(ModelTables(spark, sf_dir).one_off_expenses, whole=False)


@register("project_list", oracle=with_tables(["projects"], """
    SELECT company_id, id, project_name, status FROM projects ORDER BY company_id, id DESC"""))
def q_project_list(spark, sf_dir):
    return rw.project_list(ModelTables(spark, sf_dir).projects, whole=False)
