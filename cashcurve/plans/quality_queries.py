"""Query keys for step 11 (data quality): M1-M4, M6."""

from __future__ import annotations

from pyspark.sql import functions as F

from cashcurve.functions.exprs import dbl
from cashcurve.operators import kpis
from cashcurve.operators import onboarding as ob
from cashcurve.operators import quality as dq
from cashcurve.operators.constraints import check_constraints, declared
from cashcurve.plans.actuals_queries import ACTUAL_CTES
from cashcurve.plans.kpi_queries import METRIC_CTES, METRIC_NEEDS, metrics_of
from cashcurve.plans.ledger_queries import actual_lines_table
from cashcurve.plans.onboarding_queries import calibration_runs_of
from cashcurve.plans.oracle_tables import TABLES, with_tables
from cashcurve.plans.registry import register
from cashcurve.sources.model import ModelTables


@register("dq_unique", oracle=with_tables(
    ["forecast_entries", "lead_links", "connections", "profile_patches"] + METRIC_NEEDS, """
    SELECT name AS constraint_name, CAST(SUM(n) AS BIGINT) AS rows, count(*) AS distinct_keys,
           count(*) FILTER (WHERE n > 1) AS duplicate_keys
    FROM (SELECT 'forecast_entries(company_id, product_id, forecast_month)' AS name, count(*) AS n
          FROM forecast_entries GROUP BY company_id, product_id, forecast_month
          UNION ALL SELECT 'lead_accounting_links(company_id, provider, external_contact_id)', count(*)
          FROM lead_links GROUP BY company_id, provider, external_contact_id
          UNION ALL SELECT 'monthly_metrics(company_id, month_date)', count(*)
          FROM metrics GROUP BY company_id, month_date
          UNION ALL SELECT 'api_connections(company_id, service_name)', count(*)
          FROM connections GROUP BY company_id, service_name
          UNION ALL SELECT 'profile_patches(company_id, seq)', count(*)
          FROM profile_patches GROUP BY company_id, seq) k
    GROUP BY name""", METRIC_CTES))
def q_dq_unique(spark, sf_dir):
    m = ModelTables(spark, sf_dir)
    return dq.union_all([
        dq.unique_summary("forecast_entries(company_id, product_id, forecast_month)", m.forecast_entries,
                          ["company_id", "product_id", "forecast_month"]),
        dq.unique_summary("lead_accounting_links(company_id, provider, external_contact_id)", m.lead_links,
                          ["company_id", "provider", "external_contact_id"]),
        dq.unique_summary("monthly_metrics(company_id, month_date)", metrics_of(m), ["company_id", "month_date"]),
        dq.unique_summary("api_connections(company_id, service_name)", m.connections, ["company_id", "service_name"]),
        dq.unique_summary("profile_patches(company_id, seq)", m.profile_patches, ["company_id", "seq"]),
    ])


@register("dq_orphans", oracle=with_tables(
    ["forecast_entries", "products", "companies", "leads", "lead_links", "one_off_expenses", "projects",
     "installments", "project_budgets"], """
    SELECT 'forecast_entries.product_id -> products' AS relation,
           (SELECT count(*) FROM forecast_entries f WHERE f.product_id NOT IN (SELECT id FROM products)) AS orphans
    UNION ALL SELECT 'forecast_entries.company_id -> companies',
           (SELECT count(*) FROM forecast_entries f WHERE f.company_id NOT IN (SELECT id FROM companies))
    UNION ALL SELECT 'leads.company_id -> companies',
           (SELECT count(*) FROM leads l WHERE l.company_id NOT IN (SELECT id FROM companies))
    UNION ALL SELECT 'lead_accounting_links.lead_id -> leads',
           (SELECT count(*) FROM lead_links k WHERE k.lead_id NOT IN (SELECT id FROM leads))
    UNION ALL SELECT 'one_off_expenses.project_id -> projects',
           (SELECT count(*) FROM one_off_expenses e WHERE e.project_id IS NOT NULL
              AND e.project_id NOT IN (SELECT id FROM projects))
    UNION ALL SELECT 'project_budget_installments.budget_item_id -> project_budgets',
           (SELECT count(*) FROM installments i WHERE i.budget_item_id NOT IN (SELECT id FROM project_budgets))
    UNION ALL SELECT 'project_budgets.project_id -> projects',
           (SELECT count(*) FROM project_budgets b WHERE b.project_id NOT IN (SELECT id FROM projects))"""))
def q_dq_orphans(spark, sf_dir):
    m = ModelTables(spark, sf_dir)
    return dq.union_all([
        dq.orphan_summary("forecast_entries.product_id -> products", m.forecast_entries, "product_id", m.products),
        dq.orphan_summary("forecast_entries.company_id -> companies", m.forecast_entries, "company_id", m.companies),
        dq.orphan_summary("leads.company_id -> companies", m.leads, "company_id", m.companies),
        dq.orphan_summary("lead_accounting_links.lead_id -> leads", m.lead_links, "lead_id", m.leads),
        dq.orphan_summary("one_off_expenses.project_id -> projects", m.one_off_expenses, "project_id", m.projects),
        dq.orphan_summary("project_budget_installments.budget_item_id -> project_budgets", m.installments,
                          "budget_item_id", m.project_budgets),
        dq.orphan_summary("project_budgets.project_id -> projects", m.project_budgets, "project_id", m.projects),
    ])


@register("dq_domain", oracle=with_tables(["messages", "lead_links", "leads", "fixed_expenses", "forecast_entries"], """
    SELECT 'onboarding_messages.role in (user, assistant, system)' AS rule, count(*) AS checked,
           count(*) FILTER (WHERE NOT COALESCE(role IN ('user', 'assistant', 'system'), FALSE)) AS violations
    FROM messages
    UNION ALL SELECT 'lead_accounting_links.provider in (xero, quickbooks)', count(*),
           count(*) FILTER (WHERE NOT COALESCE(provider IN ('xero', 'quickbooks'), FALSE)) FROM lead_links
    UNION ALL SELECT 'leads.probability between 0 and 100', count(*),
           count(*) FILTER (WHERE NOT COALESCE(probability BETWEEN 0 AND 100, FALSE)) FROM leads
    UNION ALL SELECT 'leads.client_name not null', count(*),
           count(*) FILTER (WHERE client_name IS NULL) FROM leads
    UNION ALL SELECT 'fixed_expenses.frequency in (monthly, quarterly, annually)', count(*),
           count(*) FILTER (WHERE NOT COALESCE(frequency IN ('monthly', 'quarterly', 'annually'), FALSE))
    FROM fixed_expenses
    UNION ALL SELECT 'forecast_entries.units_forecasted >= 0', count(*),
           count(*) FILTER (WHERE NOT COALESCE(units_forecasted >= 0, FALSE)) FROM forecast_entries"""))
def q_dq_domain(spark, sf_dir):
    m = ModelTables(spark, sf_dir)
    return dq.union_all([
        dq.domain_summary("onboarding_messages.role in (user, assistant, system)", m.onboarding_messages,
                          F.col("role").isin("user", "assistant", "system")),
        dq.domain_summary("lead_accounting_links.provider in (xero, quickbooks)", m.lead_links,
                          F.col("provider").isin("xero", "quickbooks")),
        dq.domain_summary("leads.probability between 0 and 100", m.leads, F.col("probability").between(0, 100)),
        dq.domain_summary("leads.client_name not null", m.leads, F.col("client_name").isNotNull()),
        dq.domain_summary("fixed_expenses.frequency in (monthly, quarterly, annually)", m.fixed_expenses,
                          F.col("frequency").isin("monthly", "quarterly", "annually")),
        dq.domain_summary("forecast_entries.units_forecasted >= 0", m.forecast_entries,
                          F.col("units_forecasted") >= 0),
    ])


@register("dq_month_grain", oracle=with_tables(["forecast_entries", "installments"] + METRIC_NEEDS, """
    SELECT 'forecast_entries.forecast_month' AS column_name, count(forecast_month) AS checked,
           count(*) FILTER (WHERE forecast_month <> CAST(date_trunc('month', forecast_month) AS DATE)) AS off_grain
    FROM forecast_entries
    UNION ALL SELECT 'monthly_metrics.month_date', count(month_date),
           count(*) FILTER (WHERE month_date <> CAST(date_trunc('month', month_date) AS DATE)) FROM metrics
    UNION ALL SELECT 'project_budget_installments.expected_payment_date', count(expected_payment_date),
           count(*) FILTER (WHERE expected_payment_date <> CAST(date_trunc('month', expected_payment_date) AS DATE))
    FROM installments""", METRIC_CTES))
def q_dq_month_grain(spark, sf_dir):
    m = ModelTables(spark, sf_dir)
    return dq.union_all([
        dq.month_grain_summary("forecast_entries.forecast_month", m.forecast_entries, "forecast_month"),
        dq.month_grain_summary("monthly_metrics.month_date", metrics_of(m), "month_date"),
        dq.month_grain_summary("project_budget_installments.expected_payment_date", m.installments,
                               "expected_payment_date"),
    ])


V1_METRIC_COLUMNS = ["company_id", "month_date", "mau", "cac", "churn_rate", "ltv", "revenue_per_employee"]


@register("metrics_schema_evolution", oracle=with_tables(METRIC_NEEDS, """
    SELECT company_id, month_date, mau, CAST(cac AS DOUBLE) AS cac, CAST(churn_rate AS DOUBLE) AS churn_rate,
           CAST(ltv AS DOUBLE) AS ltv, CAST(revenue_per_employee AS DOUBLE) AS revenue_per_employee,
           CAST(NULL AS DOUBLE) AS mrr, CAST(NULL AS DOUBLE) AS expansion_mrr, CAST(NULL AS DOUBLE) AS contraction_mrr,
           CAST(NULL AS DOUBLE) AS churned_mrr, CAST(NULL AS DOUBLE) AS starting_mrr,
           CAST(NULL AS INTEGER) AS new_customers, CAST(NULL AS DOUBLE) AS sm_spend,
           CAST(NULL AS INTEGER) AS customers_start_of_month, CAST(NULL AS INTEGER) AS customers_lost
    FROM metrics""", METRIC_CTES))
def q_metrics_schema_evolution(spark, sf_dir):
    """M6: rows written before the KPI-input columns existed, read with today's schema."""
    m = ModelTables(spark, sf_dir)
    full = metrics_of(m)
    v1 = full.select(*V1_METRIC_COLUMNS)
    evolved = dq.evolve(v1, full.schema, {"mau": 0})
    return kpis.metrics_output(evolved).select(
        "company_id", "month_date", "mau", *[dbl(c).alias(c) if c in kpis.MONEY_METRICS else F.col(c)
                                             for c in kpis.METRIC_COLUMNS if c != "mau"])


#: Every table of SCHEMAS that has or is named by a constraint, and its name in the SQL.
CHECKED = {"companies": "companies", "products": "products", "fixed_expenses": "fixed_expenses", "forecast_entries": "forecast_entries", "leads": "leads",
           "lead_links": "lead_links", "connections": "connections", "projects": "projects", "project_budgets": "project_budgets",
           "installments": "installments", "onboarding_sessions": "sessions", "onboarding_messages": "messages", "cash_balances": "cash_balances",
           "one_off_expenses": "one_off_expenses", "monthly_metrics": "metrics", "accounting_actual_lines": "actual_lines",
           "company_onboarding_profiles": "profiles", "onboarding_calibration_runs": "runs"}
CHECKED_CTES = [
    *METRIC_CTES[:[n for n, _ in METRIC_CTES].index("metrics") + 1], *ACTUAL_CTES[:[n for n, _ in ACTUAL_CTES].index("actual_lines") + 1],
    ("profiles", """
        SELECT p.company_id + 1 AS id, p.company_id, s.session_id, p.profile_version, p.data
        FROM (SELECT company_id, count(DISTINCT seq) AS profile_version, CAST(list(key) AS VARCHAR) AS data
              FROM profile_patches WHERE company_id IS NOT NULL GROUP BY 1) p
        LEFT JOIN (SELECT company_id, max(id) AS session_id FROM sessions GROUP BY 1) s ON s.company_id = p.company_id"""),
    ("runs", """
        SELECT s.id, s.company_id, s.id AS session_id, p.id AS profile_id,
               CASE WHEN (s.id % 3 <> 0 AND NOT COALESCE(c.xero, FALSE)) OR (s.id % 4 <> 1 AND NOT COALESCE(c.qbo, FALSE)) THEN 'failed' ELSE 'ok' END AS status,
               CASE WHEN p.id IS NULL THEN 'skipped_no_profile' ELSE 'ok' END AS steps
        FROM sessions s LEFT JOIN profiles p ON p.company_id = s.company_id
        LEFT JOIN (SELECT company_id, bool_or(service_name = 'xero') AS xero, bool_or(service_name = 'quickbooks') AS qbo
                   FROM connections GROUP BY 1) c ON c.company_id = s.company_id
        WHERE s.id IS NOT NULL"""),
]


def _constraint_sql() -> str:
    """One SELECT per declared constraint."""
    parts = []
    for table, kind, name, what in declared():
        t = CHECKED[table]
        head = f"SELECT '{table}' AS table_name, '{kind}' AS kind, '{name.replace(chr(39), chr(39) * 2)}' AS constraint_name, "
        if kind == "unique":
            keys = ", ".join(what)
            parts.append(f"{head}(SELECT count(*) FROM {t} WHERE ({keys}) IS NOT NULL) AS checked, "
                         f"(SELECT count(*) FROM (SELECT 1 FROM {t} GROUP BY {keys} HAVING count(*) > 1) d) AS violations")
        elif kind == "foreign_key":
            parts.append(f"{head}(SELECT count({what[0]}) FROM {t}), "
                         f"(SELECT count(*) FROM {t} c WHERE c.{what[0]} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {CHECKED[what[1]]} p WHERE p.id = c.{what[0]}))")
        elif kind == "month_grain":
            parts.append(f"{head}(SELECT count(*) FROM {t}), (SELECT count(*) FROM {t} WHERE {name} <> CAST(date_trunc('month', {name}) AS DATE))")
        else:
            parts.append(f"{head}(SELECT count(*) FROM {t}), (SELECT count(*) FROM {t} WHERE NOT COALESCE({what}, FALSE))")
    return " UNION ALL ".join(parts)


def profiles_of(m: ModelTables):
    """company_onboarding_profiles: the merged profile of every company, with its newest session."""
    newest = m.onboarding_sessions.groupBy("company_id").agg(F.max("id").alias("session_id"))
    entries = F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "value"))))
    p = ob.profile_merge(m.profile_patches).groupBy("company_id", "profile_version").agg(F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"}).alias("data"))
    return p.join(newest, "company_id", "left").select((F.col("company_id") + 1).alias("id"), "company_id", "session_id", "profile_version", "data")


def runs_of(m: ModelTables):
    """onboarding_calibration_runs: one run per session, with the profile it took and the outcome of its steps."""
    steps = ("extract_profile", "sync_xero", "sync_xero_rows", "sync_qbo", "sync_qbo_rows")
    profiles = profiles_of(m).select("company_id", F.col("id").alias("profile_id"))
    return calibration_runs_of(m).join(profiles, "company_id", "left").select(
        F.col("session_id").alias("id"), "company_id", "session_id", "profile_id", "status", F.to_json(F.struct(*steps)).alias("steps"), "error")


#: Tables that are not an attribute of ModelTables by their own name, or lack columns there.
DERIVED = {"monthly_metrics": metrics_of, "accounting_actual_lines": actual_lines_table, "company_onboarding_profiles": profiles_of,
           "onboarding_calibration_runs": runs_of}


@register("constraint_report", oracle=with_tables(
    sorted({"profile_patches", *CHECKED.values()} & set(TABLES)), _constraint_sql(), CHECKED_CTES))
def q_constraint_report(spark, sf_dir):
    """M1-M4: all declared constraints of all tables, from one scan per table."""
    m = ModelTables(spark, sf_dir)
    return check_constraints(lambda table: DERIVED[table](m) if table in DERIVED else getattr(m, table))
