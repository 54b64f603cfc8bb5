"""Query keys for step 5 (SaaS metrics and KPIs): X6 I14-I20 B10."""

from __future__ import annotations

from cashcurve.operators import kpis
from cashcurve.plans.forecast_queries import health_exact_of, health_of
from cashcurve.plans.oracle_tables import with_tables
from cashcurve.plans.registry import register
from cashcurve.sources.model import ModelTables

METRIC_CTES = [
    ("cmr", """
        SELECT c.c_nationkey AS company_id, o.o_custkey AS custkey,
               CAST(date_trunc('month', o.o_orderdate) AS DATE) AS month,
               SUM(CAST(o.o_totalprice AS DECIMAL(19,4))) AS rev
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2, 3"""),
    ("moves", """
        SELECT company_id, month,
               SUM(CASE WHEN rev > 0 AND prev_rev > 0 AND rev > prev_rev THEN rev - prev_rev END) AS expansion_mrr,
               SUM(CASE WHEN rev > 0 AND prev_rev > 0 AND rev < prev_rev THEN prev_rev - rev END) AS contraction_mrr,
               SUM(CASE WHEN rev IS NULL AND prev_rev > 0 THEN prev_rev END) AS churned_mrr
        FROM (SELECT COALESCE(a.company_id, b.company_id) AS company_id, COALESCE(a.month, b.next_month) AS month,
                     a.rev, b.rev AS prev_rev
              FROM cmr a FULL OUTER JOIN (
                SELECT company_id, custkey, CAST(month + INTERVAL 1 MONTH AS DATE) AS next_month, rev FROM cmr) b
              ON a.company_id = b.company_id AND a.custkey = b.custkey AND a.month = b.next_month) x
        GROUP BY company_id, month"""),
    ("spans", "SELECT company_id, custkey, MIN(month) AS first_m, MAX(month) AS last_m FROM cmr GROUP BY 1, 2"),
    ("metrics", """
        SELECT b.company_id, b.month AS month_date, CAST(b.mau AS INTEGER) AS mau,
               CAST(CASE WHEN b.company_id % 3 = 0 THEN 0 ELSE 500 END AS DECIMAL(19,4)) AS cac,
               CAST(0 AS DECIMAL(19,6)) AS churn_rate, CAST(3000 AS DECIMAL(19,4)) AS ltv,
               CAST(0 AS DECIMAL(19,4)) AS revenue_per_employee,
               CAST(b.mrr AS DECIMAL(19,4)) AS mrr,
               CAST(mv.expansion_mrr AS DECIMAL(19,4)) AS expansion_mrr,
               CAST(mv.contraction_mrr AS DECIMAL(19,4)) AS contraction_mrr,
               CAST(mv.churned_mrr AS DECIMAL(19,4)) AS churned_mrr,
               CAST(lag(b.mrr) OVER (PARTITION BY b.company_id ORDER BY b.month) AS DECIMAL(19,4)) AS starting_mrr,
               CAST(NULLIF((SELECT count(*) FROM spans s WHERE s.company_id = b.company_id AND s.first_m = b.month), 0)
                    AS INTEGER) AS new_customers,
               CAST((SELECT SUM(e.amount) FROM one_off_expenses e WHERE e.company_id = b.company_id
                       AND CAST(date_trunc('month', e.expense_date) AS DATE) = b.month) AS DECIMAL(19,4)) AS sm_spend,
               CAST(NULLIF((SELECT count(*) FROM spans s WHERE s.company_id = b.company_id AND s.first_m < b.month), 0)
                    AS INTEGER) AS customers_start_of_month,
               CAST(NULLIF((SELECT count(*) FROM spans s WHERE s.company_id = b.company_id
                              AND CAST(s.last_m + INTERVAL 1 MONTH AS DATE) = b.month), 0) AS INTEGER) AS customers_lost
        FROM (SELECT company_id, month, count(*) AS mau, SUM(rev) AS mrr FROM cmr GROUP BY 1, 2) b
        LEFT JOIN moves mv ON mv.company_id = b.company_id AND mv.month = b.month"""),
    ("metrics_out", """
        SELECT company_id, month_date, mau, CAST(cac AS DOUBLE) AS cac, CAST(churn_rate AS DOUBLE) AS churn_rate,
               CAST(ltv AS DOUBLE) AS ltv, CAST(revenue_per_employee AS DOUBLE) AS revenue_per_employee,
               CAST(mrr AS DOUBLE) AS mrr, CAST(expansion_mrr AS DOUBLE) AS expansion_mrr,
               CAST(contraction_mrr AS DOUBLE) AS contraction_mrr, CAST(churned_mrr AS DOUBLE) AS churned_mrr,
               CAST(starting_mrr AS DOUBLE) AS starting_mrr, new_customers, CAST(sm_spend AS DOUBLE) AS sm_spend,
               customers_start_of_month, customers_lost
        FROM metrics"""),
    ("latest_m", """
        SELECT * EXCLUDE (rn) FROM (
          SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY month_date DESC) AS rn FROM metrics_out)
        WHERE rn = 1"""),
]
METRIC_NEEDS = ["one_off_expenses"]

KPI_SELECT = """
    SELECT company_id, month_date, mrr, mrr * 12 AS arr,
           CASE WHEN starting_mrr > 0 THEN round_even((starting_mrr + COALESCE(expansion_mrr, 0) - COALESCE(churned_mrr, 0)
                - COALESCE(contraction_mrr, 0)) / starting_mrr * 100, 2) END AS nrr_percent,
           cac_from_inputs, cac AS cac_stored,
           CASE WHEN ltv IS NOT NULL AND cac_used > 0 THEN round_even(ltv / cac_used, 2) END AS ltv_cac_ratio,
           CASE WHEN cac_used > 0 AND mrr IS NOT NULL AND gross_margin_percent IS NOT NULL
                 AND mrr * (gross_margin_percent / 100.0) > 0
                THEN round_even(cac_used / (mrr * (gross_margin_percent / 100.0)), 2) END AS cac_payback_months,
           CASE WHEN customers_start_of_month > 0
                THEN round_even(COALESCE(customers_lost, 0) / customers_start_of_month * 100, 4) END AS monthly_churn_percent,
           churn_rate AS churn_rate_stored, ltv AS ltv_stored, gross_margin_percent
    FROM (SELECT *, COALESCE(cac_from_inputs, CASE WHEN cac <> 0 THEN cac END) AS cac_used
          FROM (SELECT *, CASE WHEN sm_spend IS NOT NULL AND new_customers > 0
                               THEN round_even(sm_spend / new_customers, 2) END AS cac_from_inputs
                FROM kpi_in) a) b"""


def metrics_of(m: ModelTables):
    """The stored monthly_metrics table; KPI queries read it, as the app does."""
    return m.monthly_metrics


@register("mrr_movements", oracle=with_tables(METRIC_NEEDS, "SELECT * FROM metrics_out", METRIC_CTES))
def q_mrr_movements(spark, sf_dir):
    m = ModelTables(spark, sf_dir)
    return kpis.metrics_output(kpis.monthly_metrics(m.order_company, m.one_off_expenses))


@register("latest_metrics", oracle=with_tables(METRIC_NEEDS, "SELECT * FROM latest_m", METRIC_CTES))
def q_latest_metrics(spark, sf_dir):
    return kpis.latest_metrics(metrics_of(ModelTables(spark, sf_dir)))


@register("metric_pairs", oracle=with_tables(METRIC_NEEDS, """
    SELECT company_id, month_date, metric, value FROM (
      UNPIVOT (SELECT company_id, month_date, CAST(mau AS DOUBLE) AS mau, cac, churn_rate, ltv, revenue_per_employee,
                      mrr, expansion_mrr, contraction_mrr, churned_mrr, starting_mrr,
                      CAST(new_customers AS DOUBLE) AS new_customers, sm_spend,
                      CAST(customers_start_of_month AS DOUBLE) AS customers_start_of_month,
                      CAST(customers_lost AS DOUBLE) AS customers_lost FROM latest_m)
      ON COLUMNS(* EXCLUDE (company_id, month_date)) INTO NAME metric VALUE value)
    WHERE value IS NOT NULL""", METRIC_CTES))
def q_metric_pairs(spark, sf_dir):
    return kpis.metric_pairs(kpis.latest_metrics(metrics_of(ModelTables(spark, sf_dir))))


@register("saas_kpis", oracle=with_tables(METRIC_NEEDS + ["health"], KPI_SELECT, METRIC_CTES + [
    ("kpi_in", """SELECT m.*, h.gross_margin_percent FROM metrics_out m
                  LEFT JOIN health h ON h.company_id = m.company_id AND h.forecast_month = m.month_date""")]))
def q_saas_kpis(spark, sf_dir):
    m = ModelTables(spark, sf_dir)
    gm = health_of(m).selectExpr("company_id", "forecast_month AS month_date", "gross_margin_percent")
    return kpis.saas_kpis(kpis.metrics_output(metrics_of(m)), gm)


@register("saas_kpis_latest", oracle=with_tables(METRIC_NEEDS + ["health"], KPI_SELECT, METRIC_CTES + [
    ("kpi_in", """SELECT m.*, h.gross_margin_percent FROM latest_m m
                  LEFT JOIN (SELECT company_id, gross_margin_percent FROM (
                               SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY forecast_month DESC) rn
                               FROM health) WHERE rn = 1) h ON h.company_id = m.company_id""")]))
def q_saas_kpis_latest(spark, sf_dir):
    m = ModelTables(spark, sf_dir)
    return kpis.saas_kpis_latest(metrics_of(m), health_exact_of(m))
