"""Query keys for step 13 (declared extensions): X1-X4 (X5 is ``working_capital``)."""

from __future__ import annotations

from cashcurve.operators import distinct_sets as ds
from cashcurve.operators import extensions as ex
from cashcurve.operators import kpis
from cashcurve.plans.forecast_queries import health_of
from cashcurve.plans.kpi_queries import KPI_SELECT, METRIC_CTES, METRIC_NEEDS, metrics_of
from cashcurve.plans.oracle_tables import with_tables
from cashcurve.plans.registry import register
from cashcurve.sources.model import N_COMPANIES, ModelTables


@register("gmv_aov", oracle="""
    SELECT company_id, month, CAST(gmv AS DOUBLE) AS gmv, orders, ROUND(CAST(gmv AS DOUBLE) / orders, 2) AS aov
    FROM (SELECT c.c_nationkey AS company_id, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS month,
                 SUM(CAST(o.o_totalprice AS DECIMAL(19,4))) AS gmv, count(*) AS orders
          FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2) g""")
def q_gmv_aov(spark, sf_dir):
    return ex.gmv_aov(ModelTables(spark, sf_dir).order_company)


@register("conversion_rate", oracle=f"""
    SELECT company_id, visitors, converted,
           CASE WHEN visitors > 0 THEN ROUND(converted / visitors * 100, 2) END AS conversion_percent
    FROM (SELECT company_id, count(*) FILTER (WHERE viewed) AS visitors,
                 count(*) FILTER (WHERE viewed AND bought) AS converted
          FROM (SELECT CAST(user_id % {N_COMPANIES} AS INTEGER) AS company_id, user_id,
                       bool_or(event_type = 'view') AS viewed, bool_or(event_type = 'purchase') AS bought
                FROM events GROUP BY 1, 2) u GROUP BY 1) g""")
def q_conversion_rate(spark, sf_dir):
    return ex.conversion_rate(ModelTables(spark, sf_dir).raw.events, N_COMPANIES)


@register("repeat_rate", oracle="""
    SELECT company_id, customers, repeat_customers, ROUND(repeat_customers / customers * 100, 2) AS repeat_percent
    FROM (SELECT company_id, count(*) AS customers, count(*) FILTER (WHERE n >= 2) AS repeat_customers
          FROM (SELECT c.c_nationkey AS company_id, o.o_custkey, count(*) AS n
                FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2) x GROUP BY 1) g""")
def q_repeat_rate(spark, sf_dir):
    return ex.repeat_rate(ModelTables(spark, sf_dir).order_company)


@register("retention", oracle="""
    WITH cm AS (SELECT DISTINCT c.c_nationkey AS company_id, o.o_custkey AS k, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS month
                FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)
    SELECT a.company_id, a.month, count(*) AS customers, count(b.k) AS retained, ROUND(count(b.k) / count(*) * 100, 2) AS retention_percent
    FROM cm a LEFT JOIN cm b ON b.company_id = a.company_id AND b.k = a.k AND b.month = CAST(a.month + INTERVAL 1 MONTH AS DATE)
    GROUP BY 1, 2""")
def q_retention(spark, sf_dir):
    return ex.retention(ModelTables(spark, sf_dir).order_company)


@register("ltv", oracle=with_tables(METRIC_NEEDS + ["health"], """
    SELECT k.company_id, k.month_date, ROUND(m.mrr / m.mau, 2) AS arpa,
           CASE WHEN k.monthly_churn_percent > 0 AND k.gross_margin_percent IS NOT NULL
                THEN ROUND(m.mrr / m.mau * (k.gross_margin_percent / 100.0) / (k.monthly_churn_percent / 100.0), 2)
           END AS ltv
    FROM kpis k JOIN metrics_out m ON m.company_id = k.company_id AND m.month_date = k.month_date""",
    METRIC_CTES + [("kpi_in", """SELECT m.*, h.gross_margin_percent FROM metrics_out m
                  LEFT JOIN health h ON h.company_id = m.company_id AND h.forecast_month = m.month_date"""),
                   ("kpis", KPI_SELECT)]))
def q_ltv(spark, sf_dir):
    m = ModelTables(spark, sf_dir)
    mo = kpis.metrics_output(metrics_of(m))
    gm = health_of(m).selectExpr("company_id", "forecast_month AS month_date", "gross_margin_percent")
    return ex.ltv(kpis.saas_kpis(mo, gm, carry=("mau",)))


FIRST, LAST = "1995-03-01", "1996-04-01"        # months of retention_range
EVENTS_FIRST, EVENTS_LAST = "2024-01-01", "2024-02-01"


@register("conversion_range", oracle=f"""
    SELECT company_id, count(*) FILTER (WHERE viewed) AS visitors, count(*) FILTER (WHERE viewed AND bought) AS converted,
           CASE WHEN count(*) FILTER (WHERE viewed) > 0
                THEN ROUND(count(*) FILTER (WHERE viewed AND bought) / count(*) FILTER (WHERE viewed) * 100, 2) END AS conversion_percent
    FROM (SELECT CAST(user_id % {N_COMPANIES} AS INTEGER) AS company_id, user_id,
                 bool_or(event_type = 'view') AS viewed, bool_or(event_type = 'purchase') AS bought
          FROM events WHERE event_type IN ('view', 'purchase') AND ts >= DATE '{EVENTS_FIRST}' AND ts < DATE '{EVENTS_LAST}' + INTERVAL 1 MONTH GROUP BY 1, 2) u
    GROUP BY 1""")
def q_conversion_range(spark, sf_dir):
    """X2 over two months, from the monthly bitmaps."""
    return ds.conversion_range(ModelTables(spark, sf_dir).event_bitmaps, EVENTS_FIRST, EVENTS_LAST)


@register("retention_range", oracle=f"""
    WITH cm AS (SELECT DISTINCT CAST(c.c_nationkey AS INTEGER) AS company_id, o.o_custkey AS k, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS m
                FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
                WHERE o.o_orderdate >= DATE '{FIRST}' AND o.o_orderdate < DATE '{LAST}' + INTERVAL 1 MONTH),
    first AS (SELECT company_id, k, min(m) AS cohort FROM cm GROUP BY 1, 2),
    size AS (SELECT company_id, cohort, count(*) AS cohort_size FROM first GROUP BY 1, 2)
    SELECT f.company_id, f.cohort, CAST(datediff('month', f.cohort, cm.m) AS INTEGER) AS age, max(s.cohort_size) AS cohort_size, count(*) AS active,
           ROUND(count(*) / max(s.cohort_size) * 100, 2) AS retention_percent
    FROM first f JOIN cm ON cm.company_id = f.company_id AND cm.k = f.k JOIN size s ON s.company_id = f.company_id AND s.cohort = f.cohort
    GROUP BY 1, 2, 3""")
def q_retention_range(spark, sf_dir):
    """X3 over a period, by cohort and age, from the monthly bitmaps."""
    return ds.retention_range(ModelTables(spark, sf_dir).order_bitmaps, FIRST, LAST)
