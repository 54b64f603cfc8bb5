"""Query keys for step 6 (projects): I21 I22 D9 D10 C11 D13 D14 P1-P5 A8."""

from __future__ import annotations

from pyspark.sql import functions as F

from cashcurve.operators import projects as pj
from cashcurve.plans.oracle_tables import with_tables
from cashcurve.plans.registry import ORACLE, register
from cashcurve.sources.model import ModelTables

SPINE_PAD_LEFT = 1    # P4: one "Expand" click to the left
SPINE_PAD_RIGHT = 1   # and one to the right


@register("project_variance", oracle=with_tables(["projects", "project_budgets", "one_off_expenses"], """
    SELECT project_id, company_id, project_name, total_budget, total_actuals, variance,
           CASE WHEN variance < 0 THEN 'Over Budget' WHEN variance > 0 AND total_actuals > 0 THEN 'Under Budget'
                ELSE 'On Budget' END AS status,
           CASE WHEN total_budget > 0 THEN LEAST(total_actuals / total_budget * 100, 100.0) ELSE 0.0 END
             AS burn_percent
    FROM (SELECT p.id AS project_id, p.company_id, p.project_name,
                 COALESCE(CAST(b.s AS DOUBLE), 0.0) AS total_budget,
                 COALESCE(CAST(a.s AS DOUBLE), 0.0) AS total_actuals,
                 COALESCE(CAST(b.s AS DOUBLE), 0.0) - COALESCE(CAST(a.s AS DOUBLE), 0.0) AS variance
          FROM projects p
          LEFT JOIN (SELECT project_id, SUM(total_amount) AS s FROM project_budgets GROUP BY 1) b ON b.project_id = p.id
          LEFT JOIN (SELECT project_id, SUM(amount) AS s FROM one_off_expenses GROUP BY 1) a ON a.project_id = p.id) t
    """))
def q_project_variance(spark, sf_dir):
    m = ModelTables(spark, sf_dir)
    return pj.project_variance(m.projects, m.project_budgets, m.one_off_expenses)


@register("project_cashflow", oracle=with_tables(["project_budgets", "installments"], """
    SELECT b.project_id, b.id AS budget_item_id, b.item_name, b.grouping_category,
           CAST(b.total_amount AS DOUBLE) AS total_amount, b.start_date,
           CAST(i.payment_amount AS DOUBLE) AS payment_amount, i.expected_payment_date
    FROM project_budgets b LEFT JOIN installments i ON i.budget_item_id = b.id
    ORDER BY b.project_id, b.start_date, b.id, i.expected_payment_date"""))
def q_project_cashflow(spark, sf_dir):
    m = ModelTables(spark, sf_dir)
    return pj.project_cashflow(m.project_budgets, m.installments, whole=False)


@register("project_cashflow_lists", oracle=ORACLE["project_cashflow"].replace("ORDER BY b.project_id, b.start_date, b.id, i.expected_payment_date", ""))
def q_project_cashflow_lists(spark, sf_dir):
    """C11: the nested cash flow of all projects, its lists taken apart again for the comparison."""
    m = ModelTables(spark, sf_dir)
    nested = pj.project_cashflow_chunks(m.project_budgets, m.installments)
    return nested.select("*", F.explode_outer("installments").alias("i")).select(
        "project_id", "budget_item_id", "item_name", "grouping_category", "total_amount", "start_date", "i.payment_amount", "i.expected_payment_date")


@register("timeline_matrix", oracle=with_tables(["project_budgets", "installments"], """
    SELECT b.project_id, i.budget_item_id, strftime(i.expected_payment_date, '%Y-%m') AS month,
           CAST(SUM(i.payment_amount) AS DOUBLE) AS amount
    FROM installments i JOIN project_budgets b ON b.id = i.budget_item_id
    GROUP BY 1, 2, 3 HAVING SUM(i.payment_amount) > 0"""))
def q_timeline_matrix(spark, sf_dir):
    m = ModelTables(spark, sf_dir)
    return pj.timeline_matrix(m.project_budgets, m.installments)


@register("timeline_spine", oracle=with_tables(["project_budgets", "installments"], f"""
    SELECT s.project_id, CAST(row_number() OVER (PARTITION BY s.project_id ORDER BY g.m) AS INTEGER) AS month_index,
           strftime(g.m, '%Y-%m') AS month
    FROM (SELECT b.project_id,
                 MIN(date_trunc('month', i.expected_payment_date)) - INTERVAL {SPINE_PAD_LEFT} MONTH AS lo,
                 MAX(date_trunc('month', i.expected_payment_date)) + INTERVAL {SPINE_PAD_RIGHT} MONTH AS hi
          FROM installments i JOIN project_budgets b ON b.id = i.budget_item_id GROUP BY 1) s,
         LATERAL (SELECT unnest(generate_series(s.lo, s.hi, INTERVAL 1 MONTH)) AS m) g"""))
def q_timeline_spine(spark, sf_dir):
    m = ModelTables(spark, sf_dir)
    return pj.timeline_spine(m.project_budgets, m.installments, SPINE_PAD_LEFT, SPINE_PAD_RIGHT)


@register("installment_schedule", oracle=with_tables(["project_budgets"], """
    SELECT r.budget_item_id, CAST(k.i + 1 AS INTEGER) AS installment_no,
           ROUND(CAST(r.total_amount AS DOUBLE) / r.n, 2) AS payment_amount,
           CAST(r.start_date + CAST(k.i * r.days AS INTEGER) AS DATE) AS expected_payment_date,
           CAST(r.total_amount AS DOUBLE) - ROUND(CAST(r.total_amount AS DOUBLE) / r.n, 2) * GREATEST(r.n, 0) AS residual
    FROM (SELECT id AS budget_item_id, total_amount, start_date,
                 CASE WHEN id % 7 - 1 = 0 THEN 1 ELSE id % 7 - 1 END AS n, (id % 4) * 15 AS days
          FROM project_budgets) r,
         LATERAL (SELECT unnest(range(0, r.n)) AS i) k"""))
def q_installment_schedule(spark, sf_dir):
    m = ModelTables(spark, sf_dir)
    _, child = pj.split_parent_child(pj.equal_split_payload(pj.schedule_requests(m.project_budgets)))
    return child


@register("move_payments", oracle=with_tables(["project_budgets", "installments"], """
    SELECT i.budget_item_id, CAST(i.payment_amount AS DOUBLE) AS payment_amount,
           CASE WHEN mv.new_month IS NOT NULL THEN CAST(strptime(mv.new_month || '-01', '%Y-%m-%d') AS DATE)
                ELSE i.expected_payment_date END AS expected_payment_date,
           mv.new_month IS NOT NULL AS moved
    FROM installments i LEFT JOIN (
      SELECT b.id AS budget_item_id, strftime(f.d, '%Y-%m') AS old_month, strftime(b.start_date, '%Y-%m') AS new_month
      FROM project_budgets b
      JOIN (SELECT budget_item_id, MIN(expected_payment_date) AS d FROM installments GROUP BY 1) f
        ON f.budget_item_id = b.id) mv
    ON mv.budget_item_id = i.budget_item_id AND mv.old_month = strftime(i.expected_payment_date, '%Y-%m')"""))
def q_move_payments(spark, sf_dir):
    m = ModelTables(spark, sf_dir)
    return pj.move_payments(m.installments, pj.move_requests(m.project_budgets, m.installments))
