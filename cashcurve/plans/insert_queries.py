"""Query keys for inserts, deletes and cascades over every table: A7 A8 J7 J8.

Requests are derived from the landed tables, with values left out here and there so that every default is used.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cashcurve.functions.exprs import MONEY, dbl, money
from cashcurve.operators import inserts as ins
from cashcurve.plans.oracle_tables import with_tables
from cashcurve.plans.registry import register
from cashcurve.sources.model import BUDGET_FACTOR, N_COMPANIES, ModelTables, _dec

GONE = 5      # deletions take every row whose key is divisible by this


@register("insert_products", oracle=with_tables(["products"], f"""
    SELECT (SELECT MAX(id) FROM products) + row_number() OVER (ORDER BY p_partkey) AS id,
           CAST(p_partkey % {N_COMPANIES} AS INTEGER) AS company_id, 'new ' || p_name AS name,
           CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS sku,
           CASE WHEN p_partkey % 5 = 0 THEN 0.0 ELSE CAST(CAST(p_retailprice AS DECIMAL(19,4)) AS DOUBLE) END AS default_sales_price,
           0.0::DOUBLE AS default_cogs, TRUE AS is_active
    FROM part"""))
def q_insert_products(spark, sf_dir):
    m = ModelTables(spark, sf_dir)
    k = F.col("p_partkey")
    req = m.raw.part.select(
        (k % N_COMPANIES).alias("company_id"), F.concat(F.lit("new "), "p_name").alias("name"), F.when(k % 3 != 0, F.col("p_brand")).alias("sku"),
        F.when(k % 5 != 0, money("p_retailprice")).alias("default_sales_price"), k.alias("_order"))
    rows = ins.insert_rows(m.products, req, "products", ["_order"])
    return rows.withColumn("default_sales_price", dbl("default_sales_price")).withColumn("default_cogs", dbl("default_cogs"))


@register("insert_expenses", oracle=with_tables(["fixed_expenses"], """
    SELECT (SELECT MAX(id) FROM fixed_expenses) + row_number() OVER (ORDER BY s_suppkey) AS id, CAST(s_nationkey AS INTEGER) AS company_id,
           'new ' || s_name AS name,
           CASE WHEN s_suppkey % 6 = 0 THEN 0.0 ELSE CAST(CAST(abs(s_acctbal) AS DECIMAL(19,4)) AS DOUBLE) END AS amount,
           'monthly' AS frequency, 1 AS payment_day
    FROM supplier"""))
def q_insert_expenses(spark, sf_dir):
    m = ModelTables(spark, sf_dir)
    req = m.raw.supplier.select(F.col("s_nationkey").alias("company_id"), F.concat(F.lit("new "), "s_name").alias("name"),
                                F.when(F.col("s_suppkey") % 6 != 0, money(F.abs("s_acctbal"))).alias("amount"), F.col("s_suppkey").alias("_order"))
    return ins.insert_rows(m.fixed_expenses, req, "fixed_expenses", ["_order"]).withColumn("amount", dbl("amount"))


@register("insert_leads", oracle=with_tables(["leads"], """
    SELECT (SELECT MAX(id) FROM leads) + row_number() OVER (ORDER BY c_custkey) AS id, CAST(c_nationkey AS INTEGER) AS company_id,
           c_name AS client_name,
           CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE CAST(CAST(abs(c_acctbal) AS DECIMAL(19,4)) AS DOUBLE) END AS contract_value,
           CAST(CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 30 END AS INTEGER) AS probability, CAST(NULL AS DATE) AS expected_close_date
    FROM customer"""))
def q_insert_leads(spark, sf_dir):
    m = ModelTables(spark, sf_dir)
    k = F.col("c_custkey")
    req = m.raw.customer.select(F.col("c_nationkey").alias("company_id"), F.col("c_name").alias("client_name"),
                                F.when(k % 4 != 0, money(F.abs("c_acctbal"))).alias("contract_value"), F.when(k % 7 != 0, F.lit(30)).alias("probability"),
                                k.alias("_order"))
    return ins.insert_rows(m.leads, req, "leads", ["_order"]).withColumn("contract_value", dbl("contract_value"))


@register("insert_projects", oracle=with_tables(["projects"], """
    SELECT (SELECT MAX(id) FROM projects) + row_number() OVER (ORDER BY s_suppkey) AS id, CAST(s_nationkey AS INTEGER) AS company_id,
           'fit-out ' || s_name AS project_name, CASE WHEN s_suppkey % 2 = 0 THEN 'active' ELSE 'planned' END AS status
    FROM supplier"""))
def q_insert_projects(spark, sf_dir):
    m = ModelTables(spark, sf_dir)
    req = m.raw.supplier.select(F.col("s_nationkey").alias("company_id"), F.concat(F.lit("fit-out "), "s_name").alias("project_name"),
                                F.when(F.col("s_suppkey") % 2 == 0, "active").alias("status"), F.col("s_suppkey").alias("_order"))
    return ins.insert_rows(m.projects, req, "projects", ["_order"])


def budget_requests(m: ModelTables):
    """One budget request per finished order, with its lines as installments (bounded by an order's lines)."""
    o = m.raw.orders.filter(F.col("o_orderstatus") == "F")
    lines = m.raw.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(
        F.col("l_linenumber").alias("n"), (money("l_extendedprice") * _dec(BUDGET_FACTOR)).cast(MONEY).alias("payment_amount"),
        F.to_date("l_shipdate").alias("expected_payment_date")))).alias("installments"))
    j = o.join(lines, o.o_orderkey == lines.l_orderkey, "left")
    return j.select(F.col("o_custkey").alias("project_id"), F.concat(F.lit("again-"), F.col("o_orderkey").cast("string")).alias("item_name"),
                    F.col("o_orderpriority").alias("grouping_category"), (money("o_totalprice") * _dec(BUDGET_FACTOR)).cast(MONEY).alias("total_amount"),
                    F.to_date("o_orderdate").alias("start_date"), "installments", F.col("o_orderkey").alias("_order"))


@register("insert_budget", oracle=with_tables(["project_budgets"], """
    SELECT p.id, p.project_id, p.item_name, p.supplier, p.grouping_category, p.total_amount, p.start_date,
           CAST(CAST(CAST(l.l_extendedprice AS DECIMAL(19,4)) * 0.0025 AS DECIMAL(19,4)) AS DOUBLE) AS payment_amount,
           CAST(l.l_shipdate AS DATE) AS expected_payment_date
    FROM (SELECT (SELECT MAX(id) FROM project_budgets) + row_number() OVER (ORDER BY o_orderkey) AS id, o_orderkey, o_custkey AS project_id,
                 'again-' || o_orderkey AS item_name, CAST(NULL AS VARCHAR) AS supplier, o_orderpriority AS grouping_category,
                 CAST(CAST(CAST(o_totalprice AS DECIMAL(19,4)) * 0.0025 AS DECIMAL(19,4)) AS DOUBLE) AS total_amount,
                 CAST(o_orderdate AS DATE) AS start_date
          FROM orders WHERE o_orderstatus = 'F') p
    LEFT JOIN lineitem l ON l.l_orderkey = p.o_orderkey"""))
def q_insert_budget(spark, sf_dir):
    """Parents and children as inserted, one row per installment."""
    m = ModelTables(spark, sf_dir)
    parents, children = ins.insert_budgets(m.project_budgets, budget_requests(m), ["_order"])
    j = parents.join(children, parents.id == children.budget_item_id, "left").drop("budget_item_id")
    return j.withColumn("total_amount", dbl("total_amount")).withColumn("payment_amount", dbl("payment_amount"))


@register("delete_forecast", oracle=with_tables(["forecast_entries"], f"""
    SELECT id, company_id, product_id, forecast_month, units_forecasted FROM forecast_entries WHERE units_forecasted % {GONE} <> 0"""))
def q_delete_forecast(spark, sf_dir):
    """The forecast table after deleting a list of ids."""
    fe = ModelTables(spark, sf_dir).forecast_entries
    doomed = fe.filter(F.col("units_forecasted") % GONE == 0).select("id")
    after = ins.delete_everywhere({"forecast_entries": fe}, "forecast_entries", doomed)["forecast_entries"]
    return after.select("id", "company_id", "product_id", "forecast_month", "units_forecasted")


@register("delete_budget_item", oracle=with_tables(["project_budgets", "installments"], f"""
    SELECT b.id, b.item_name, CAST(i.payment_amount AS DOUBLE) AS payment_amount, i.expected_payment_date
    FROM project_budgets b LEFT JOIN installments i ON i.budget_item_id = b.id WHERE b.id % {GONE} <> 0"""))
def q_delete_budget_item(spark, sf_dir):
    """J7 + J8: budget items after a deletion, with the installments the cascade left."""
    m = ModelTables(spark, sf_dir)
    after = ins.delete_everywhere({"project_budgets": m.project_budgets, "installments": m.installments}, "project_budgets",
                                  m.project_budgets.filter(F.col("id") % GONE == 0).select("id"))
    b, i = after["project_budgets"], after["installments"]
    return (b.join(i, b.id == i.budget_item_id, "full").select("id", "item_name", dbl("payment_amount").alias("payment_amount"), "expected_payment_date"))


CASCADED = ("products", "fixed_expenses", "forecast_entries", "leads", "lead_links", "connections", "cash_balances", "projects",
            "project_budgets")


@register("cascade_company", oracle=with_tables(list(CASCADED), " UNION ALL ".join(
    [f"SELECT '{t}' AS table_name, CAST(id AS VARCHAR) AS id FROM {t} WHERE company_id % {GONE} <> 0"
     + (f" AND product_id IN (SELECT id FROM products WHERE company_id % {GONE} <> 0)" if t == "forecast_entries" else "")
     for t in CASCADED if t != "project_budgets"]
    + [f"SELECT 'project_budgets', CAST(b.id AS VARCHAR) FROM project_budgets b JOIN projects p ON p.id = b.project_id WHERE p.company_id % {GONE} <> 0"])))
def q_cascade_company(spark, sf_dir):
    """The rows of every table that are left after companies are deleted."""
    m = ModelTables(spark, sf_dir)
    tables = {"companies": m.companies} | {t: getattr(m, t) for t in CASCADED}
    after = ins.delete_everywhere(tables, "companies", m.companies.filter(F.col("id") % GONE == 0).select("id"))
    out = None
    for t in CASCADED:
        rows = after[t].select(F.lit(t).alias("table_name"), F.col("id").cast("string").alias("id"))
        out = rows if out is None else out.unionByName(rows)
    return out
