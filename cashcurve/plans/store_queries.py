"""Query keys over tables stored as change sets (A9, M6, J5): columns that come and go between change sets."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from cashcurve.plans.oracle_tables import with_tables
from cashcurve.plans.registry import register
from cashcurve.session import checkpoint_dir
from cashcurve.sources.batches import BatchTable
from cashcurve.sources.model import ModelTables
from cashcurve.sources.schemas import DEFAULTS, SCHEMAS
from cashcurve.sources.stored import StoredTables


@register("store_schema_change", oracle=with_tables(["products"], """
    SELECT id, CAST(company_id AS BIGINT) AS company_id, CASE WHEN id % 5 = 0 THEN name || ' (renamed)' ELSE name END AS name,
           CAST(CASE WHEN id % 3 = 0 THEN default_sales_price * 2 ELSE default_sales_price END AS DOUBLE) AS default_sales_price,
           CASE WHEN id % 3 = 0 THEN sku END AS sku, CASE WHEN id % 3 = 0 THEN id % 2 = 0 ELSE TRUE END AS is_active
    FROM products"""))
def q_store_schema_change(spark, sf_dir):
    """Three change sets of the product table: without sku and is_active, with both (every third product), without prices (every fifth).

    Prices outlive the change set that lacks them, the new columns reach back as NULL or as their declared default, and the base that a
    batch job folds after the second change set changes nothing.
    """
    products = ModelTables(spark, sf_dir).products
    table = BatchTable(spark, os.path.join(checkpoint_dir(spark), "stored-products", uuid.uuid4().hex), ["id"],
                       ["name", "default_sales_price", "sku", "is_active"], DEFAULTS["products"])
    table.write(0, products.select("id", "company_id", "name", "default_sales_price"))
    third = products.filter(F.col("id") % 3 == 0)
    table.write(1, third.select("id", "company_id", "name", (F.col("default_sales_price") * 2).cast("decimal(19,4)").alias("default_sales_price"), "sku",
                                (F.col("id") % 2 == 0).alias("is_active")))
    table.rewrite_base()
    fifth = products.filter(F.col("id") % 5 == 0)
    table.write(2, fifth.select("id", "company_id", F.concat("name", F.lit(" (renamed)")).alias("name")))
    return table.read().select("id", F.col("company_id").cast("long").alias("company_id"), "name",
                               F.col("default_sales_price").cast("double").alias("default_sales_price"), "sku", "is_active")


def stored_model(spark, tables: dict) -> StoredTables:
    """A user's own tables made of model tables, in a folder of their own."""
    root = os.path.join(checkpoint_dir(spark), "stored-tables", uuid.uuid4().hex)
    for name, df in tables.items():
        cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields]
        df.select(*cols).write.parquet(f"{root}/{name}.parquet")
    return StoredTables(spark, root)


@register("stored_requests", oracle=with_tables(["leads", "lead_links", "project_budgets", "installments"], """
    SELECT 'leads' AS table_name, CAST(id AS BIGINT) AS id, client_name AS label FROM leads WHERE id % 5 <> 0
    UNION ALL SELECT 'leads', (SELECT max(id) FROM leads) + row_number() OVER (ORDER BY c_custkey), 'new ' || c_name FROM customer
    UNION ALL SELECT 'lead_links', CAST(id AS BIGINT), external_contact_id FROM lead_links WHERE lead_id % 5 <> 0
    UNION ALL SELECT 'project_budgets', CAST(id AS BIGINT), item_name FROM project_budgets WHERE id % 5 <> 0
    UNION ALL SELECT 'installments', CAST(budget_item_id AS BIGINT), CAST(count(*) AS VARCHAR) FROM installments WHERE budget_item_id % 5 <> 0 GROUP BY budget_item_id"""))
def q_stored_requests(spark, sf_dir):
    """Leads are inserted, leads and budget items deleted with what hangs on them, and every table read back from the store."""
    m = ModelTables(spark, sf_dir)
    t = stored_model(spark, {n: getattr(m, n) for n in ("leads", "lead_links", "project_budgets", "installments")})
    fresh = m.raw.customer.select(F.col("c_nationkey").alias("company_id"), F.concat(F.lit("new "), "c_name").alias("client_name"), F.col("c_custkey").alias("o"))
    old_leads, old_items = t.leads, t.project_budgets
    t.insert("leads", fresh, ["o"])
    t.delete("leads", old_leads.filter(F.col("id") % 5 == 0).select("id"))
    t.rewrite("leads")
    t.delete("project_budgets", old_items.filter(F.col("id") % 5 == 0).select("id"))
    row = lambda df, name, label: df.select(F.lit(name).alias("table_name"), F.col("id").cast("long").alias("id"), label.cast("string").alias("label"))
    parts = t.installments.groupBy(F.col("budget_item_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return (row(t.leads, "leads", F.col("client_name")).unionByName(row(t.lead_links, "lead_links", F.col("external_contact_id")))
            .unionByName(row(t.project_budgets, "project_budgets", F.col("item_name"))).unionByName(row(parts, "installments", F.col("n"))))


@register("onboarding_cascade", oracle=with_tables(["sessions"], """
    SELECT 'sessions' AS table_name, CAST(id AS BIGINT) AS id, CAST(NULL AS BIGINT) AS session_id, CAST(NULL AS BIGINT) AS profile_id
    FROM sessions WHERE company_id % 5 <> 0 AND id % 3 <> 0
    UNION ALL SELECT 'profiles', company_id + 1, CASE WHEN s % 3 <> 0 THEN s END, NULL
    FROM (SELECT company_id, max(id) AS s FROM sessions GROUP BY 1) p WHERE company_id % 5 <> 0
    UNION ALL SELECT 'runs', id, CASE WHEN id % 3 <> 0 THEN id END, company_id + 1 FROM sessions WHERE company_id % 5 <> 0"""))
def q_onboarding_cascade(spark, sf_dir):
    """J8 over the onboarding tables: deleted companies take sessions, profiles and runs along, deleted sessions only their references."""
    m = ModelTables(spark, sf_dir)
    s = m.onboarding_sessions
    profiles = s.groupBy("company_id").agg(F.max("id").alias("session_id")).withColumn("id", F.col("company_id") + 1)
    runs = s.select("id", "company_id", F.col("id").alias("session_id"), (F.col("company_id") + 1).alias("profile_id"))
    t = stored_model(spark, {"companies": m.companies, "onboarding_sessions": s, "company_onboarding_profiles": profiles, "onboarding_calibration_runs": runs})
    t.delete("companies", m.companies.filter(F.col("id") % 5 == 0).select("id"))
    t.delete("onboarding_sessions", s.filter(F.col("id") % 3 == 0).select("id"))
    row = lambda df, name, session, profile: df.select(F.lit(name).alias("table_name"), F.col("id").cast("long").alias("id"),
                                                       session.cast("long").alias("session_id"), profile.cast("long").alias("profile_id"))
    none = F.lit(None)
    return (row(t.onboarding_sessions, "sessions", none, none).unionByName(row(t.company_onboarding_profiles, "profiles", F.col("session_id"), none))
            .unionByName(row(t.onboarding_calibration_runs, "runs", F.col("session_id"), F.col("profile_id"))))
