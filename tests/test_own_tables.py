"""A user's own finance tables, appended sources, inserts, deletes and cascades."""

import datetime as dt
import decimal
import os
import shutil

import pytest
from pyspark.sql import functions as F

from cashcurve.api import FinanceApi
from cashcurve.operators import inserts as ins
from cashcurve.sources.model import ModelTables
from cashcurve.sources.schemas import SCHEMAS, OwnTables
from tests.conftest import SF_SMALL

D = decimal.Decimal


def _df(spark, table, *rows):
    return spark.createDataFrame([tuple(D(str(v)) if isinstance(v, float) else v for v in r) for r in rows], SCHEMAS[table])


@pytest.fixture(scope="module")
def own(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("own"))
    data = {
        "companies": [(1, "one"), (2, "two")],
        "products": [(10, 1, "jam", "J", 5.0, 2.0, True), (20, 2, "tea", None, 1.0, 0.5, True)],
        "fixed_expenses": [(1, 1, "rent", 30.0, "monthly", 1), (2, 1, "fee", 900.0, "annually", 1)],
        "forecast_entries": [("a", 1, 10, dt.date(2025, 1, 1), 20, None, None), ("b", 1, 10, dt.date(2025, 2, 1), 10, 6.0, None),
                             ("c", 2, 20, dt.date(2025, 1, 1), 4, None, 2.0)],
        "leads": [(7, 1, "acme", 200.0, 50, None)],
        "cash_balances": [(1, 1, dt.date(2025, 1, 31), 500.0)],
        "one_off_expenses": [(1, 1, None, "desk", 10.0, dt.date(2025, 1, 9))],
    }
    for name in SCHEMAS:
        _df(spark, name, *data.get(name, [])).write.parquet(f"{root}/{name}.parquet")
    return OwnTables(spark, root)


def test_api_over_own_tables(own):
    rows = FinanceApi.over(own).dashboard(1).collect()
    assert [(r.forecast_month, r.revenue, r.variable_costs, r.fixed_costs, r.net_profit, r.weighted_pipeline_value, r.ytd_net_profit) for r in rows] == [
        (dt.date(2025, 1, 1), 100.0, 40.0, 30.0, 30.0, 100.0, 30.0), (dt.date(2025, 2, 1), 60.0, 20.0, 30.0, 10.0, 100.0, 40.0)]
    assert [r.client_name for r in FinanceApi.over(own).leads(1).collect()] == ["acme"]
    assert FinanceApi.over(own).actuals_summary(1).count() == 0


def test_appended_rows_are_seen_by_the_next_query(spark, tmp_path):
    src = str(tmp_path / "sf")
    shutil.copytree(SF_SMALL, src, copy_function=shutil.copyfile)
    os.chmod(src, 0o755)
    before = ModelTables(spark, src).leads.count()
    extra = spark.read.parquet(f"{src}/orders.parquet").filter("o_orderstatus = 'O'").limit(1).withColumn("o_orderkey", F.lit(10 ** 9).cast("long"))
    both = spark.read.parquet(f"{src}/orders.parquet").unionByName(extra)
    both.write.parquet(f"{src}/orders_new.parquet")
    os.rename(f"{src}/orders.parquet", f"{src}/orders_old.parquet")
    os.rename(f"{src}/orders_new.parquet", f"{src}/orders.parquet")
    assert ModelTables(spark, src).leads.count() == before + 1


def test_insert_defaults_and_ids(spark, own):
    req = spark.createDataFrame([(1, "x", None, 2), (2, "y", D("3"), 1)], "company_id long, name string, default_cogs decimal(19,4), o int")
    rows = ins.insert_rows(own.products, req, "products", ["o"]).orderBy("id").collect()
    assert [(r.id, r.company_id, r.name, r.sku, r.default_sales_price, r.default_cogs, r.is_active) for r in rows] == [
        (21, 2, "y", None, 0, 3, True), (22, 1, "x", None, 0, 0, True)]


def test_insert_budget_writes_parent_and_children(spark, own):
    req = spark.createDataFrame([(5, "plan", D("9"), dt.date(2025, 1, 1), [(D("4"), dt.date(2025, 2, 1)), (D("5"), dt.date(2025, 3, 1))], 1),
                                 (5, "bare", D("1"), dt.date(2025, 1, 1), [], 2), (6, "none", D("1"), None, None, 3)],
                                "project_id long, item_name string, total_amount decimal(19,4), start_date date, "
                                "installments array<struct<payment_amount:decimal(19,4),expected_payment_date:date>>, o int")
    parents, children = ins.insert_budgets(own.project_budgets, req, ["o"])
    assert [(r.id, r.item_name) for r in parents.orderBy("id").collect()] == [(1, "plan"), (2, "bare"), (3, "none")]
    assert sorted((r.budget_item_id, r.payment_amount) for r in children.collect()) == [(1, 4), (1, 5)]


def test_delete_reaches_children_of_children(spark, own):
    tables = {"companies": own.companies, "products": own.products, "forecast_entries": own.forecast_entries, "leads": own.leads,
              "lead_links": _df(spark, "lead_links", (1, 1, 7, "xero", "C1"), (2, 2, 8, "xero", "C2")),
              "accounting_actual_lines": spark.createDataFrame([(2, "k", 7, 3)], "company_id int, idempotency_key string, lead_id long, connection_id long")}
    after = ins.delete_everywhere(tables, "companies", spark.createDataFrame([(1,)], "id long"))
    assert [r.id for r in after["forecast_entries"].collect()] == ["c"] and [r.id for r in after["products"].collect()] == [20]
    assert after["leads"].count() == 0 and after["lead_links"].count() == 0            # link 2 named a lead that is gone
    assert [(r.company_id, r.lead_id, r.connection_id) for r in after["accounting_actual_lines"].collect()] == [(2, None, 3)]
