"""Requests stored over a user's own tables and read back by the same API."""

import datetime as dt
import decimal
import os
import uuid

import pytest
from pyspark.sql import functions as F

from cashcurve.api import FinanceApi
from cashcurve.session import checkpoint_dir
from cashcurve.sources.schemas import SCHEMAS
from cashcurve.sources.stored import StoredTables, parents_first

D = decimal.Decimal


def _df(spark, table, *rows):
    width = len(SCHEMAS[table])
    return spark.createDataFrame([(*(D(str(v)) if isinstance(v, float) else v for v in r), *([None] * (width - len(r)))) for r in rows], SCHEMAS[table])


@pytest.fixture
def own(spark):
    root = os.path.join(checkpoint_dir(spark), "own", uuid.uuid4().hex)
    data = {
        "companies": [(1, "one"), (2, "two")],
        "products": [(10, 1, "jam", "J", 5.0, 2.0, True), (20, 2, "tea", None, 1.0, 0.5, True)],
        "fixed_expenses": [(1, 1, "rent", 30.0, "monthly", 1)],
        "forecast_entries": [("a", 1, 10, dt.date(2025, 1, 1), 20, None, None), ("b", 1, 10, dt.date(2025, 2, 1), 10, 6.0, None)],
        "leads": [(7, 1, "acme", 200.0, 50, None), (8, 2, "other", 10.0, 10, None)],
        "lead_links": [(1, 1, 7, "xero", "C1"), (2, 2, 8, "xero", "C2")],
        "projects": [(3, 1, "shop", "active"), (4, 2, "hall", "active")],
        "project_budgets": [(30, 3, "floor", None, None, 9.0, None), (40, 4, "roof", None, None, 9.0, None)],
        "installments": [(30, 4.0, dt.date(2025, 2, 1)), (30, 4.0, dt.date(2025, 2, 1)), (40, 1.0, None)],
        "connections": [(5, 1, "xero", "T1", None), (6, 2, "quickbooks", None, "R2")],
        "accounting_actual_lines": [(1, 5, "xero", "cash", "invoice_payment", "I", "P", "C1", "n", 4.0, "GBP", dt.date(2025, 1, 2), "k1", 7),
                                    (2, 6, "xero", "cash", "invoice_payment", "I", "P", "C2", "n", 4.0, "GBP", dt.date(2025, 1, 2), "k2", 8)],
        "onboarding_sessions": [(1, 1, "in_progress", False), (2, 2, "in_progress", False)],
        "company_onboarding_profiles": [(1, 1, 1, 1, "{}"), (2, 2, 2, 1, "{}")],
        "onboarding_calibration_runs": [(1, 1, 1, 1, "queued"), (2, 2, 2, 2, "queued")],
    }
    for name in SCHEMAS:
        _df(spark, name, *data.get(name, [])).coalesce(1).write.parquet(f"{root}/{name}.parquet")
    return StoredTables(spark, root)


def test_inserts_are_read_back_and_a_request_counts_once(spark, own):
    api = FinanceApi.over(own)
    req = spark.createDataFrame([(1, "new", 1)], "company_id int, client_name string, o int")
    assert [(r.id, r.client_name, r.contract_value) for r in api.add("leads", req, ["o"], request=0).collect()] == [(9, "new", 0)]
    api.add("leads", req, ["o"], request=0)                                  # delivered again
    assert sorted(r.client_name for r in api.leads(1).collect()) == ["acme", "new"]
    budget = spark.createDataFrame([(3, "plan", D("9"), dt.date(2025, 1, 1), [(D("4"), dt.date(2025, 2, 1)), (D("5"), dt.date(2025, 3, 1))], 1)],
                                   "project_id long, item_name string, total_amount decimal(19,4), start_date date, "
                                   "installments array<struct<payment_amount:decimal(19,4),expected_payment_date:date>>, o int")
    items, parts = api.add_budget(budget, ["o"])
    assert [r.id for r in items.collect()] == [41] and parts.count() == 2
    assert sorted(r.item_name for r in api.project_cashflow_nested(3).collect()) == ["floor", "plan"]
    for table in ("leads", "project_budgets", "installments"):
        own.rewrite(table)
    assert api.leads(1).count() == 2 and own.installments.count() == 5 and own.batches() == [0, 1]


def test_a_request_that_dies_between_two_tables_is_not_there(spark, own, monkeypatch):
    req = spark.createDataFrame([(3, "plan", [(D("4"), dt.date(2025, 2, 1))], 1)],
                                "project_id long, item_name string, installments array<struct<payment_amount:decimal(19,4),expected_payment_date:date>>, o int")
    put, seen = StoredTables._put, []

    def dies(self, *a):
        seen.append(a[1])
        if len(seen) == 2:
            raise OSError("died")
        return put(self, *a)
    monkeypatch.setattr(StoredTables, "_put", dies)
    with pytest.raises(OSError):
        own.insert_budgets(req, ["o"], request=0)
    monkeypatch.undo()
    assert seen == ["project_budgets", "installments"] and own.batches() == []
    assert own.project_budgets.count() == 2 and own.installments.count() == 3
    own.insert_budgets(req, ["o"], request=0)                                # the same request again
    assert own.project_budgets.count() == 3 and own.installments.count() == 4


def test_deletes_follow_all_foreign_keys(spark, own):
    api = FinanceApi.over(own)
    api.delete("leads", spark.createDataFrame([(7,)], "id long"))
    assert api.leads(1).count() == 0 and [r.id for r in own.lead_links.collect()] == [2]
    assert {r.idempotency_key: r.lead_id for r in own.accounting_actual_lines.collect()} == {"k1": None, "k2": 8}
    api.delete("onboarding_sessions", spark.createDataFrame([(2,)], "id long"))
    assert {r.id: r.session_id for r in own.company_onboarding_profiles.collect()} == {1: 1, 2: None}
    assert {r.id: (r.session_id, r.profile_id) for r in own.onboarding_calibration_runs.collect()} == {1: (1, 1), 2: (None, 2)}
    api.delete("companies", spark.createDataFrame([(1,), (99,)], "id long"))
    assert [r.id for r in own.companies.collect()] == [2] and [r.id for r in own.products.collect()] == [20] and own.forecast_entries.count() == 0
    assert [r.budget_item_id for r in own.installments.collect()] == [40] and [r.id for r in own.project_budgets.collect()] == [40]
    assert [r.idempotency_key for r in own.accounting_actual_lines.collect()] == ["k2"]
    assert [r.id for r in own.company_onboarding_profiles.collect()] == [2] and [r.id for r in own.onboarding_calibration_runs.collect()] == [2]
    back = _df(spark, "installments", (30, 2.0, None))                        # rows added after a delete stay
    own.commit({"installments": back})
    assert sorted(r.budget_item_id for r in own.installments.collect()) == [30, 40]


def test_upserts_patches_links_and_completion(spark, own):
    api = FinanceApi.over(own)
    api.save_forecast(spark.createDataFrame([(1, 10, dt.date(2025, 2, 1), 99), (2, 20, dt.date(2025, 3, 17), 5)],
                                            "company_id int, product_id long, forecast_month date, units_forecasted int"))
    got = {r.id: (r.units_forecasted, r.price_override) for r in own.forecast_entries.collect()}
    assert got == {"a": (20, None), "b": (99, D("6")), "2-20-2025-03": (5, None)}
    for mau in (3, 4):
        api.save_metrics(spark.createDataFrame([(1, dt.date(2025, 1, mau), mau)], "company_id int, month_date date, mau int"))
    assert [(r.mau, r.cac) for r in own.monthly_metrics.collect()] == [(4, 0)]
    links = spark.createDataFrame([(1, 7, " XERO ", "C9"), (1, 8, "xero", "C8"), (1, 7, "sage", "C7")], "company_id int, lead_id long, provider string, external_contact_id string")
    assert sorted((r.external_contact_id, r.accepted) for r in api.link_leads(links).collect()) == [("C7", False), ("C8", False), ("C9", True)]
    assert sorted((r.id, r.external_contact_id) for r in own.lead_links.collect()) == [(1, "C1"), (2, "C2"), (3, "C9")]
    patches = spark.createDataFrame([(1, "k1", None), (2, "k2", 7)], "company_id int, idempotency_key string, lead_id long")
    assert {r.idempotency_key: r.accepted for r in api.patch_lines(patches).collect()} == {"k1": True, "k2": False}
    assert {r.idempotency_key: r.lead_id for r in own.accounting_actual_lines.collect()} == {"k1": None, "k2": 8}
    done = spark.createDataFrame([(1, 1), (2, 1)], "session_id long, company_id int")
    api.complete_sessions(done, "2025-05-01 10:00:00")
    api.complete_sessions(done, "2025-06-01 10:00:00")
    assert {r.id: (r.status, r.is_completed, r.completed_at) for r in own.onboarding_sessions.collect()} == {
        1: ("completed", True, dt.datetime(2025, 5, 1, 10)), 2: ("in_progress", False, None)}
    assert [(r.xero, r.quickbooks) for r in api.connections(1).collect()] == [(True, False)]


def test_parents_come_before_children_and_unread_tables_are_untouched(spark, own):
    order = parents_first()
    assert set(order) == set(SCHEMAS) and order.index("companies") < order.index("projects") < order.index("project_budgets") < order.index("installments")
    own.commit({"leads": _df(spark, "leads", (9, 1, "x", 1.0, 1, None))})
    plan = own.products._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert own.leads.filter(F.col("id") == 9).count() == 1
