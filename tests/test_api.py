"""Endpoint-shaped API: each method is the matching slice of the all-tenant operator."""

import pytest
from pyspark.sql import functions as F

from cashcurve.api import FinanceApi
from cashcurve.plans.catalog import QUERIES
from tests.conftest import SF_SMALL

C = 5


@pytest.fixture(scope="module")
def api(spark):
    return FinanceApi(spark, SF_SMALL)


def _same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("method,key", [
    ("dashboard", "financial_health"), ("runway", "runway"), ("net_burn", "net_burn_runway"),
    ("pl", "pl_matrix_long"), ("pl_by_product_month", "unit_margin"), ("cashflow", "cashflow_proxy"),
    ("balance_sheet", "balance_sheet"), ("kpis", "saas_kpis_latest"), ("latest_metrics", "latest_metrics"),
    ("leads", "lead_list"), ("cash_balances", "cash_history"), ("one_off_expenses", "one_off_history"),
    ("projects", "project_list"), ("actuals_summary", "actuals_summary"), ("actuals_lines", "actuals_lines"),
    ("lead_links", "lead_links"), ("onboarding_gate", "onboarding_gate"), ("open_session", "open_session"),
    ("top_products", "top_products"), ("financial_overview", "recent_months")])
def test_company_method_is_slice_of_all_tenant_query(spark, api, method, key):
    all_rows = QUERIES[key](spark, SF_SMALL).filter(F.col("company_id") == C)
    assert _same(getattr(api, method)(C), all_rows)


def test_project_methods(spark, api):
    pid = QUERIES["project_variance"](spark, SF_SMALL).orderBy(F.col("total_actuals").desc()).first().project_id
    assert _same(api.project_financials(pid),
                 QUERIES["project_variance"](spark, SF_SMALL).filter(F.col("project_id") == pid))
    assert _same(api.project_cashflow(pid),
                 QUERIES["project_cashflow"](spark, SF_SMALL).filter(F.col("project_id") == pid))


def test_profile_and_details(spark, api):
    doc = api.profile(C).first()
    assert doc is not None and doc.profile_keys == sorted(doc.data.keys())
    month = api.dashboard(C).first().forecast_month.isoformat()
    rows = api.dashboard_details(C, month).collect()
    assert rows and all(r.company_id == C for r in rows)


def test_nested_project_cashflow_matches_flat(spark, api):
    pid = QUERIES["project_variance"](spark, SF_SMALL).orderBy(F.col("total_budget").desc()).first().project_id
    nested = api.project_cashflow_nested(pid).collect()
    flat = api.project_cashflow(pid).collect()
    items = {r.budget_item_id for r in flat}
    assert {r.budget_item_id for r in nested} == items
    n_inst = sum(len(r.installments) for r in nested)
    assert n_inst == sum(1 for r in flat if r.payment_amount is not None)
    for r in nested:
        dates = [i.expected_payment_date for i in r.installments]
        assert dates == sorted(dates)


@pytest.mark.parametrize("method", ["dashboard", "runway", "actuals_lines", "kpis"])
def test_company_filter_reaches_the_scans(spark, api, method):
    plan = getattr(api, method)(C)._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(company_id,{C})" in plan
