"""Cross-operator properties and physical-plan checks on the sf0.001 tables."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from cashcurve.operators import forecast as fc
from cashcurve.operators import projects as pj
from cashcurve.plans.catalog import QUERIES
from cashcurve.plans.forecast_queries import health_exact_of, health_of
from cashcurve.sources.model import ModelTables
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def model(spark):
    return ModelTables(spark, SF_SMALL)


def test_last_running_total_is_sum_of_net_profit(model):
    h = health_exact_of(model)
    last = h.groupBy("company_id").agg(F.max_by("ytd_net_profit", "forecast_month").alias("ytd"),
                                       F.sum("net_profit").alias("total"))
    assert last.filter(F.col("ytd") != F.col("total")).count() == 0


def test_one_company_equals_filtered_all_companies(spark, model):
    """Every company's answer computed alone equals its slice of the all-tenant answer."""
    all_rows = health_of(model).filter(F.col("company_id") == 3).collect()
    e = model.forecast_entries.filter(F.col("company_id") == 3)
    alone = fc.financial_health(fc.forecast_details(e, model.products),
                                model.fixed_expenses.filter(F.col("company_id") == 3),
                                model.leads.filter(F.col("company_id") == 3)).collect()
    assert sorted(map(tuple, alone)) == sorted(map(tuple, all_rows))


def test_matrix_cells_sum_to_installments(model):
    cells = pj.timeline_matrix(model.project_budgets, model.installments).agg(F.sum("amount")).first()[0]
    inst = model.installments.agg(F.sum("payment_amount")).first()[0]
    assert abs(cells - float(inst)) < 1e-6


def test_split_residual_bound(model):
    p = pj.equal_split_payload(pj.schedule_requests(model.project_budgets))
    assert p.filter((F.col("splits") < 0) & (F.col("residual") != F.col("total_amount"))).count() == 0
    worst = p.filter(F.col("splits") > 0).select(F.max(F.abs("residual") - F.greatest("splits", F.lit(0)) * 0.005 - 1e-9)).first()[0]
    assert worst <= 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(k for k in QUERIES if k != "stream_ingest"))
def test_no_cartesian_product_and_no_python_udf(spark, key):
    plan = _plan(QUERIES[key](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


@pytest.mark.parametrize("stored", [True, False])
def test_tenant_filter_reaches_below_the_window(spark, stored):
    df = health_of(ModelTables(spark, SF_SMALL, stored=stored)).filter(F.col("company_id") == 3)
    opt = df._jdf.queryExecution().optimizedPlan().toString()
    window_at = opt.find("Window [")
    assert window_at >= 0 and "company_id#" in opt[window_at:] and "= 3" in opt[window_at:]
    if stored:   # the tenant filter reaches the stored forecast scan as a pushed parquet filter
        assert "EqualTo(company_id,3)" in _plan(df)


def test_parquet_scan_prunes_columns_and_pushes_filters(spark):
    import re
    plan = _plan(health_of(ModelTables(spark, SF_SMALL, stored=False)))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    li = [s for s in scans if "l_orderkey" in s]
    assert li and all(re.sub(r"#\d+L?", "", s).split(",") == [
        "l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_shipdate"] for s in li)
    assert "In(o_orderstatus, [O,P])" in plan


def test_stream_replay_changes_nothing(spark, model):
    from cashcurve.session import checkpoint_dir
    from cashcurve.sources.ledger_pages import landed_pages
    from cashcurve.streaming.ingest import land_pages, start_ingest
    root = os.path.join(checkpoint_dir(spark), f"t-{uuid.uuid4().hex[:8]}")
    glob = land_pages(landed_pages(model), os.path.join(root, "landing"), 2, 1)
    q, sink = start_ingest(spark, glob, os.path.join(root, "snap"), lambda: model.connections, lambda: model.lead_links, 1)
    q.awaitTermination()
    first = sink.table.read().drop("synced_at")
    v1 = max(sink.table.batches())
    # the same pages land again (a provider re-delivery) -> a new batch, same content
    glob2 = land_pages(landed_pages(model), os.path.join(root, "landing2"), 1, 1)
    q2, sink2 = start_ingest(spark, os.path.join(root, "landing*", "arrival_*"), os.path.join(root, "snap"),
                             lambda: model.connections, lambda: model.lead_links, 4)
    q2.awaitTermination()
    second = sink2.table.read().drop("synced_at")
    assert max(sink2.table.batches()) > v1
    assert first.exceptAll(second).count() == 0 and second.exceptAll(first).count() == 0
    batch = QUERIES["ledger_lines"](spark, SF_SMALL)
    from cashcurve.operators.ledger import lines_output
    assert lines_output(sink2.table.read()).exceptAll(batch).count() == 0


def test_company_alone_equals_its_slice_for_runway_variance_and_kpis(spark, model):
    from cashcurve.operators import kpis
    from cashcurve.operators import runway as rw
    c = 4

    def only(df, col="company_id"):
        return df.filter(F.col(col) == c)

    all_rw = rw.runway(rw.runway_inputs(model.companies, model.cash_balances, model.fixed_expenses, model.leads,
                                        model.one_off_expenses, health_exact_of(model)))
    alone_rw = rw.runway(rw.runway_inputs(only(model.companies, "id"), only(model.cash_balances),
                                          only(model.fixed_expenses), only(model.leads), only(model.one_off_expenses),
                                          fc.financial_health_exact(fc.forecast_details(only(model.forecast_entries),
                                                                                        model.products),
                                                                    only(model.fixed_expenses), only(model.leads))))
    assert sorted(map(tuple, only(all_rw).collect())) == sorted(map(tuple, alone_rw.collect()))

    all_pv = pj.project_variance(model.projects, model.project_budgets, model.one_off_expenses)
    alone_pv = pj.project_variance(only(model.projects), model.project_budgets, only(model.one_off_expenses))
    assert sorted(map(tuple, only(all_pv).collect())) == sorted(map(tuple, alone_pv.collect()))

    all_m = kpis.monthly_metrics(model.order_company, model.one_off_expenses)
    alone_m = kpis.monthly_metrics(model.order_company.filter(F.col("c_nationkey") == c), only(model.one_off_expenses))
    assert sorted(map(tuple, only(all_m).collect())) == sorted(map(tuple, alone_m.collect()))


def test_profile_document_map(spark, model):
    from cashcurve.operators import onboarding as ob
    rows = ob.profile_merge(model.profile_patches)
    doc = ob.profile_document(rows).filter(F.col("company_id") == 1).first()
    flat = {r.key: r.value for r in rows.filter(F.col("company_id") == 1).collect()}
    assert dict(doc.data) == flat and doc.profile_keys == sorted(flat)


def test_stored_forecast_is_month_partitioned_and_pruned(spark):
    import re
    from cashcurve.plans.catalog import QUERIES
    plan = _plan(QUERIES["month_drilldown"](spark, SF_SMALL))
    parts = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert any("forecast_month" in p and "1998-06-01" in p for p in parts)
