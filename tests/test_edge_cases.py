"""Hand-worked edge cases (FIXTURES section 4) on tiny in-memory tables."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from cashcurve.operators import forecast as fc
from cashcurve.operators import kpis, onboarding, projects, runway, statements
from cashcurve.operators import upsert as up

ENTRY = "id long, company_id int, product_id long, forecast_month date, units_forecasted int, " \
        "price_override decimal(19,4), cogs_override decimal(19,4)"
PRODUCT = "id long, company_id int, name string, sku string, default_sales_price decimal(19,4), " \
          "default_cogs decimal(19,4), is_active boolean"
FIXED = "id long, company_id int, name string, amount decimal(19,4), frequency string, payment_day int"
LEADS = "id long, company_id int, client_name string, contract_value decimal(19,4), probability int, " \
        "expected_close_date date, custkey long"


def m(y, mo):
    return dt.date(y, mo, 1)


def health(spark, entries, products, fixed, leads=()):
    e = spark.createDataFrame(entries, ENTRY)
    p = spark.createDataFrame(products, PRODUCT)
    f = spark.createDataFrame(fixed, FIXED)
    l = spark.createDataFrame(list(leads), LEADS)
    return fc.financial_health(fc.forecast_details(e, p), f, l)


def test_break_even_zero_when_gross_profit_not_positive_and_null_without_revenue(spark):
    products = [(1, 1, "a", None, D("10"), D("12"), True),     # negative margin
                (2, 1, "b", None, D("0"), D("-5"), True),      # zero price, negative COGS
                (3, 1, "c", None, D("10"), D("10"), True)]     # zero margin
    entries = [(1, 1, 1, m(2024, 1), 10, None, None),
               (2, 1, 2, m(2024, 2), 10, None, None),
               (3, 1, 3, m(2024, 3), 10, None, None)]
    fixed = [(1, 1, "rent", D("100"), "monthly", 1)]
    rows = {r.forecast_month.month: r for r in health(spark, entries, products, fixed).collect()}
    assert rows[1].gross_profit == -20.0 and rows[1].revenue_needed_to_break_even == 0.0     # S3
    assert rows[2].revenue == 0.0 and rows[2].gross_profit == 50.0
    assert rows[2].revenue_needed_to_break_even is None and rows[2].gross_margin_percent is None  # S4
    assert rows[3].revenue_needed_to_break_even == 0.0
    assert [rows[i].ytd_net_profit for i in (1, 2, 3)] == [-120.0, -170.0, -270.0]
    af = {r.forecast_month.month: r.status for r in fc.afloat_status(health(spark, entries, products, fixed)).collect()}
    assert af == {1: "Afloat", 2: "Sinking", 3: "Afloat"}   # 0 >= 0 is afloat; NULL break-even sinks


def test_only_monthly_bills_are_fixed_costs_but_burn_uses_all(spark):
    products = [(1, 1, "a", None, D("10"), D("4"), True)]
    entries = [(1, 1, 1, m(2024, 1), 10, None, None)]
    fixed = [(1, 1, "rent", D("100"), "monthly", 1), (2, 1, "audit", D("1200"), "annually", 1)]
    h = health(spark, entries, products, fixed).first()
    assert h.fixed_costs == 100.0                     # S1: view_financial_health
    ms = fc.monthly_summary(fc.forecast_details(spark.createDataFrame(entries, ENTRY),
                                                spark.createDataFrame(products, PRODUCT)),
                            spark.createDataFrame(fixed, FIXED)).first()
    assert ms.monthly_fixed_costs == 1300.0           # S1: view_monthly_summary
    assert h.revenue_needed_to_break_even == round(100 / 0.6, 2)


def test_rule_of_40_uses_row_positions_not_calendar(spark):
    products = [(1, 1, "a", None, D("10"), D("5"), True)]
    months = [m(2023, i) for i in range(1, 13)] + [m(2024, 3), m(2024, 4)]   # a gap after 12 rows
    entries = [(i, 1, 1, d, 10 + i, None, None) for i, d in enumerate(months)]
    h = health(spark, entries, products, [])
    r = {x.forecast_month: x for x in statements.rule_of_40(h).collect()}
    assert r[m(2023, 12)].rule_of_40 is None                   # 12th row: no row 12 positions back
    x = r[m(2024, 3)]                                          # 13th row compares with row 1 (2023-01)
    yoy = round((22 * 10 - 10 * 10) / (10 * 10) * 100, 2)
    assert x.yoy_growth_percent == yoy
    assert x.rule_of_40 == round(yoy + 50.0, 2)
    d = {x.forecast_month: x.dol for x in statements.dol(h).collect()}
    assert d[m(2023, 1)] == 1.0                                 # no fixed costs: gp / np = 1


def test_runway_messages_bands_and_net_burn(spark):
    inputs = spark.createDataFrame(
        [(1, 225.0, 100.0, 0.0, 0.0, 0.0),     # 2.25 months -> "2.2 months" (Python %.1f), Red
         (2, 300.0, 100.0, 0.0, 0.0, 150.0),   # exactly 3 -> Yellow; net burn <= 0
         (3, 600.0, 100.0, 0.0, 0.0, 50.0),    # exactly 6 -> Green
         (4, 50.0, 0.0, 10.0, 0.0, 0.0)],      # no expenses
        "company_id int, starting_cash double, burn_rate double, expected_cash double, capex double, "
        "latest_month_revenue double")
    r = {x.company_id: x for x in runway.runway(inputs).collect()}
    assert (r[1].status_message, r[1].status_color) == ("2.2 months", "Red")
    assert (r[2].status_message, r[2].status_color) == ("3.0 months", "Yellow")
    assert r[3].status_color == "Green"
    assert r[4].estimated_months_left is None and r[4].status_message == runway.INFINITE_MESSAGE
    assert r[4].status_color == "Green"
    nb = {x.company_id: x for x in runway.net_burn_runway(inputs).collect()}
    assert nb[2].net_burn == -50.0 and nb[2].runway_net_burn_months is None
    assert nb[3].runway_net_burn_months == 600.0 / 50.0


def test_latest_cash_breaks_same_day_ties_by_id(spark):
    cb = spark.createDataFrame([(1, 7, dt.date(2024, 5, 1), D("10")), (2, 7, dt.date(2024, 5, 1), D("20")),
                                (3, 7, dt.date(2024, 4, 1), D("99"))],
                               "id long, company_id int, balance_date date, total_cash decimal(19,4)")
    row = runway.latest_cash(cb).first()
    assert float(row.total_cash) == 20.0                   # S9: id desc among same-day balances


def test_capex_month_without_forecast_is_dropped(spark):
    h = spark.createDataFrame([(1, m(2024, 1), 100.0)], "company_id int, forecast_month date, net_profit double")
    ooe = spark.createDataFrame([(1, None, "x", D("5"), dt.date(2024, 1, 9)), (1, None, "y", D("7"), dt.date(2024, 2, 3))],
                                "company_id int, project_id long, name string, amount decimal(19,4), expense_date date")
    rows = statements.cashflow_proxy(h, ooe).collect()
    assert len(rows) == 1 and rows[0].capex == 5.0 and rows[0].net_cash_flow_proxy == 95.0     # S6


def test_kpis_treat_stored_zeros_as_absent(spark):
    schema = ("company_id int, month_date date, mau int, cac double, churn_rate double, ltv double, "
              "revenue_per_employee double, mrr double, expansion_mrr double, contraction_mrr double, "
              "churned_mrr double, starting_mrr double, new_customers int, sm_spend double, "
              "customers_start_of_month int, customers_lost int")
    rows = [(1, m(2024, 1), 5, 0.0, 0.0, 3000.0, 0.0, 1000.0, 100.0, 50.0, 25.0, 800.0, 0, 500.0, 0, None),
            (2, m(2024, 1), 5, 400.0, 0.0, 3000.0, 0.0, 1000.0, None, None, None, None, 4, 1000.0, 10, 1)]
    mo = spark.createDataFrame(rows, schema)
    gm = spark.createDataFrame([(1, m(2024, 1), 40.0), (2, m(2024, 1), 50.0)],
                               "company_id int, month_date date, gross_margin_percent double")
    k = {r.company_id: r for r in kpis.saas_kpis(mo, gm).collect()}
    assert k[1].nrr_percent == round((800 + 100 - 25 - 50) / 800 * 100, 2)
    assert k[1].cac_from_inputs is None and k[1].ltv_cac_ratio is None     # new_customers 0 and cac 0 (S7)
    assert k[1].monthly_churn_percent is None                              # customers_start 0
    assert k[2].cac_from_inputs == 250.0 and k[2].ltv_cac_ratio == 12.0
    assert k[2].cac_payback_months == round(250.0 / (1000.0 * 0.5), 2)     # S8: total MRR x margin
    assert k[2].monthly_churn_percent == 10.0 and k[2].nrr_percent is None
    assert k[2].arr == 12000.0


def test_equal_split_generator(spark):
    req = spark.createDataFrame([(1, D("100.00"), dt.date(2024, 1, 31), 3, 30), (2, D("100.00"), dt.date(2024, 1, 1), 1, 0),
                                 (3, D("100.00"), dt.date(2024, 1, 1), 0, 10), (4, D("100.00"), dt.date(2024, 1, 1), -2, 5),
                                 (5, D("100.00"), dt.date(2024, 1, 1), None, None)],
                                "budget_item_id long, total_amount decimal(19,4), start_date date, splits int, days int")
    payload = projects.equal_split_payload(req)
    parent, child = projects.split_parent_child(payload)
    by = {}
    for r in child.collect():
        by.setdefault(r.budget_item_id, []).append(r)
    assert [x.payment_amount for x in by[1]] == [33.33] * 3
    assert [x.expected_payment_date for x in sorted(by[1], key=lambda r: r.installment_no)] == [
        dt.date(2024, 1, 31), dt.date(2024, 3, 1), dt.date(2024, 3, 31)]
    assert abs(by[1][0].residual - 0.01) < 1e-9                           # S16: the lost cent
    assert [x.payment_amount for x in by[2]] == [100.0]
    assert [x.payment_amount for x in by[3]] == [100.0]                    # 0 -> 1 split
    assert 4 not in by                                                     # negative -> none (V14)
    assert [x.payment_amount for x in by[5]] == [100.0]                    # blank -> 1
    assert parent.count() == 5


def test_move_payments(spark):
    inst = spark.createDataFrame([(1, D("10"), dt.date(2024, 3, 15)), (1, D("20"), dt.date(2024, 4, 2)),
                                  (2, D("30"), dt.date(2024, 3, 9))],
                                 "budget_item_id long, payment_amount decimal(19,4), expected_payment_date date")
    moves = spark.createDataFrame([(1, "2024-03", "2024-01"), (2, "2024-05", "2024-06"), (2, "2024-03", "2024-03")],
                                  "budget_item_id long, old_month string, new_month string")
    out = sorted((r.budget_item_id, r.payment_amount, r.expected_payment_date, r.moved)
                 for r in projects.move_payments(inst, moves).collect())
    assert out == [(1, 10.0, dt.date(2024, 1, 1), True), (1, 20.0, dt.date(2024, 4, 2), False),
                   (2, 30.0, dt.date(2024, 3, 1), True)]


def test_profile_merge_last_write_wins_and_replace(spark):
    p = spark.createDataFrame([(1, 1, "a", 1.0), (1, 2, "b", 2.0), (1, 3, "a", None), (2, 4, "a", 5.0)],
                              "company_id int, seq long, key string, value double")
    merged = {(r.company_id, r.key): (r.value, r.profile_version) for r in onboarding.profile_merge(p).collect()}
    assert merged == {(1, "a"): (None, 3), (1, "b"): (2.0, 3), (2, "a"): (5.0, 1)}
    rep = {(r.company_id, r.key) for r in onboarding.profile_replace(p).collect()}
    assert rep == {(1, "a"), (2, "a")}


def test_scripted_reply_hands_off_after_the_script(spark):
    msgs = spark.createDataFrame(
        [(1000 + i, 1, i, "user" if i % 2 == 0 else "assistant", "x") for i in range(14)],
        "id long, session_id long, turn long, role string, content string")
    out = sorted(onboarding.scripted_replies(msgs, onboarding.script_table(spark)).collect(), key=lambda r: r.message_id)
    assert [r.user_turn for r in out] == [1, 2, 3, 4, 5, 6, 7]
    assert out[0].reply.startswith("How do you make revenue")
    assert out[4].reply == onboarding.ONBOARDING_HANDOFF and out[6].reply == onboarding.ONBOARDING_HANDOFF


def test_gate_without_any_session(spark):
    companies = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    sessions = spark.createDataFrame([(10, 1, "completed", True)], "id long, company_id int, status string, is_completed boolean")
    g = {r.company_id: (r.show_onboarding, r.reason) for r in onboarding.onboarding_gate(companies, sessions).collect()}
    assert g == {1: (False, "onboarding_already_completed"), 2: (True, "no_completed_session")}


def test_upsert_rules_and_idempotence(spark):
    base = spark.createDataFrame([(1, "k1", D("10"), 7, "T1"), (1, "k2", D("20"), None, None)],
                                 "company_id int, idempotency_key string, amount decimal(19,4), lead_id long, tenant string")
    delta = spark.createDataFrame([(1, "k1", D("11"), None, None, 1), (1, "k1", D("12"), None, "T9", 2),
                                   (1, "k3", D("30"), 5, "T3", 1)],
                                  "company_id int, idempotency_key string, amount decimal(19,4), lead_id long, "
                                  "tenant string, seq int")
    once = up.upsert(base, delta, ["company_id", "idempotency_key"], replace=["amount"], keep_if_null=["tenant"],
                     delta_seq="seq")
    got = {r.idempotency_key: (float(r.amount), r.lead_id, r.tenant) for r in once.collect()}
    assert got == {"k1": (12.0, 7, "T9"), "k2": (20.0, None, None), "k3": (30.0, 5, "T3")}   # lead kept (S13)
    twice = up.upsert(once, delta, ["company_id", "idempotency_key"], replace=["amount"], keep_if_null=["tenant"],
                      delta_seq="seq")
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_cascade_and_set_null(spark):
    leads = spark.createDataFrame([(1,), (2,)], "id long")
    alive = up.delete_by_keys(leads, spark.createDataFrame([(2,)], "id long"), ["id"])
    links = spark.createDataFrame([(10, 1), (11, 2)], "id long, lead_id long")
    lines = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "k string, lead_id long")
    assert [r.id for r in up.cascade(links, alive, "lead_id").collect()] == [10]
    assert sorted((r.k, r.lead_id) for r in up.set_null(lines, alive, "lead_id").collect()) == [
        ("a", 1), ("b", None), ("c", None)]


def test_assign_ids_dense_and_ordered(spark):
    rows = spark.range(0, 500).select((F.col("id") * 7 % 500).alias("k"))
    out = up.assign_ids(rows, ["k"], 100).collect()
    assert sorted(r.id for r in out) == list(range(101, 601))
    assert all(r.id == 101 + r.k for r in out)


def test_two_currencies_stay_separate(spark):
    from cashcurve.operators import actuals
    lines = spark.createDataFrame([(1, dt.date(2024, 1, 5), "cash", "GBP", D("10")),
                                   (1, dt.date(2024, 1, 9), "cash", "EUR", D("5")),
                                   (1, dt.date(2024, 1, 9), "accrual", "EUR", D("7"))],
                                  "company_id int, posted_date date, basis string, currency string, amount decimal(19,4)")
    s = actuals.actuals_summary(lines)
    assert s.count() == 3                                                       # S11
    snap = {r.currency: (r.accrual_total, r.cash_total) for r in actuals.actuals_snapshot(lines, "2024-01-20").collect()}
    assert snap == {"GBP": (None, 10.0), "EUR": (7.0, 5.0)}                     # S22: currency is a key
    assert actuals.recent_actuals(s, 1).count() == 2                            # S12: 2 x months rows


def test_json_sink_round_trips(spark):
    import json
    from cashcurve.operators.sinks import to_json_rows
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1), D("12.5000"), None)],
                               "company_id int, forecast_month date, revenue decimal(19,4), be double")
    doc = json.loads(to_json_rows(df, ["company_id"]).first().json)
    assert doc == {"company_id": 1, "forecast_month": "2024-01-01", "revenue": 12.5, "be": None}


def test_kpis_without_mrr_or_metrics_row(spark):
    schema = ("company_id int, month_date date, mau int, cac double, churn_rate double, ltv double, "
              "revenue_per_employee double, mrr double, expansion_mrr double, contraction_mrr double, "
              "churned_mrr double, starting_mrr double, new_customers int, sm_spend double, "
              "customers_start_of_month int, customers_lost int")
    mo = spark.createDataFrame([(1, m(2024, 1), 0, 300.0, 0.0, None, 0.0, None, None, None, None, None, None, None,
                                 None, None)], schema)
    gm = spark.createDataFrame([(1, m(2024, 1), 40.0)], "company_id int, month_date date, gross_margin_percent double")
    k = kpis.saas_kpis(mo, gm).first()
    assert k.mrr is None and k.arr is None and k.cac_payback_months is None     # mrr NULL
    assert k.cac_from_inputs is None and k.ltv_cac_ratio is None                # ltv NULL, cac stored 300
    assert k.cac_stored == 300.0 and k.nrr_percent is None
    # a company with no metrics row at all has no KPI row (the endpoint answers with empty metrics)
    assert kpis.latest_metrics(spark.createDataFrame([], schema)).count() == 0
