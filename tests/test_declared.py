"""Compiled constraints, mergeable distinct sets, nested profiles."""

import datetime as dt
import random

from pyspark.sql import functions as F

from cashcurve.operators import distinct_sets as ds
from cashcurve.operators import onboarding as ob
from cashcurve.operators.constraints import check_constraints, declared
from cashcurve.sources.schemas import SCHEMAS


def test_constraints_find_what_is_broken(spark):
    rows = {
        "companies": [(1, "one"), (1, "again"), (2, None)],
        "leads": [(7, 1, "acme", None, 50, None), (8, 3, "x", 1, 101, None), (9, None, "y", 1, None, None)],
        "lead_links": [(1, 1, 7, "xero", "C"), (2, 1, 99, "xero", "C"), (3, 1, 99, "sage", None)],
        "installments": [(1, 1, dt.date(2025, 1, 1)), (1, 1, dt.date(2025, 1, 2)), (1, 1, None)],
    }
    tables = {t: spark.createDataFrame(
        [tuple(F_cast(v, f.dataType) for v, f in zip(r, SCHEMAS[t].fields, strict=True)) for r in data], SCHEMAS[t]) for t, data in rows.items()}
    got = {(r.table_name, r.kind, r.constraint_name): (r.checked, r.violations) for r in check_constraints(tables.get).collect()}
    assert got["companies", "unique", "id"] == (3, 1) and got["companies", "not_null", "name"] == (3, 1)
    assert got["leads", "foreign_key", "company_id -> companies"] == (2, 1) and got["leads", "unique", "id"] == (3, 0)
    assert got["leads", "not_null", "contract_value"] == (3, 1) and got["leads", "domain", "probability BETWEEN 0 AND 100"] == (3, 2)
    assert got["lead_links", "foreign_key", "lead_id -> leads"] == (3, 2)
    assert got["lead_links", "unique", "company_id, provider, external_contact_id"] == (2, 1)
    assert got["installments", "month_grain", "expected_payment_date"] == (3, 1)
    assert not any(t == "products" or "project_budgets" in n for t, _, n in got)         # tables that are not there
    empty = {t: df.limit(0) for t, df in tables.items()}
    assert {(r.checked, r.violations) for r in check_constraints(empty.get).collect()} == {(0, 0)}


def F_cast(v, kind):
    import decimal
    return decimal.Decimal(v) if v is not None and kind.typeName() == "decimal" else v


def test_every_constraint_is_read_from_one_scan_per_table(spark, tmp_path):
    for t, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{t}.parquet")
    df = check_constraints(lambda t: spark.read.schema(SCHEMAS[t]).parquet(f"{tmp_path}/{t}.parquet"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    used = {r[0] for r in declared()} | {r[3][1] for r in declared() if r[1] == "foreign_key"}
    assert plan.count("Relation ") == len(used) and plan.count("Aggregate [c") == 2


def test_ranges_equal_sets(spark):
    rng = random.Random(3)
    months = [dt.date(2024, m, 1) for m in range(1, 9)]
    rows = [(rng.randrange(2), rng.choice([3, 70_000]) + rng.randrange(40), rng.choice(months), rng.choice(["view", "purchase", "click"])) for _ in range(900)]
    df = spark.createDataFrame([*rows, (None, 1, months[0], "view"), (0, None, months[0], "view")], "c int, e long, m date, k string")
    bits = ds.monthly_bitmaps(df, F.col("c"), F.col("e"), F.col("m"), F.col("k"))
    lo, hi = "2024-03-01", "2024-06-01"
    inside = [r for r in rows if months[2] <= r[2] <= months[5]]
    got = {r.company_id: (r.visitors, r.converted) for r in ds.conversion_range(bits, lo, hi).collect()}
    for c in (0, 1):
        seen, bought = ({e for x, e, _, k in inside if x == c and k == kind} for kind in ("view", "purchase"))
        assert got[c] == (len(seen), len(seen & bought))
    kept = {(r.company_id, r.cohort, r.age): (r.cohort_size, r.active) for r in ds.retention_range(bits, lo, hi).collect()}
    want = {}
    for c in (0, 1):
        by = {}
        for x, e, m, _ in inside:
            if x == c:
                by.setdefault(e, set()).add(m)
        for ms in by.values():
            for m in ms:
                key = (c, min(ms), m.month - min(ms).month)
                want[key] = want.get(key, 0) + 1
    assert {k: v[1] for k, v in kept.items()} == want and all(v[0] == want[c, m, 0] for (c, m, _), v in kept.items())
    assert ds.retention_range(bits, "2030-01-01", "2030-05-01").count() == 0


def test_nested_profiles_merge_by_top_level_key(spark):
    patches = spark.createDataFrame([
        (1, 1, '{"goals":{"cash":{"target":5,"when":"2025"}},"tone":"dry","people":[{"n":1}]}'), (1, 2, '{"goals":{"hire":2},"tone":null}'), (1, 3, "[1]"), (1, 4, "{"),
        (2, 1, '{"a":{"b":{"c":{"d":{"e":1}}}},"f":{},"g":true,"h":1.50}'), (3, 1, None), (3, 2, "{}")], "company_id int, seq long, doc string")
    got = {(r.company_id, r.path): (r.value, r.type) for r in ob.profile_lookup(ob.profile_documents(patches)).collect()}
    assert got == {(1, "goals.hire"): ("2", "number"), (1, "tone"): ("null", "null"), (1, "people"): ('[{"n":1}]', "array"),
                   (2, "a.b.c.d"): ('{"e":1}', "object"), (2, "f"): ("{}", "object"), (2, "g"): ("true", "boolean"), (2, "h"): ("1.5", "number")}


def test_bucketed_items_meet_their_installments_without_an_exchange(spark):
    from cashcurve.operators import projects as pj
    from cashcurve.sources.bucketed import bucketed
    budgets = spark.range(500).selectExpr("id", "id % 7 AS project_id", "date'2025-01-15' AS start_date")
    parts = spark.range(3000).selectExpr("id % 500 AS budget_item_id", "CAST(id % 13 AS DECIMAL(19,4)) AS payment_amount",
                                         "date_add(date'2025-01-01', CAST(id % 90 AS INT)) AS expected_payment_date")
    b, i = bucketed(budgets, "id", 4), bucketed(parts, "budget_item_id", 4)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        for make in (pj.timeline_matrix, lambda x, y: pj.move_payments(y, pj.move_requests(x, y))):
            near, far = make(b, i), make(budgets, parts)
            plan = near._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Bucketed: true" in plan
            assert sorted(map(tuple, near.collect())) == sorted(map(tuple, far.collect()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_a_list_of_tenants_prunes_the_clustered_store(spark):
    from cashcurve.plans.forecast_queries import q_tenant_list_forecast
    from tests.conftest import SF_SMALL
    df = q_tenant_list_forecast(spark, SF_SMALL)
    assert df.count() > 0
    assert "dynamicpruning" in df._jdf.queryExecution().executedPlan().toString().lower()


def test_lists_of_all_tenants_are_not_shuffled_for_their_order(spark):
    from cashcurve.plans.catalog import QUERIES
    from tests.conftest import SF_SMALL
    for key in ("lead_list", "cash_history", "one_off_history", "project_list", "lead_links", "transcript", "project_cashflow"):
        plan = QUERIES[key](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan, key


def test_one_hot_item_is_cut_into_numbered_lists(spark):
    from cashcurve.operators import projects as pj
    budgets = spark.createDataFrame([(1, 7, "hot", "g", 1, None), (2, 7, "none", "g", 1, None)],
                                    "id long, project_id long, item_name string, grouping_category string, total_amount long, start_date date")
    parts = spark.range(1234).selectExpr("1L AS budget_item_id", "date_add(date'2025-01-01', CAST(1234 - id AS INT)) AS expected_payment_date",
                                         "CAST(id AS DECIMAL(19,4)) AS payment_amount")
    got = {(r.budget_item_id, r.chunk): r.installments for r in pj.project_cashflow_chunks(budgets, parts, 500).collect()}
    assert {k: len(v) for k, v in got.items()} == {(1, 0): 500, (1, 1): 500, (1, 2): 234, (2, 0): 0}
    dates = [x.expected_payment_date for c in range(3) for x in got[1, c]]
    assert dates == sorted(dates)


def test_input_dates_become_the_first_of_their_month(spark):
    from cashcurve.functions.exprs import first_of_month, month_from_text
    df = spark.createDataFrame([(dt.date(2025, 2, 28), dt.datetime(2024, 12, 31, 23, 59), "2025-13"), (dt.date(2025, 3, 1), None, "2025-07"), (None, None, None)],
                               "d date, t timestamp, m string")
    got = [tuple(r) for r in df.select(first_of_month("d"), first_of_month("t"), month_from_text("m")).collect()]
    assert got == [(dt.date(2025, 2, 1), dt.date(2024, 12, 1), None), (dt.date(2025, 3, 1), None, dt.date(2025, 7, 1)), (None, None, None)]
