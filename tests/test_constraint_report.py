"""The report covers every declared constraint of every table, also of those that are derived from the ledger and the onboarding requests."""

from cashcurve.operators.constraints import declared
from cashcurve.plans import quality_queries as q
from cashcurve.sources.model import ModelTables
from tests.conftest import SF_SMALL


def test_no_declared_constraint_is_left_out(spark):
    got = {(r.table_name, r.kind, r.constraint_name): (r.checked, r.violations) for r in q.q_constraint_report(spark, SF_SMALL).collect()}
    assert set(got) == {rule[:3] for rule in declared()}
    lines = got["accounting_actual_lines", "unique", "company_id, idempotency_key"]
    assert lines[0] > 0 and lines[1] == 0 and got["accounting_actual_lines", "foreign_key", "lead_id -> leads"][0] > 0
    assert got["onboarding_calibration_runs", "foreign_key", "profile_id -> company_onboarding_profiles"][0] > 0
    assert all(got[t, "foreign_key", "company_id -> companies"][0] > 0 for t in ("cash_balances", "one_off_expenses", "monthly_metrics", "company_onboarding_profiles"))


def test_profiles_hold_what_the_patches_set(spark):
    class Tables(ModelTables):
        profile_patches = spark.createDataFrame([(1, 1, "a", 1.0), (1, 2, "a", None), (1, 3, "b", 2.0), (2, 1, None, 1.0), (None, 1, "a", 1.0)],
                                                "company_id int, seq long, key string, value double")
        onboarding_sessions = spark.createDataFrame([(5, 1), (7, 1), (8, 3), (9, None)], "id long, company_id int")
    got = {r.company_id: (r.id, r.session_id, r.profile_version, r.data) for r in q.profiles_of(Tables(spark, SF_SMALL)).collect()}
    assert got == {1: (2, 7, 3, '{"a":null,"b":2.0}'), 2: (3, None, 1, "{}")}
