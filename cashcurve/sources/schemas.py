"""The finance tables as a user has them: columns, types and defaults.

``SCHEMAS`` is for reading own tables (``read_table``); ``DEFAULTS`` gives the values an insert request may leave out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_I, _L, _S, _D, _B, _TS = T.IntegerType(), T.LongType(), T.StringType(), T.DateType(), T.BooleanType(), T.TimestampType()
_M, _R = T.DecimalType(19, 4), T.DecimalType(19, 6)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


SCHEMAS: dict[str, T.StructType] = {
    "companies": _table(id=_L, name=_S),
    "products": _table(id=_L, company_id=_I, name=_S, sku=_S, default_sales_price=_M, default_cogs=_M, is_active=_B),
    "fixed_expenses": _table(id=_L, company_id=_I, name=_S, amount=_M, frequency=_S, payment_day=_I),
    "forecast_entries": _table(id=_S, company_id=_I, product_id=_L, forecast_month=_D, units_forecasted=_I, price_override=_M,
                               cogs_override=_M),
    "leads": _table(id=_L, company_id=_I, client_name=_S, contract_value=_M, probability=_I, expected_close_date=_D),
    "cash_balances": _table(id=_L, company_id=_I, balance_date=_D, total_cash=_M),
    "one_off_expenses": _table(id=_L, company_id=_I, project_id=_L, name=_S, amount=_M, expense_date=_D),
    "projects": _table(id=_L, company_id=_I, project_name=_S, status=_S),
    "project_budgets": _table(id=_L, project_id=_L, item_name=_S, supplier=_S, grouping_category=_S, total_amount=_M, start_date=_D),
    "installments": _table(budget_item_id=_L, payment_amount=_M, expected_payment_date=_D),
    "lead_links": _table(id=_L, company_id=_I, lead_id=_L, provider=_S, external_contact_id=_S),
    "connections": _table(id=_L, company_id=_I, service_name=_S, tenant_id=_S, realm_id=_S),
    "accounting_actual_lines": _table(company_id=_I, connection_id=_L, provider=_S, basis=_S, line_kind=_S, external_invoice_id=_S,
                                      external_payment_id=_S, external_contact_id=_S, contact_name=_S, amount=_M, currency=_S,
                                      posted_date=_D, idempotency_key=_S, lead_id=_L, synced_at=_TS),
    "monthly_metrics": _table(company_id=_I, month_date=_D, mau=_I, cac=_M, churn_rate=_R, ltv=_M, revenue_per_employee=_M, mrr=_M,
                              expansion_mrr=_M, contraction_mrr=_M, churned_mrr=_M, starting_mrr=_M, new_customers=_I, sm_spend=_M,
                              customers_start_of_month=_I, customers_lost=_I, updated_at=_TS),
    "onboarding_sessions": _table(id=_L, company_id=_I, status=_S, is_completed=_B, current_step_key=_S, integration_snapshot=_S, created_at=_TS,
                                  updated_at=_TS, completed_at=_TS),
    "onboarding_messages": _table(id=_L, session_id=_L, turn=_L, role=_S, content=_S),
    "profile_patches": _table(company_id=_I, seq=_L, key=_S, value=T.DoubleType()),
    "company_onboarding_profiles": _table(id=_L, company_id=_I, session_id=_L, profile_version=_I, data=_S, validated_at=_TS, created_at=_TS,
                                          updated_at=_TS),
    "onboarding_calibration_runs": _table(id=_L, company_id=_I, session_id=_L, profile_id=_L, status=_S, steps=_S, sync_xero_requested_at=_TS,
                                          sync_qbo_requested_at=_TS, error=_S, created_at=_TS, completed_at=_TS),
}

#: Values of columns that an insert leaves out (fixed by the tables' definition).
DEFAULTS: dict[str, dict[str, object]] = {
    "products": {"default_sales_price": 0, "default_cogs": 0, "is_active": True},
    "fixed_expenses": {"amount": 0, "frequency": "monthly", "payment_day": 1},
    "forecast_entries": {"units_forecasted": 0},
    "leads": {"contract_value": 0, "probability": 0},
    "monthly_metrics": {"mau": 0, "cac": 0, "churn_rate": 0, "ltv": 0, "revenue_per_employee": 0},
    "projects": {"status": "planned"},
    "onboarding_sessions": {"status": "in_progress", "is_completed": False, "integration_snapshot": "{}"},
    "company_onboarding_profiles": {"profile_version": 1, "data": "{}"},
    "onboarding_calibration_runs": {"status": "queued", "steps": "{}"},
}

#: Declared constraints besides the foreign keys: unique keys, columns that are never NULL, rules (SQL), dates on the 1st of a month.
CONSTRAINTS: dict[str, dict[str, list]] = {
    "companies": {"unique": [["id"]], "not_null": ["name"]},
    "products": {"unique": [["id"]], "not_null": ["company_id", "name"]},
    "fixed_expenses": {"unique": [["id"]], "not_null": ["company_id", "name"], "domain": ["frequency IN ('monthly', 'quarterly', 'annually')"]},
    "forecast_entries": {"unique": [["id"], ["company_id", "product_id", "forecast_month"]], "not_null": ["company_id", "product_id", "forecast_month"],
                         "domain": ["units_forecasted >= 0"], "month_grain": ["forecast_month"]},
    "leads": {"unique": [["id"]], "not_null": ["company_id", "client_name", "contract_value", "probability"], "domain": ["probability BETWEEN 0 AND 100"]},
    "lead_links": {"unique": [["company_id", "provider", "external_contact_id"]], "not_null": ["company_id", "lead_id", "provider", "external_contact_id"],
                   "domain": ["provider IN ('xero', 'quickbooks')"]},
    "connections": {"unique": [["company_id", "service_name"]], "not_null": ["company_id", "service_name"]},
    "accounting_actual_lines": {"unique": [["company_id", "idempotency_key"]],
                                "not_null": ["company_id", "provider", "basis", "line_kind", "amount", "currency", "posted_date", "idempotency_key"],
                                "domain": ["basis IN ('accrual', 'cash')"]},
    "monthly_metrics": {"unique": [["company_id", "month_date"]], "not_null": ["company_id", "month_date", "mau", "cac", "churn_rate", "ltv"],
                        "month_grain": ["month_date"]},
    "projects": {"unique": [["id"]]}, "project_budgets": {"unique": [["id"]]}, "installments": {"month_grain": ["expected_payment_date"]},
    "onboarding_sessions": {"unique": [["id"]], "not_null": ["company_id", "status"]},
    "onboarding_messages": {"not_null": ["session_id", "role", "content"], "domain": ["role IN ('user', 'assistant', 'system')"]},
    "company_onboarding_profiles": {"unique": [["company_id"]], "not_null": ["company_id", "profile_version", "data"]},
    "onboarding_calibration_runs": {"not_null": ["company_id", "status", "steps"]},
}

#: child table -> (foreign key column, parent table, "cascade" or "set null")
FOREIGN_KEYS: dict[str, list[tuple[str, str, str]]] = {
    "products": [("company_id", "companies", "cascade")],
    "fixed_expenses": [("company_id", "companies", "cascade")],
    "leads": [("company_id", "companies", "cascade")],
    "connections": [("company_id", "companies", "cascade")],
    "cash_balances": [("company_id", "companies", "cascade")],
    "one_off_expenses": [("company_id", "companies", "cascade")],
    "projects": [("company_id", "companies", "cascade")],
    "monthly_metrics": [("company_id", "companies", "cascade")],
    "onboarding_sessions": [("company_id", "companies", "cascade")],
    "forecast_entries": [("company_id", "companies", "cascade"), ("product_id", "products", "cascade")],
    "project_budgets": [("project_id", "projects", "cascade")],
    "installments": [("budget_item_id", "project_budgets", "cascade")],
    "lead_links": [("company_id", "companies", "cascade"), ("lead_id", "leads", "cascade")],
    "accounting_actual_lines": [("company_id", "companies", "cascade"), ("connection_id", "connections", "set null"),
                                ("lead_id", "leads", "set null")],
    "onboarding_messages": [("session_id", "onboarding_sessions", "cascade")],
    "company_onboarding_profiles": [("company_id", "companies", "cascade"), ("session_id", "onboarding_sessions", "set null")],
    "onboarding_calibration_runs": [("company_id", "companies", "cascade"), ("session_id", "onboarding_sessions", "set null"),
                                    ("profile_id", "company_onboarding_profiles", "set null")],
}


def read_own_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of the finance tables from a user's own parquet files, with its declared schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


class OwnTables:
    """The finance tables under ``root`` (``<root>/<table>.parquet``), for ``FinanceApi`` and the operators.

    Has the attributes of ``ModelTables``, so everything that takes model tables takes a user's own ones.
    """

    stored = False

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        return read_own_table(self.spark, f"{self.root}/{name}.parquet", name)
