"""One method per endpoint of the reference app, for users switching over call by call.

Each method is the all-tenant operator with a tenant (or project / session)
filter on top (B1).  Catalyst pushes the filter below the joins and the
window into the scans, so asking for one company does not compute all of them.
Results are DataFrames; ``.collect()`` or ``operators.sinks.to_json_rows`` give
the API payload.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashcurve.functions.exprs import clamp, first_of_month
from cashcurve.operators import actuals as ac
from cashcurve.operators import forecast as fc
from cashcurve.operators import kpis
from cashcurve.operators import onboarding as ob
from cashcurve.operators import projects as pj
from cashcurve.operators import runway as rw
from cashcurve.operators import statements as st
from cashcurve.operators.inserts import with_defaults
from cashcurve.operators.upsert import annotate_lead_patches
from cashcurve.plans.actuals_queries import lines_of
from cashcurve.plans.forecast_queries import details_of, health_exact_of, health_of
from cashcurve.plans.kpi_queries import metrics_of
from cashcurve.plans.runway_queries import inputs_of
from cashcurve.sources.model import ModelTables
from cashcurve.sources.schemas import OwnTables


class FinanceApi:
    """Endpoint-shaped access to the operators.

    ``FinanceApi(spark, dir)`` derives the finance tables from the landed ones in ``dir``;
    ``FinanceApi.over(OwnTables(spark, root))`` reads a user's own finance tables (``sources.schemas``), and over
    ``StoredTables(spark, root)`` (``sources.stored``) it stores requests beside them as well.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.m = ModelTables(spark, sf_dir)

    @classmethod
    def over(cls, tables: OwnTables) -> FinanceApi:
        api = cls.__new__(cls)
        api.m = tables
        return api

    @staticmethod
    def _of(df: DataFrame, company_id: int, col: str = "company_id") -> DataFrame:
        return df.filter(F.col(col) == company_id)

    # -- dashboard and analytics --------------------------------------------------------------
    def dashboard(self, company_id: int) -> DataFrame:
        """GET /api/dashboard/{company_id}: view_financial_health rows by month."""
        return self._of(health_of(self.m), company_id).orderBy("forecast_month")

    def dashboard_details(self, company_id: int, month: str) -> DataFrame:
        """GET /api/dashboard/{company_id}/details/{month}."""
        return self._of(fc.month_drilldown(self.m.forecast_entries, self.m.products, month), company_id)

    def top_products(self, company_id: int, limit: int = 5) -> DataFrame:
        """GET /api/analytics/top-products/{company_id} (and the ask tool with its clamp)."""
        return self._of(fc.top_products(self.m.forecast_entries, self.m.products, clamp(limit, 1, 10, 5)),
                        company_id).orderBy("rank")

    def financial_overview(self, company_id: int, months: int = 3) -> DataFrame:
        """Ask tool get_financial_overview: the last n forecast months (n clamped 1..12)."""
        return self._of(fc.recent_months(health_of(self.m), months), company_id).orderBy("recency")

    # -- runway and statements ----------------------------------------------------------------
    def runway(self, company_id: int) -> DataFrame:
        """GET /api/runway/{company_id}."""
        return self._of(rw.runway(inputs_of(self.m)), company_id)

    def net_burn(self, company_id: int) -> DataFrame:
        """Net-burn half of the runway payload."""
        return self._of(rw.net_burn_runway(inputs_of(self.m)), company_id)

    def pl(self, company_id: int) -> DataFrame:
        """GET /api/financial-model/pl/{company_id}: the 8 lines x months (long form)."""
        return self._of(st.pl_matrix_long(health_of(self.m)), company_id).orderBy("line_order", "forecast_month")

    def pl_by_product_month(self, company_id: int) -> DataFrame:
        """by_product_month part of the P&L payload."""
        return self._of(fc.unit_margin(details_of(self.m)), company_id).orderBy("forecast_month", "product_name")

    def cashflow(self, company_id: int) -> DataFrame:
        """GET /api/financial-model/cashflow/{company_id}."""
        return self._of(st.cashflow_proxy(health_of(self.m), self.m.one_off_expenses), company_id) \
            .orderBy("forecast_month")

    def balance_sheet(self, company_id: int) -> DataFrame:
        """GET /api/financial-model/balance-sheet/{company_id}."""
        return self._of(st.balance_sheet(self.m.companies, self.m.cash_balances), company_id).orderBy("line_order")

    def kpis(self, company_id: int) -> DataFrame:
        """GET /api/financial-model/kpis/{company_id}."""
        return self._of(kpis.saas_kpis_latest(metrics_of(self.m), health_exact_of(self.m)), company_id)

    def latest_metrics(self, company_id: int) -> DataFrame:
        """GET /api/metrics/{company_id} (and the ask tool get_metrics)."""
        return self._of(kpis.latest_metrics(metrics_of(self.m)), company_id)

    # -- lists --------------------------------------------------------------------------------
    def leads(self, company_id: int) -> DataFrame:
        """GET /api/leads/{company_id}."""
        return rw.lead_list(self._of(self.m.leads, company_id))

    def cash_balances(self, company_id: int) -> DataFrame:
        """GET /api/cash_balances/{company_id}."""
        return rw.cash_history(self._of(self.m.cash_balances, company_id))

    def one_off_expenses(self, company_id: int) -> DataFrame:
        """GET /api/one_off_expenses/{company_id}."""
        return rw.one_off_history(self._of(self.m.one_off_expenses, company_id))

    def projects(self, company_id: int) -> DataFrame:
        """GET /api/projects/list/{company_id}."""
        return rw.project_list(self._of(self.m.projects, company_id))

    def products(self, company_id: int) -> DataFrame:
        """GET /api/products?company_id=..."""
        return self._of(self.m.products, company_id)

    # -- projects -------------------------------------------------------------------------------
    def project_financials(self, project_id: int) -> DataFrame:
        """GET /api/projects/{project_id}/financials."""
        return self._of(pj.project_variance(self.m.projects, self.m.project_budgets, self.m.one_off_expenses),
                        project_id, "project_id")

    def project_cashflow(self, project_id: int) -> DataFrame:
        """GET /api/projects/{project_id}/cashflow (flat: one row per installment)."""
        return pj.project_cashflow(self._of(self.m.project_budgets, project_id, "project_id"), self.m.installments)

    def project_cashflow_nested(self, project_id: int) -> DataFrame:
        """The same endpoint in the reference's response shape: items by start date, each with its
        installments as a date-ordered list ([] when none)."""
        b = self._of(self.m.project_budgets, project_id, "project_id")
        return pj.project_cashflow_nested(b, self.m.installments).orderBy("start_date", "budget_item_id")

    # -- accounting actuals ------------------------------------------------------------------------
    def actuals_summary(self, company_id: int) -> DataFrame:
        """GET /api/actuals/summary/{company_id}."""
        return ac.actuals_summary(self._of(lines_of(self.m), company_id)) \
            .orderBy(F.col("month").desc(), "basis", "currency")

    def actuals_lines(self, company_id: int, basis: str | None = None, limit: int = 200) -> DataFrame:
        """GET /api/actuals/lines/{company_id}?basis&limit."""
        return ac.actuals_lines(self._of(lines_of(self.m), company_id), self.m.leads, basis, limit) \
            .orderBy("position")

    def lead_links(self, company_id: int) -> DataFrame:
        """GET /api/integrations/lead-links/{company_id}."""
        return ac.lead_links_list(self._of(self.m.lead_links, company_id), self.m.leads)

    # -- requests (over ``sources.stored.StoredTables``) ------------------------------------------------
    def add(self, table: str, requests: DataFrame, order: list[str], request: int | None = None) -> DataFrame:
        """POST /api/products, expenses, leads, cash_balances, one_off_expenses, projects: the rows as stored."""
        return self.m.insert(table, requests, order, request)

    def add_budget(self, requests: DataFrame, order: list[str], request: int | None = None) -> tuple[DataFrame, DataFrame]:
        """POST /api/projects/{project_id}/budget: items and installments as stored."""
        return self.m.insert_budgets(requests, order, request)

    def save_forecast(self, entries: DataFrame, request: int | None = None) -> int:
        """POST /api/forecast: sets the units of (company, product, month), overrides stay; any day of a month names it (M5)."""
        monthly = entries.withColumn("forecast_month", first_of_month("forecast_month"))
        named = monthly.withColumn("id", F.concat_ws("-", "company_id", "product_id", F.date_format("forecast_month", "yyyy-MM")))
        return self.m.upsert("forecast_entries", named, ["company_id", "product_id", "forecast_month"], ["units_forecasted"], request=request)

    def save_metrics(self, metrics: DataFrame, request: int | None = None) -> int:
        """POST /api/metrics: replaces all values of (company, month)."""
        key = ["company_id", "month_date"]
        full = with_defaults(metrics.withColumn("month_date", first_of_month("month_date")), "monthly_metrics").withColumn("updated_at", F.current_timestamp())
        return self.m.upsert("monthly_metrics", full, key, [c for c in full.columns if c not in key], request=request)

    def link_leads(self, links: DataFrame, request: int | None = None) -> DataFrame:
        """POST /api/integrations/lead-links: links whose lead is the company's; returns the requests with ``accepted``."""
        clean = links.withColumn("provider", F.lower(F.trim("provider")))
        checked = annotate_lead_patches(clean, self.m.leads).withColumn(
            "accepted", F.col("accepted") & F.col("lead_id").isNotNull() & F.col("provider").isin("xero", "quickbooks"))
        self.m.upsert("lead_links", checked.filter("accepted").drop("accepted"), ["company_id", "provider", "external_contact_id"], ["lead_id"], request=request)
        return checked

    def patch_lines(self, patches: DataFrame, request: int | None = None) -> DataFrame:
        """PATCH /api/actuals/lines: set or clear leads; returns the requests with ``accepted``."""
        return self.m.patch_leads(patches, request)

    def delete(self, table: str, ids: DataFrame, request: int | None = None) -> int:
        """DELETE of forecast entries, leads, budget items, links (or any table): by id, with the foreign keys' actions."""
        return self.m.delete(table, ids, request)

    def complete_sessions(self, requests: DataFrame, now: str, request: int | None = None) -> int:
        """POST /api/onboarding/sessions/{id}/complete: once, with the stored time."""
        return self.m.complete_sessions(requests, now, request)

    def connections(self, company_id: int) -> DataFrame:
        """GET /api/integrations/status/{company_id}: which services are connected."""
        return ob.integration_flags(self._of(self.m.connections, company_id))

    # -- onboarding -------------------------------------------------------------------------------
    def onboarding_gate(self, company_id: int) -> DataFrame:
        """GET /api/onboarding/gate?company_id=..."""
        return ob.onboarding_gate(self._of(self.m.companies, company_id, "id"), self.m.onboarding_sessions)

    def open_session(self, company_id: int) -> DataFrame:
        """GET /api/onboarding/open-session?company_id=..."""
        return ob.open_session(self._of(self.m.companies, company_id, "id"), self.m.onboarding_sessions)

    def profile(self, company_id: int) -> DataFrame:
        """GET /api/onboarding/profiles?company_id=... (K9)."""
        return self._of(ob.profile_document(ob.profile_merge(self.m.profile_patches)), company_id)
