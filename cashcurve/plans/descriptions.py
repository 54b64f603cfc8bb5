"""

Used by ``python -m cashcurve list`` and by a test that every registered key is described.
"""

from __future__ import annotations

DESCRIPTIONS: dict[str, tuple[str, str]] = {
    "financial_health": ("A1 B1 B5 C1-C3 D1 D2 D4 E1 H1-H4 I1 I2", "view_financial_health per company x month"),
    "financial_health_v1": ("I3a", "earlier health view (no variable costs, pipeline, running total)"),
    "forecast_details": ("B5 C1", "override-or-default price/COGS, revenue, cost, gross profit per entry"),
    "break_even": ("I2", "break-even revenue and its inputs"),
    "monthly_summary": ("C8 D3 I3", "view_monthly_summary with all-frequency fixed costs"),
    "month_drilldown": ("B2", "entries of one month with product name and revenue"),
    "unit_margin": ("B6", "contribution margin per unit and ratio"),
    "trend_series": ("B11", "revenue vs break-even series"),
    "top_products": ("D8 F1 F2", "top-k product names by revenue per company"),
    "recent_months": ("F3", "last n forecast months per company"),
    "afloat_status": ("I4", "Afloat / Sinking per month"),
    "pipeline_coverage": ("D12 E4 I5", "shortfall vs weighted pipeline, coverage band"),
    "dashboard_json": ("A6", "dashboard rows as API JSON documents"),
    "runway": ("C12 D3-D5 E3 I6 I7", "pipeline-adjusted runway, message and colour"),
    "net_burn_runway": ("I8", "net burn and net-burn runway"),
    "liquidity": ("I23", "cash, burn, pipeline, CAPEX tile"),
    "weighted_leads": ("B7", "weighted value per lead"),
    "lead_list": ("B8", "leads by probability desc"),
    "cash_history": ("B9", "cash balances newest first"),
    "one_off_history": ("B9", "one-off expenses oldest first"),
    "project_list": ("B9", "projects id desc"),
    "dol": ("I10", "degree of operating leverage"),
    "rule_of_40": ("E2 I11", "YoY growth (12 rows back) + net margin"),
    "pl_matrix_long": ("I9", "8-line P&L x months, long form"),
    "pl_matrix": ("I9", "8-line P&L with month-ordered cell arrays"),
    "cashflow_proxy": ("C7 D6 I12", "operating proxy, CAPEX by month, net"),
    "balance_sheet": ("I13", "nine-line balance-sheet scaffold, cash filled"),
    "working_capital": ("X5", "working-capital ratios over the balance-sheet lines"),
    "mrr_movements": ("X6", "monthly metrics derived from orders"),
    "latest_metrics": ("E3 I20", "latest metrics row per company"),
    "metric_pairs": ("B10", "non-NULL metric name/value pairs of the latest row"),
    "saas_kpis": ("I14-I19", "MRR/ARR, NRR, CAC, LTV:CAC, payback, churn per company-month"),
    "saas_kpis_latest": ("I14-I19 I18", "the KPI endpoint: latest metrics x latest forecast margin"),
    "project_variance": ("D9 D10 I21 I22", "budget vs actuals, status, burn %"),
    "project_cashflow": ("C11", "budget items with installments (flat)"),
    "timeline_matrix": ("C13 D13 P3", "filled item x month cells"),
    "timeline_spine": ("D14 P2 P4", "contiguous month spine per project, padded"),
    "installment_schedule": ("A8 P1", "equal-split schedules as child rows"),
    "move_payments": ("P5", "move an item's payments to another month"),
    "ledger_lines": ("A2-A5 C6 G1 H5-H9 J5 L1-L6", "accepted ledger lines from landed JSON pages"),
    "ledger_rejects": ("L7", "rejected documents by reason"),
    "sync_counts": ("D15", "rows upserted per company, provider, basis"),
    "actuals_summary": ("D7", "actuals by month, basis, currency"),
    "actuals_lines": ("B3 C4", "newest lines with linked lead name"),
    "actuals_snapshot": ("B4", "accrual and cash totals of the as-of month"),
    "lead_links": ("C5", "contact links with client names"),
    "recent_actuals": ("F4", "2 x months summary rows per company"),
    "upsert_forecast": ("J1", "forecast units upsert, overrides kept"),
    "upsert_metrics": ("J2", "metrics upsert, all values replaced"),
    "upsert_connections": ("J3", "connection upsert keeping old tenant/realm"),
    "upsert_lead_links": ("C9 J4", "validated lead-link upsert"),
    "patch_lead": ("C9 J6", "lead patches with the company check"),
    "upsert_lines": ("J5 J6 S13", "re-sync keeps manual lead links"),
    "cascade_delete": ("J7 J8", "delete leads, cascade links, set-null lines"),
    "append_rows": ("A7", "append rows with generated ids"),
    "complete_sessions": ("J9", "complete sessions once"),
    "onboarding_gate": ("C10 K1", "show onboarding until a completed session"),
    "open_session": ("K2", "latest open session per company"),
    "transcript": ("K3", "session transcripts in id order"),
    "scripted_reply": ("D11 E5 K4", "scripted reply per user turn"),
    "profile_merge": ("K5", "shallow profile merge, version"),
    "profile_replace": ("K5", "profile replace mode: the newest patch only"),
    "apply_plan": ("D16 K7", "sorted profile keys, suggested syncs"),
    "calibration_status": ("K6", "calibration run steps and status"),
    "new_sessions": ("A7 D16 K8", "new sessions with integration snapshot"),
    "dq_unique": ("M1", "unique-key violations"),
    "dq_orphans": ("M2", "orphan foreign keys"),
    "dq_domain": ("M3", "NOT NULL and domain checks"),
    "dq_month_grain": ("M4 M5", "month-grain checks"),
    "metrics_schema_evolution": ("M6", "old rows read with the evolved schema"),
    "gmv_aov": ("X1", "GMV and average order value"),
    "conversion_rate": ("X2", "visitor-to-buyer conversion"),
    "repeat_rate": ("X3", "repeat-purchase rate"),
    "ltv": ("X4", "LTV = ARPA x margin / churn"),
    "stream_ingest": ("N1", "streaming ledger ingest, final snapshot"),
    "insert_products": ("A7", "products inserted with defaults and generated ids"),
    "insert_expenses": ("A7", "fixed expenses inserted with defaults and generated ids"),
    "insert_leads": ("A7", "leads inserted with defaults and generated ids"),
    "insert_projects": ("A7", "projects inserted with defaults and generated ids"),
    "insert_budget": ("A8", "budget items and their installments as inserted"),
    "delete_forecast": ("J7", "forecast table after deleting ids"),
    "delete_budget_item": ("J7 J8", "budget items and installments after a deletion and its cascade"),
    "cascade_company": ("J8", "rows of every table left after companies are deleted"),
    "retention": ("X3", "customers of a month who order again in the next month"),
    "profile_apply": ("K5", "stored profiles after ordered merge and replace requests"),
    "dashboard_json_parsed": ("A6", "dashboard documents parsed back into columns"),
    "pl_matrix_flat": ("I9", "P&L matrix, one row per cell"),
    "project_cashflow_lists": ("C11", "nested cash flow of all projects, one row per list entry"),
    "working_capital_filled": ("X5", "working capital, turnover and ROA over filled balance-sheet lines"),
    "full_sync": ("L6 L7 D15 G1", "landed, accepted and rejected documents, lines and their sum, from one parse"),
    "raw_ledger_lines": ("A2 A3 A4 A5", "ledger lines from the providers' raw response files"),
    "page_gaps": ("A2 A3 A4 A5", "missing pages of a fetch"),
    "stream_rejects": ("N1 L7", "dead letters of the stream after a replayed batch"),
    "store_schema_change": ("A9 M6 J5", "a table of change sets whose columns come and go"),
    "stored_requests": ("A7 A8 J7 J8", "inserts and deletes stored over own tables and read back"),
    "onboarding_cascade": ("J8 J9", "foreign-key actions over sessions, profiles and calibration runs"),
    "conversion_range": ("X2", "conversion over any period from monthly bitmaps"),
    "retention_range": ("X3", "retention by cohort and age over any period from monthly bitmaps"),
    "constraint_report": ("M1 M2 M3 M4", "all declared constraints, one scan per table"),
    "profile_lookup": ("K5 K9 H8", "nested profiles by path"),
    "tenant_list_forecast": ("B1", "forecast of a list of tenants from a company-clustered store"),
}
