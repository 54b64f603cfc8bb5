"""Financial statements: C7 D6 E2 I9-I13.

All per-month derivations that the reference computes in a Python loop over
one company's rows are columnar expressions here; the only window (``lag``
by 12 rows for year-over-year growth) runs over company-month rows, which are
bounded by the number of months per company, not by the size of the facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashcurve.functions.exprs import dbl, first_of_month, round_even_dp

# P&L line keys and labels, in display order.
PL_LINES = [
    ("revenue", "Revenue"),
    ("variable_costs", "Variable costs (COGS)"),
    ("contribution_margin", "Contribution margin"),
    ("fixed_costs", "Fixed costs (monthly)"),
    ("net_profit", "Net profit (operating-style)"),
    ("gross_margin_percent", "Gross margin %"),
    ("dol", "DOL (CM / net profit, approximate)"),
    ("rule_of_40", "Rule of 40 (YoY rev % + net margin % proxy)"),
]

# Balance-sheet scaffold lines (section, key, label, note); only cash is filled.
BALANCE_SHEET_LINES = [
    ("assets", "cash", "Cash and cash equivalents", None),
    ("assets", "receivables", "Accounts receivable", "Connect Xero / accounting sync"),
    ("assets", "inventory", "Inventory", "Connect Xero / accounting sync"),
    ("assets", "other_current_assets", "Other current assets", None),
    ("assets", "non_current_assets", "Non-current assets", None),
    ("liabilities", "payables", "Accounts payable", "Connect Xero / accounting sync"),
    ("liabilities", "current_liabilities", "Other current liabilities", None),
    ("liabilities", "non_current_liabilities", "Non-current liabilities", None),
    ("equity", "equity", "Equity (plug)", None),
]


def dol_column() -> Column:
    """Degree of operating leverage = round(gp / np, 4); NULL when np = 0 (NULLs count as 0)."""
    gp = F.coalesce(F.col("gross_profit"), F.lit(0.0))
    np_ = F.coalesce(F.col("net_profit"), F.lit(0.0))
    return F.when(np_ != 0, round_even_dp(gp / np_, 4))


def dol(health: DataFrame) -> DataFrame:
    """I10 per company x month."""
    return health.select("company_id", "forecast_month", "gross_profit", "net_profit", dol_column().alias("dol"))


def with_rule_of_40(health: DataFrame) -> DataFrame:
    """I11 + E2 as added columns: YoY growth against the row 12 *positions* earlier (S5) plus net
    margin, both 2 dp, and their 2-dp sum.  One window over company-month rows."""
    w = Window.partitionBy("company_id").orderBy("forecast_month")
    rev = F.coalesce(F.col("revenue"), F.lit(0.0))
    np_ = F.coalesce(F.col("net_profit"), F.lit(0.0))
    pos = F.row_number().over(w)
    prev = F.coalesce(F.lag("revenue", 12).over(w), F.lit(0.0))
    out = health.select("*", F.when((pos > 12) & (prev > 0), round_even_dp((rev - prev) / prev * 100, 2))
                        .alias("yoy_growth_percent"),
                        F.when(rev > 0, round_even_dp(np_ / rev * 100, 2)).alias("net_margin_percent"))
    return out.withColumn(
        "rule_of_40",
        F.when(F.col("yoy_growth_percent").isNotNull() & F.col("net_margin_percent").isNotNull(),
               round_even_dp(F.col("yoy_growth_percent") + F.col("net_margin_percent"), 2)))


def rule_of_40(health: DataFrame) -> DataFrame:
    """I11 per company x month."""
    return with_rule_of_40(health).select("company_id", "forecast_month", "revenue", "net_profit",
                                          "yoy_growth_percent", "net_margin_percent", "rule_of_40")


def pl_matrix_long(health: DataFrame) -> DataFrame:
    """The 8-line P&L per company x month in long form (line_key, value), via unpivot.

    DOL and Rule of 40 are columns of the same company-month rows (one window),
    so the health table is computed once -- no self-joins.
    """
    wide = (with_rule_of_40(health)
            .select("company_id", "forecast_month", "revenue", "variable_costs",
                    F.col("gross_profit").alias("contribution_margin"), "fixed_costs", "net_profit",
                    "gross_margin_percent", dol_column().alias("dol"), "rule_of_40"))
    long = wide.unpivot(["company_id", "forecast_month"], [k for k, _ in PL_LINES], "line_key", "value")
    labels = F.create_map(*[x for k, lbl in PL_LINES for x in (F.lit(k), F.lit(lbl))])
    orders = F.create_map(*[x for i, (k, _) in enumerate(PL_LINES) for x in (F.lit(k), F.lit(i + 1))])
    return long.select("company_id", "forecast_month", "line_key",
                       labels[F.col("line_key")].alias("line_label"),
                       orders[F.col("line_key")].alias("line_order"), "value")


def pl_matrix(pl_long: DataFrame) -> DataFrame:
    """I9 matrix form: one row per company x line, cells ordered by month (array_agg by month)."""
    g = pl_long.groupBy("company_id", "line_order", "line_key", "line_label").agg(
        F.array_sort(F.collect_list(F.struct("forecast_month", "value"))).alias("cells"))
    return g.select("company_id", "line_order", "line_key", "line_label",
                    F.transform("cells", lambda c: c["forecast_month"]).alias("columns"),
                    F.transform("cells", lambda c: c["value"]).alias("cells"))


def capex_by_month(one_off_expenses: DataFrame) -> DataFrame:
    """One-off spend per company x calendar month."""
    return (one_off_expenses.groupBy("company_id", first_of_month("expense_date").alias("forecast_month"))
            .agg(F.sum("amount").alias("capex_d")))


def cashflow_proxy(health: DataFrame, one_off_expenses: DataFrame) -> DataFrame:
    """I12 + C7: operating proxy = net profit, CAPEX of the month (0 if none), net = op - capex.

    Left join *from* the P&L months: CAPEX in a month without a forecast row is
    not shown, as in the reference (S6).
    """
    cx = capex_by_month(one_off_expenses)
    j = health.select("company_id", "forecast_month", "net_profit").join(cx, ["company_id", "forecast_month"], "left")
    op = F.coalesce(F.col("net_profit"), F.lit(0.0))
    capex = F.coalesce(dbl("capex_d"), F.lit(0.0))
    return j.select("company_id", "forecast_month", op.alias("operating_cash_proxy"), capex.alias("capex"),
                    (op - capex).alias("net_cash_flow_proxy"))


def balance_sheet(companies: DataFrame, cash_balances: DataFrame) -> DataFrame:
    """Nine scaffold lines per company; cash from the latest balance, as-of its date.

    The template is exploded per company row (no join): 9 output rows per company.
    """
    from cashcurve.operators.runway import latest_cash
    lc = latest_cash(cash_balances)
    c = companies.select(F.col("id").alias("company_id")).join(lc, "company_id", "left")
    tmpl = F.array(*[F.struct(F.lit(i + 1).alias("line_order"), F.lit(s).alias("section"), F.lit(k).alias("line_key"),
                              F.lit(lbl).alias("label"), F.lit(n).cast("string").alias("note"))
                     for i, (s, k, lbl, n) in enumerate(BALANCE_SHEET_LINES)])
    e = c.select("company_id", "balance_date", "total_cash", F.explode(tmpl).alias("l"))
    return e.select("company_id", F.col("balance_date").alias("as_of"), "l.line_order", "l.section", "l.line_key",
                    "l.label", F.when(F.col("l.line_key") == "cash", dbl("total_cash")).alias("amount"), "l.note")


def filled_balance_sheet(balance: DataFrame, amounts: DataFrame) -> DataFrame:
    """I13 with the lines an accounting sync supplies: ``amounts`` (company_id, line_key, amount) fills NULL lines."""
    a = amounts.select("company_id", "line_key", F.col("amount").alias("_synced"))
    j = balance.join(a, ["company_id", "line_key"], "left")
    return j.withColumn("amount", F.coalesce("amount", F.col("_synced").cast("double"))).select(*balance.columns)


def working_capital(balance: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Net working capital, current and quick ratio, asset turnover, ROA over the line table.

    NULL while the lines they need are NULL (they are until a ledger balance sheet is synced), exactly as the reference reports
    them.  ``results`` (company_id, revenue, net_profit) supplies the flows of turnover (revenue / assets) and ROA (% of assets).
    """
    keys = ("cash", "receivables", "inventory", "other_current_assets", "non_current_assets", "payables", "current_liabilities")
    g = balance.groupBy("company_id").agg(*[F.max(F.when(F.col("line_key") == k, F.col("amount"))).alias(k) for k in keys])
    if results is None:
        g = g.withColumns({"revenue": F.lit(None).cast("double"), "net_profit": F.lit(None).cast("double")})
    else:
        g = g.join(results.select("company_id", F.col("revenue").cast("double").alias("revenue"), F.col("net_profit").cast("double").alias("net_profit")),
                   "company_id", "left")
    ca = F.col("cash") + F.col("receivables") + F.col("inventory") + F.col("other_current_assets")
    cl = F.nullif(F.col("payables") + F.col("current_liabilities"), F.lit(0.0))
    assets = F.nullif(ca + F.col("non_current_assets"), F.lit(0.0))
    return g.select(
        "company_id", (ca - (F.col("payables") + F.col("current_liabilities"))).alias("net_working_capital"), (ca / cl).alias("current_ratio"),
        ((ca - F.col("inventory")) / cl).alias("quick_ratio"), (F.col("revenue") / assets).alias("asset_turnover"),
        (F.col("net_profit") / assets * 100).alias("roa"))
