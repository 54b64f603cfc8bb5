"""SaaS KPIs: B10 I14-I20 X6 (and the X1-X4 extensions in ``extensions``).

X6 derives the monthly metric inputs the reference expects a founder to type
in (MRR, its movements, new / lost customers) from the order facts:

* customer x month revenue is one partial+final aggregate;
* one window per customer over its (calendar-bounded) months emits what each
  row contributes to its month (MAU, MRR, expansion, contraction, new) and to
  the next month (churned MRR, lost) -- no self-join, no per-company collect;
* all contributions are folded by one company x month aggregate.

Everything after that is bounded by companies x months.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cashcurve.functions.exprs import MONEY, RATE, dbl, first_of_month, money, round_even_dp

METRIC_COLUMNS = ["mau", "cac", "churn_rate", "ltv", "revenue_per_employee", "mrr", "expansion_mrr",
                  "contraction_mrr", "churned_mrr", "starting_mrr", "new_customers", "sm_spend",
                  "customers_start_of_month", "customers_lost"]
MONEY_METRICS = ["cac", "churn_rate", "ltv", "revenue_per_employee", "mrr", "expansion_mrr", "contraction_mrr",
                 "churned_mrr", "starting_mrr", "sm_spend"]


def customer_month_revenue(order_company: DataFrame) -> DataFrame:
    """Revenue per company x customer x order month (exact decimal)."""
    return (order_company.groupBy(F.col("c_nationkey").alias("company_id"), F.col("o_custkey").alias("custkey"),
                                  first_of_month("o_orderdate").alias("month"))
            .agg(F.sum(money("o_totalprice")).alias("rev")))


def customer_contributions(cmr: DataFrame) -> DataFrame:
    """Per customer-month row, what it adds to its company's month and to the following month.

    One window per customer over its months (bounded by the calendar, so a
    customer holding a third of all orders is still only ~100 rows here):
    * at the row's month: MAU, MRR, expansion / contraction against the
      previous *calendar* month, and "new" when it is the customer's first month;
    * at the next calendar month, when the customer has no row there: churned
      MRR (this month's revenue) and "lost" when no later month exists at all.
    """
    w = Window.partitionBy("company_id", "custkey").orderBy("month")
    prev_m, next_m = F.lag("month").over(w), F.lead("month").over(w)
    pre = F.when(prev_m == F.add_months("month", -1), F.lag("rev").over(w))
    gap_after = next_m.isNull() | (next_m != F.add_months("month", 1))
    x = cmr.select("company_id", "month", "rev", pre.alias("pre"), prev_m.isNull().alias("first"),
                   gap_after.alias("gap_after"), next_m.isNull().alias("last"))
    cur, p = F.col("rev"), F.col("pre")
    money_type = cmr.schema["rev"].dataType
    no_money, no_count = F.lit(None).cast(money_type), F.lit(None).cast("int")

    def at(month, active, rev, expansion, contraction, churned, new, lost):
        return F.struct(month.alias("month"), active.alias("active"), rev.alias("rev"), expansion.cast(money_type).alias("expansion"),
                        contraction.cast(money_type).alias("contraction"), churned.alias("churned"), new.alias("new"), lost.alias("lost"))

    here = at(F.col("month"), F.lit(1), cur, F.when((cur > 0) & (p > 0) & (cur > p), cur - p),
              F.when((cur > 0) & (p > 0) & (cur < p), p - cur), no_money, F.when(F.col("first"), F.lit(1)), no_count)
    after = at(F.add_months("month", 1), no_count, no_money, no_money, no_money, F.when(cur > 0, cur), no_count,
               F.when(F.col("last"), F.lit(1)))
    # one pass over the window's rows: a row adds to its month and, before a gap, to the next one
    both = F.when(F.col("gap_after"), F.array(here, after)).otherwise(F.array(here))
    return x.select("company_id", F.explode(both).alias("c")).select("company_id", "c.*")


def monthly_metrics(order_company: DataFrame, one_off_expenses: DataFrame) -> DataFrame:
    """The monthly_metrics table, one row per company x month with orders.

    Shuffles: customer-month aggregate, the per-customer window, one
    company-month aggregate of all contributions, the company window over
    months, and the spend aggregate.
    """
    cmr = customer_month_revenue(order_company)
    g = customer_contributions(cmr).groupBy("company_id", "month").agg(
        F.sum("active").alias("mau"), F.sum("rev").alias("mrr"), F.sum("expansion").alias("expansion_mrr"),
        F.sum("contraction").alias("contraction_mrr"), F.sum("churned").alias("churned_mrr"),
        F.sum("new").alias("n_new"), F.sum("lost").alias("n_lost"))
    g = g.filter(F.col("mau") > 0)                       # months with orders only
    spend = (one_off_expenses.groupBy("company_id", first_of_month("expense_date").alias("month"))
             .agg(F.sum("amount").alias("sm_spend")))
    j = g.join(spend, ["company_id", "month"], "left")
    w = Window.partitionBy("company_id").orderBy("month")
    n_new = F.coalesce(F.col("n_new"), F.lit(0))
    established = F.sum(n_new).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - n_new
    z = F.lit(0)
    return j.select(
        "company_id", F.col("month").alias("month_date"), F.col("mau").cast("int").alias("mau"),
        F.when(F.col("company_id") % 3 == 0, F.lit(0)).otherwise(F.lit(500)).cast(MONEY).alias("cac"),
        F.lit(0).cast(RATE).alias("churn_rate"), F.lit(3000).cast(MONEY).alias("ltv"),
        F.lit(0).cast(MONEY).alias("revenue_per_employee"),
        F.col("mrr").cast(MONEY).alias("mrr"),
        F.col("expansion_mrr").cast(MONEY).alias("expansion_mrr"),
        F.col("contraction_mrr").cast(MONEY).alias("contraction_mrr"),
        F.col("churned_mrr").cast(MONEY).alias("churned_mrr"),
        F.lag("mrr").over(w).cast(MONEY).alias("starting_mrr"),
        F.nullif(n_new, z).cast("int").alias("new_customers"),
        F.col("sm_spend").cast(MONEY).alias("sm_spend"),
        F.nullif(established, z).cast("int").alias("customers_start_of_month"),
        F.col("n_lost").cast("int").alias("customers_lost"),
    )


def metrics_output(metrics: DataFrame, carry: tuple = ()) -> DataFrame:
    """A6 encoding of a metrics row (decimals -> double); ``carry``: further columns."""
    return metrics.select("company_id", "month_date",
                          *[dbl(c).alias(c) if c in MONEY_METRICS else F.col(c) for c in METRIC_COLUMNS], *carry)


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """The newest metrics row per company (month_date unique per company)."""
    order = F.col("month_date")
    g = metrics.groupBy("company_id").agg(F.max_by(F.struct(*[F.col(c) for c in METRIC_COLUMNS]), order).alias("m"),
                                          F.max(order).alias("month_date"))
    return metrics_output(g.select("company_id", "month_date", "m.*"))


def metric_pairs(latest: DataFrame) -> DataFrame:
    """Non-NULL metric values of the latest row as (metric, value) pairs (id/company/audit dropped)."""
    num = latest.select("company_id", "month_date", *[F.col(c).cast("double").alias(c) for c in METRIC_COLUMNS])
    long = num.unpivot(["company_id", "month_date"], METRIC_COLUMNS, "metric", "value")
    return long.filter(F.col("value").isNotNull())


def saas_kpis(metrics_out: DataFrame, gm: DataFrame, on: tuple[str, ...] = ("company_id", "month_date"),
              carry: tuple[str, ...] = ()) -> DataFrame:
    """I14-I19 per metrics row; ``gm`` supplies gross_margin_percent by ``on``; ``carry`` names metrics to pass on.

    The reference's Python truthiness rules become explicit NULL rules: a
    stored cac of 0, new_customers 0 or customers_start 0 count as absent (S7);
    CAC payback divides by *total* MRR x margin (S8).
    """
    j = metrics_out.join(gm, list(on), "left")
    mrr, sm = F.col("mrr"), F.col("starting_mrr")
    z = F.lit(0.0)
    nrr = F.when(sm > 0, round_even_dp((sm + F.coalesce("expansion_mrr", z) - F.coalesce("churned_mrr", z)
                                  - F.coalesce("contraction_mrr", z)) / sm * 100, 2))
    nc = F.col("new_customers")
    cac_inputs = F.when(F.col("sm_spend").isNotNull() & (nc > 0), round_even_dp(F.col("sm_spend") / nc, 2))
    cac_used = F.coalesce(cac_inputs, F.when(F.col("cac") != 0, F.col("cac")))
    ltv_cac = F.when(F.col("ltv").isNotNull() & (cac_used > 0), round_even_dp(F.col("ltv") / cac_used, 2))
    denom = mrr * (F.col("gross_margin_percent") / 100.0)
    payback = F.when((cac_used > 0) & mrr.isNotNull() & F.col("gross_margin_percent").isNotNull() & (denom > 0),
                     round_even_dp(cac_used / denom, 2))
    start = F.col("customers_start_of_month")
    churn = F.when(start > 0, round_even_dp(F.coalesce(F.col("customers_lost"), F.lit(0)) / start * 100, 4))
    return j.select(
        "company_id", "month_date", mrr.alias("mrr"), (mrr * 12).alias("arr"), nrr.alias("nrr_percent"),
        cac_inputs.alias("cac_from_inputs"), F.col("cac").alias("cac_stored"), ltv_cac.alias("ltv_cac_ratio"),
        payback.alias("cac_payback_months"), churn.alias("monthly_churn_percent"),
        F.col("churn_rate").alias("churn_rate_stored"), F.col("ltv").alias("ltv_stored"),
        F.col("gross_margin_percent"), *carry)


def saas_kpis_latest(metrics: DataFrame, health: DataFrame) -> DataFrame:
    """The KPI endpoint as built: latest metrics row x gross margin of the latest forecast month."""
    from cashcurve.operators.runway import latest_month_revenue
    lm = latest_metrics(metrics)
    gm = latest_month_revenue(health).select("company_id", F.col("latest_gross_margin_percent")
                                             .alias("gross_margin_percent"))
    return saas_kpis(lm, gm, on=("company_id",))
