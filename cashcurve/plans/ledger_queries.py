"""Query keys for step 7 (ledger ingest): A2-A5 L1-L7 G1 C6 D15 J5 (batch)."""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashcurve.operators import ledger as lg
from cashcurve.operators.sync import full_sync
from cashcurve.plans.oracle_tables import with_tables
from cashcurve.plans.registry import register
from cashcurve.session import checkpoint_dir
from cashcurve.sources.files import SharedFiles
from cashcurve.sources.ledger_pages import LANDING_VERSION, landing_zone, raw_page_files
from cashcurve.sources.model import ModelTables, ensure_stored
from cashcurve.sources.page_files import page_gaps, read_page_files

# Oracle: the expected ledger lines computed from the base tables with the landing rules
# (FIXTURES section 3), without going through JSON.
LEDGER_CTES = [
    ("docs", """
        SELECT o.o_orderkey AS k, o.o_custkey AS ck, o.o_orderstatus AS st, o.o_totalprice AS tp,
               o.o_orderdate AS od, c.c_nationkey AS company_id, c.c_name AS cname,
               CASE WHEN o.o_custkey % 2 = 0 THEN 'xero' ELSE 'quickbooks' END AS provider,
               CASE o.o_custkey % 3 WHEN 1 THEN 'EUR' WHEN 2 THEN 'USD' ELSE 'GBP' END AS currency
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""),
    ("inv_lines", """
        SELECT company_id, company_id * 2 + CASE WHEN provider = 'xero' THEN 0 ELSE 1 END AS connection_id,
               provider, 'accrual' AS basis,
               CASE WHEN provider = 'xero' THEN 'invoice_total' ELSE 'qbo_invoice' END AS line_kind,
               CASE WHEN provider = 'xero' THEN 'INV-' || k ELSE CAST(k AS VARCHAR) END AS external_invoice_id,
               CAST(NULL AS VARCHAR) AS external_payment_id, 'C' || ck AS external_contact_id,
               cname AS contact_name, CAST(tp AS DECIMAL(19,4)) AS amount, currency,
               CAST(od AS DATE) AS posted_date,
               CASE WHEN provider = 'xero' THEN 'xero:T' || company_id || ':accrual:invoice:INV-' || k
                    ELSE 'qbo:T' || company_id || ':accrual:invoice:' || k END AS idempotency_key
        FROM docs
        WHERE k % 97 <> 0 AND (provider = 'quickbooks' OR (k % 10 <> 0 AND st IN ('F', 'P')))"""),
    ("pay_lines", """
        SELECT company_id, company_id * 2 + CASE WHEN provider = 'xero' THEN 0 ELSE 1 END AS connection_id,
               provider, 'cash' AS basis,
               CASE WHEN provider = 'xero' THEN 'invoice_payment' ELSE 'qbo_payment' END AS line_kind,
               CASE WHEN provider = 'xero' THEN 'INV-' || lk WHEN ln % 5 = 0 THEN NULL
                    ELSE CAST(lk AS VARCHAR) END AS external_invoice_id,
               pid AS external_payment_id, 'C' || ck AS external_contact_id, cname AS contact_name,
               CAST(ep AS DECIMAL(19,4)) AS amount, currency, CAST(sd AS DATE) AS posted_date,
               CASE WHEN provider = 'xero' THEN 'xero:T' || company_id || ':cash:payment:' || pid
                    ELSE 'qbo:T' || company_id || ':cash:payment:' || pid END AS idempotency_key
        FROM (SELECT d.*, l.l_orderkey AS lk, l.l_linenumber AS ln, l.l_extendedprice AS ep, l.l_shipdate AS sd,
                     'P' || l.l_orderkey || '-' || l.l_linenumber || '-' || l.l_partkey || '-' || l.l_suppkey AS pid
              FROM lineitem l JOIN docs d ON d.k = l.l_orderkey WHERE l.l_linestatus = 'F') x"""),
    ("all_lines", "SELECT * FROM inv_lines UNION ALL SELECT * FROM pay_lines"),
]


def documents_of(m: ModelTables):
    return lg.normalised_documents(landing_zone(m), m.connections)


with open(lg.__file__, "rb") as _fh:
    LEDGER_VERSION = hashlib.sha1(_fh.read() + LANDING_VERSION.encode()).hexdigest()[:12]


def write_by_month(lines, path: str) -> None:
    """Write ledger lines by posting month.

    They are written as they come first: that holds far less than what was shuffled for them, which goes before they are shuffled by month.
    """
    made = f"{path}.lines"
    lines.write.option("compression", "zstd").parquet(made)
    rows = lines.sparkSession.read.schema(lines.schema).parquet(made).withColumn("posted_month", F.trunc("posted_date", "MM"))
    # large months are cut, small ones joined by measured size; a range partitioning would read the lines twice, for its sample and for itself
    rows.hint("rebalance", "posted_month").sortWithinPartitions("posted_month", "company_id").write.partitionBy("posted_month") \
        .option("compression", "zstd").parquet(path)
    SharedFiles(lines.sparkSession).remove(made)


def actual_lines_table(m: ModelTables, as_of: str | None = None):
    """The accounting_actual_lines table as the first full sync leaves it, stored once per state of the sources.

    Reports, patches and re-syncs read this table, as the app reads its own
    table; the ingest queries (``ledger_lines``, ``stream_ingest``) run the JSON path.
    It is stored by posting month; ``as_of`` reads only that date's month.
    """
    own = getattr(m, "accounting_actual_lines", None)
    if own is not None:                                     # a user's own table
        return own
    lines = lg.accepted_lines(documents_of(m), m.lead_links)
    if not m.stored:
        return lines
    root = os.path.join(checkpoint_dir(m.spark), "model", f"lines-{LEDGER_VERSION}-{m.source_digest}")
    ensure_stored(m.spark, root, lambda path: write_by_month(lines, path))
    stored = m.spark.read.schema(T.StructType([*lines.schema.fields, T.StructField("posted_month", T.DateType())])).parquet(root)
    if as_of is not None:
        stored = stored.filter(F.col("posted_month") == F.trunc(F.lit(as_of).cast("date"), "MM"))
    return stored.select(*lines.columns)


LINES_ORACLE = with_tables(["lead_links"], """
    SELECT a.company_id, a.connection_id, a.provider, a.basis, a.line_kind, a.external_invoice_id,
           a.external_payment_id, a.external_contact_id, a.contact_name, CAST(a.amount AS DOUBLE) AS amount,
           a.currency, a.posted_date, a.idempotency_key, ll.lead_id
    FROM all_lines a LEFT JOIN lead_links ll
      ON ll.company_id = a.company_id AND ll.provider = a.provider AND ll.external_contact_id = a.external_contact_id
    """, LEDGER_CTES)


@register("ledger_lines", oracle=LINES_ORACLE)
def q_ledger_lines(spark, sf_dir):
    m = ModelTables(spark, sf_dir)
    return lg.lines_output(lg.accepted_lines(documents_of(m), m.lead_links))


REJECTS_ORACLE = with_tables([], """
    SELECT provider, 'accrual' AS basis, reason AS reject_reason, count(*) AS documents
    FROM (SELECT provider,
                 CASE WHEN provider = 'xero' THEN
                        CASE WHEN k % 10 = 0 THEN 'not_receivable' WHEN st = 'O' THEN 'voided_or_draft'
                             WHEN k % 97 = 0 THEN 'bad_date' END
                      ELSE CASE WHEN k % 97 = 0 THEN 'bad_date' END END AS reason
          FROM docs) r
    WHERE reason IS NOT NULL GROUP BY 1, 2, 3""", LEDGER_CTES[:1])


@register("ledger_rejects", oracle=REJECTS_ORACLE)
def q_ledger_rejects(spark, sf_dir):
    return lg.reject_report(documents_of(ModelTables(spark, sf_dir)))


@register("sync_counts", oracle=with_tables([], """
    SELECT company_id, provider, basis, count(*) AS rows_upserted FROM all_lines GROUP BY 1, 2, 3""", LEDGER_CTES))
def q_sync_counts(spark, sf_dir):
    return lg.sync_counts(documents_of(ModelTables(spark, sf_dir)))


@register("full_sync", oracle=with_tables([], """
    SELECT company_id, provider, basis, count(*) AS landed, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS rejected,
           count(*) FILTER (ok) AS lines, CAST(sum(amount) FILTER (ok) AS DOUBLE) AS amount
    FROM (SELECT company_id, provider, 'accrual' AS basis, CAST(tp AS DECIMAL(19,4)) AS amount,
                 k % 97 <> 0 AND (provider = 'quickbooks' OR (k % 10 <> 0 AND st IN ('F', 'P'))) AS ok FROM docs
          UNION ALL SELECT company_id, provider, basis, amount, TRUE FROM pay_lines) x
    GROUP BY 1, 2, 3""", LEDGER_CTES))
def q_full_sync(spark, sf_dir):
    """One parse of all pages; landed, accepted and rejected documents, lines and their sum per company, provider and basis."""
    m = ModelTables(spark, sf_dir)
    folder = os.path.join(checkpoint_dir(spark), "syncs", uuid.uuid4().hex)
    return full_sync(landing_zone(m), m.connections, m.lead_links, folder).summary()


@register("raw_ledger_lines", oracle=LINES_ORACLE)
def q_raw_ledger_lines(spark, sf_dir):
    """A2-A5 from the providers' raw response files: the same lines as from the landed table."""
    m = ModelTables(spark, sf_dir)
    pages = read_page_files(spark, raw_page_files(m))
    return lg.lines_output(lg.accepted_lines(lg.normalised_documents(pages, m.connections), m.lead_links))


GAP_CTES = [
    ("feeds", """
        SELECT provider, kind, tenant, count(*) AS n
        FROM (SELECT provider, 'invoices' AS kind, company_id AS tenant FROM docs
              UNION ALL SELECT provider, 'payments', company_id FROM pay_lines) f GROUP BY 1, 2, 3"""),
    ("present", """
        SELECT * FROM (SELECT provider, kind, tenant, n, unnest(generate_series(1, (n + 99) // 100)) AS p FROM feeds) g
        WHERE (7 * p + tenant) % 11 <> 0"""),
    ("placed", """
        SELECT *, lead(p) OVER w AS later, lag(p) OVER w AS earlier FROM present WINDOW w AS (PARTITION BY provider, kind, tenant ORDER BY p)"""),
]


@register("page_gaps", oracle=with_tables([], """
    SELECT provider, kind, 'T' || tenant AS tenant_id, p + 1 AS first_page, later - 1 AS last_page, 'missing' AS reason FROM placed WHERE later > p + 1
    UNION ALL SELECT provider, kind, 'T' || tenant, 1, p - 1, 'missing' FROM placed WHERE earlier IS NULL AND p > 1
    UNION ALL SELECT provider, kind, 'T' || tenant, p + 1, NULL, 'open_end' FROM placed WHERE later IS NULL AND 100 * p <= n""",
                                        [*LEDGER_CTES, *GAP_CTES]))
def q_page_gaps(spark, sf_dir):
    """Missing pages of a fetch that lost every eleventh raw file."""
    pages = read_page_files(spark, raw_page_files(ModelTables(spark, sf_dir)))
    return page_gaps(pages.filter((7 * F.col("page_no") + F.substring("tenant_id", 2, 9).cast("int")) % 11 != 0))
