"""A2-A5 landing: provider document pages as JSON text, built from the order facts.

The reference pulls pages of <= 100 documents from two ledger providers over
HTTP.  Here the pages are *landed data*: a Spark job renders every order as an
invoice document and every finished line item as a payment, groups them into
pages and writes the page bodies (JSON text) -- the same bytes a fetcher would
store.  The ingest operators (``operators.ledger``) only ever see the JSON.

Synthetic content follows FIXTURES.md section 3 (fixed rules below): provider
by customer parity, DRAFT / payable / bad-date invoices that must be rejected,
missing or lower-case currencies, wrapped epoch-millis and ISO dates, contacts
on the invoice or on the payment, and provider-2 responses whose document
field is an object when a page holds one document and a list otherwise.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashcurve.functions.exprs import money
from cashcurve.session import partitioned_by_part_of_key, sorted_groups, unsorted_partitions
from cashcurve.sources.model import MODEL_VERSION, ModelTables, ensure_stored
from cashcurve.sources.page_files import page_body, write_page_files

# Fixed values of the landing rules.
INVOICES_PER_PAGE_KEYRANGE = 100   # invoice page = order keys [100p, 100p+99] of one tenant
PAYMENTS_PER_PAGE_KEYRANGE = 10    # payment page = lines of 10 consecutive orders (<= 70 docs)
LINES_PER_PAGE = 100           # line numbers of one order on one payment page
PAYABLE_EVERY = 10                 # o_orderkey % 10 = 0 -> Type ACCPAY (rejected)
BAD_DATE_EVERY = 97                # o_orderkey % 97 = 0 -> '2025-13-01' (rejected)
BAD_DATE_TEXT = "2025-13-01"
STATUS_BY_ORDER_STATUS = {"F": "PAID", "P": "authorised", "O": "DRAFT"}


def _provider(custkey):
    return F.when(custkey % 2 == 0, "xero").otherwise("quickbooks")


def _currency(custkey):
    # missing (-> GBP downstream), lower-case eur, USD by customer key % 3
    return F.when(custkey % 3 == 1, "eur").when(custkey % 3 == 2, "USD")


def _wrapped_millis(ts_col, key):
    ms = F.unix_millis(ts_col.cast("timestamp")).cast("string")
    off = F.when(key % 4 == 0, F.lit("+0100")).otherwise(F.lit(""))
    return F.concat(F.lit("/Date("), ms, off, F.lit(")/"))


def _contact(custkey, name):
    return F.struct(F.concat(F.lit("C"), custkey.cast("string")).alias("ContactID"), name.alias("Name"))


#: Columns of the facts that documents are made of; texts are written once the rows have met on their page, so that no text is shuffled.
INVOICE_FIELDS = {"k": "o_orderkey", "ck": "o_custkey", "status": "o_orderstatus", "price": "o_totalprice", "day": "o_orderdate", "name": "c_name"}
PAYMENT_FIELDS = {"k": "l_orderkey", "ck": "o_custkey", "ln": "l_linenumber", "part": "l_partkey", "supp": "l_suppkey", "price": "l_extendedprice",
                  "day": "l_shipdate", "name": "c_name"}
PAGE_KEY = ["provider", "tenant_id", "kind", "page_no"]


def _rows(facts: DataFrame, kind: str, fields: dict[str, str], page_no: Column, doc_order: Column) -> DataFrame:
    """Page columns, doc_order and the fields of the documents of one kind."""
    return facts.select(
        _provider(F.col(fields["ck"])).alias("provider"), F.concat(F.lit("T"), F.col("c_nationkey").cast("string")).alias("tenant_id"),
        F.lit(kind).alias("kind"), page_no.alias("page_no"), *[c for c in ("block",) if c in facts.columns], doc_order.alias("doc_order"),
        *[F.col(c).alias(n) for n, c in fields.items()])


def invoice_rows(m: ModelTables) -> DataFrame:
    k = F.col("o_orderkey")
    return _rows(m.order_company, "invoices", INVOICE_FIELDS, F.floor(k / INVOICES_PER_PAGE_KEYRANGE), k)


def _block(order: str) -> Column:
    """Range of order keys that every page of either kind lies in."""
    return F.floor(F.col(order) / INVOICES_PER_PAGE_KEYRANGE)


def payment_rows(m: ModelTables, by_block: bool = False) -> DataFrame:
    """Lines with their order; ``by_block``: they are partitioned by their block before they meet it, so that pages need no shuffle after."""
    li = m.raw.lineitem.filter(F.col("l_linestatus") == "F").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    oc = m.order_company.select("o_orderkey", "o_custkey", "c_nationkey", "c_name")
    met = li.l_orderkey == oc.o_orderkey
    if by_block:
        li, oc = li.withColumn("block", _block("l_orderkey")).repartition("block"), oc.withColumn("o_block", _block("o_orderkey"))
        met = (li.block == oc.o_block) & (li.l_orderkey == oc.o_orderkey)
    j = li.join(oc, met, "inner")
    k, ln = F.col("l_orderkey"), F.col("l_linenumber")
    return _rows(j, "payments", PAYMENT_FIELDS, F.floor(k / PAYMENTS_PER_PAGE_KEYRANGE) * (1 << 20) + F.floor(ln / LINES_PER_PAGE), k * 1_000_000 + ln)


def invoice_text(c) -> Column:
    """The invoice of a row; ``c`` gives the column of a field."""
    k, ck = c("k"), c("ck")
    status = F.lit("DRAFT")
    for s, v in STATUS_BY_ORDER_STATUS.items():
        status = F.when(c("status") == s, F.lit(v)).otherwise(status)
    bad = k % BAD_DATE_EVERY == 0
    xero_date = (F.when(bad, F.lit(BAD_DATE_TEXT))
                 .when(k % 2 == 0, _wrapped_millis(c("day"), k))
                 .otherwise(F.date_format(c("day"), "yyyy-MM-dd'T'HH:mm:ss")))
    xero = F.to_json(F.struct(
        F.concat(F.lit("INV-"), k.cast("string")).alias("InvoiceID"),
        F.when(k % PAYABLE_EVERY == 0, "ACCPAY").otherwise("ACCREC").alias("Type"),
        status.alias("Status"), money(c("price")).alias("Total"), xero_date.alias("Date"),
        _currency(ck).alias("CurrencyCode"), _contact(ck, c("name")).alias("Contact")))
    qbo = F.to_json(F.struct(
        k.cast("string").alias("Id"), money(c("price")).alias("TotalAmt"),
        F.when(bad, F.lit(BAD_DATE_TEXT)).otherwise(F.date_format(c("day"), "yyyy-MM-dd")).alias("TxnDate"),
        F.struct(F.concat(F.lit("C"), ck.cast("string")).alias("value"), c("name").alias("name")).alias("CustomerRef"),
        F.struct(_currency(ck).alias("value")).alias("CurrencyRef")))
    return F.when(_provider(ck) == "xero", xero).otherwise(qbo)


def payment_text(c) -> Column:
    """The payment of a row; ``c`` gives the column of a field."""
    k, ln, ck = c("k"), c("ln"), c("ck")
    pid = F.concat_ws("-", F.concat(F.lit("P"), k.cast("string")), ln.cast("string"), c("part").cast("string"), c("supp").cast("string"))
    contact = _contact(ck, c("name"))
    on_invoice = ln % 2 == 1
    xero = F.to_json(F.struct(
        pid.alias("PaymentID"), F.lit("AUTHORISED").alias("Status"), money(c("price")).alias("Amount"),
        F.when(k % 2 == 0, _wrapped_millis(c("day"), k))
         .otherwise(F.date_format(c("day"), "yyyy-MM-dd'T'HH:mm:ss")).alias("Date"),
        _currency(ck).alias("CurrencyCode"),
        F.struct(F.concat(F.lit("INV-"), k.cast("string")).alias("InvoiceID"),
                 F.when(on_invoice, F.lit("ACCREC")).alias("Type"),
                 F.when(on_invoice, contact).alias("Contact")).alias("Invoice"),
        F.when(~on_invoice, contact).alias("Contact")))
    inv_txn = F.struct(k.cast("string").alias("TxnId"), F.lit("Invoice").alias("TxnType"))
    memo_txn = F.struct(F.concat(F.lit("CM-"), pid).alias("TxnId"), F.lit("CreditMemo").alias("TxnType"))
    lines = (F.when(ln % 5 == 0, F.array(F.struct(F.array(memo_txn).alias("LinkedTxn"))))
             .when(ln % 3 == 0, F.array(F.struct(F.array(memo_txn).alias("LinkedTxn")),
                                        F.struct(F.array(inv_txn).alias("LinkedTxn"))))
             .otherwise(F.array(F.struct(F.array(inv_txn).alias("LinkedTxn")))))
    qbo = F.to_json(F.struct(
        pid.alias("Id"), money(c("price")).alias("TotalAmt"),
        F.date_format(c("day"), "yyyy-MM-dd").alias("TxnDate"),
        F.struct(F.concat(F.lit("C"), ck.cast("string")).alias("value"), c("name").alias("name")).alias("CustomerRef"),
        F.struct(_currency(ck).alias("value")).alias("CurrencyRef"), lines.alias("Line")))
    return F.when(_provider(ck) == "xero", xero).otherwise(qbo)


def _pages(rows: DataFrame, kind: str, text) -> DataFrame:
    """Pages of one kind, of rows that lie together by (a part of) their page's key: texts are made there, from bare fields."""
    # a constant is no key: rows partitioned with it would be shuffled again to be grouped without it
    key = [c for c in rows.columns if c in ("provider", "tenant_id", "page_no", "block")]
    g = rows.select(*key, "doc_order", text(F.col).alias("doc")).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("doc_order", "doc"))).alias("docs"))
    body = page_body(F.col("provider"), F.col("kind"), F.transform("docs", lambda d: d["doc"]))
    return g.withColumn("kind", F.lit(kind)).select(*PAGE_KEY, body.alias("body"))


def landed_pages(m: ModelTables) -> DataFrame:
    """All provider pages: (provider, tenant_id, kind, page_no, body).

    Documents are grouped per page, ordered inside the page.  The page key bounds a page by construction: an invoice
    page holds one key range of orders, a payment page the lines of one key range of orders and of one
    range of line numbers, so an order with very many lines fills many pages.  Every fact is shuffled once, as bare fields.
    """
    invoices = invoice_rows(m).repartition("provider", "tenant_id", "page_no")
    return _pages(invoices, "invoices", invoice_text).unionByName(_pages(payment_rows(m, by_block=True), "payments", payment_text))


with open(__file__, "rb") as _fh:   # pages depend on this module and on the model-table mapping
    LANDING_VERSION = "pages-" + hashlib.sha1(_fh.read() + MODEL_VERSION.encode()).hexdigest()[:12]
PAGE_COLUMNS = "provider string, tenant_id string, kind string, page_no bigint, body string"


def landing_zone(m: ModelTables) -> DataFrame:
    """The landed pages as files: built once per source directory, then read like any landed table.

    Pages are written (parquet) under the session's shared ``spark.checkpoint.dir``
    the first time they are needed; later ingest jobs only read the files, and the
    ingest lineage starts at the files.  The files are partitioned by provider and kind,
    written as the pages come: bodies are neither shuffled nor sorted.  They are compressed with zstd, as texts that are read often.
    """
    from cashcurve.session import checkpoint_dir
    spark = m.spark
    root = os.path.join(checkpoint_dir(spark), "landing", f"{LANDING_VERSION}-{m.source_digest}")

    def write(path: str) -> None:
        with unsorted_partitions(spark), partitioned_by_part_of_key(spark), sorted_groups(spark):
            landed_pages(m).write.partitionBy("provider", "kind").option("compression", "zstd").parquet(path)

    ensure_stored(spark, root, write)
    return spark.read.schema(PAGE_COLUMNS).parquet(root).select("provider", "tenant_id", "kind", "page_no", "body")


def raw_page_files(m: ModelTables) -> str:
    """Folder of the providers' raw responses, pages of 100 documents; fetched once per state of the sources."""
    from cashcurve.session import checkpoint_dir
    root = os.path.join(checkpoint_dir(m.spark), "raw-pages", f"{LANDING_VERSION}-{m.source_digest}")
    rows = invoice_rows(m).unionByName(payment_rows(m), allowMissingColumns=True).drop("page_no")
    doc = F.when(F.col("kind") == "invoices", invoice_text(F.col)).otherwise(payment_text(F.col))
    ensure_stored(m.spark, root, lambda path: write_page_files(rows, path, doc))
    return root
