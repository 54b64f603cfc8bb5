"""Ledger ingest ETL: A2-A5 parsing, L1-L5 normalisation, L7 rejects, G1 union, C6 lead links,
J5 batch de-duplication and D15 counts.

The reference loops over documents in Python, one company at a time, with two
database round trips per document.  Here one job parses every landed page
once (``from_json`` with one explicit schema for all kinds), explodes the documents, applies the
acceptance rules as column predicates (the first failing rule becomes the
``reject_reason``), resolves tenant -> company and contact -> lead with two
equi-joins and keeps the last delivery per idempotency key with ``max_by`` (one
buffer per key: a hot key is never collected).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashcurve.functions.exprs import MONEY, dbl

CONTACT = "struct<ContactID:string,Name:string>"
QBO_REF = "CustomerRef:struct<value:string,name:string>,CurrencyRef:struct<value:string>"
#: One schema for the pages of both providers and kinds: a page fills the one field it has.
PAGE = (f"struct<Invoices:array<struct<InvoiceID:string,Type:string,Status:string,Total:string,Date:string,CurrencyCode:string,Contact:{CONTACT}>>,"
        f"Payments:array<struct<PaymentID:string,Status:string,Amount:string,Date:string,CurrencyCode:string,"
        f"Invoice:struct<InvoiceID:string,Type:string,Contact:{CONTACT}>,Contact:{CONTACT}>>,QueryResponse:struct<Invoice:string,Payment:string>>")
#: Documents of provider 2, which are an object or a list.
QBO_DOCUMENTS = f"array<struct<Id:string,TotalAmt:string,TxnDate:string,{QBO_REF},Line:array<struct<LinkedTxn:array<struct<TxnId:string,TxnType:string>>>>>>"

# Provider-1 status rules.
XERO_SKIP_INVOICE_STATUS = ["VOIDED", "DELETED", "DRAFT"]
XERO_POSTED_INVOICE_STATUS = ["AUTHORISED", "PAID", "SUBMITTED"]
XERO_SKIP_PAYMENT_STATUS = ["DELETED", "VOIDED"]
DEFAULT_CURRENCY = "GBP"
MIN_EPOCH_MS, MAX_EPOCH_MS = -2208988800000, 253402300799999  # 1900-01-01 to 9999-12-31T23:59:59.999Z

LINE_COLUMNS = ["company_id", "connection_id", "provider", "basis", "line_kind", "external_invoice_id",
                "external_payment_id", "external_contact_id", "contact_name", "amount", "currency", "posted_date",
                "idempotency_key"]


# -- H5 / L5: dates -------------------------------------------------------------
def iso_prefix_date(c: Column) -> Column:
    """date.fromisoformat(value[:10]); empty / unparsable -> NULL (ANSI-safe).  Plain ten-character dates take the faster cast."""
    text = F.substring(c, 1, 10)
    return F.when(text.rlike("^[1-9][0-9]{3}-[0-9]{2}-[0-9]{2}$"), text.try_cast("date")).when(F.coalesce(c, F.lit("")) != "", F.try_to_date(text, "yyyy-MM-dd"))


def epoch_text(c: Column) -> Column:
    """The ms of '/Date(ms[+-hhmm])/' (anchored at the start) as text, else NULL."""
    return F.nullif(F.regexp_extract(F.trim(c), r"^/Date\((-?\d+)([+-]\d+)?\)/", 1), F.lit(""))


def date_of_epoch(ms: Column) -> Column:
    # compared before any arithmetic: abs() of the smallest long overflows
    return F.when(ms.between(MIN_EPOCH_MS, MAX_EPOCH_MS), F.to_date(F.timestamp_millis(ms)))


def xero_date(c: Column) -> Column:
    """'/Date(ms[+-hhmm])/' (anchored at the start, offset ignored, UTC date) else the ISO prefix."""
    return F.when(epoch_text(c).isNotNull(), date_of_epoch(epoch_text(c).try_cast("bigint"))).otherwise(iso_prefix_date(c))


def _currency(c: Column) -> Column:
    """(value or 'GBP')[:3].upper()"""
    return F.upper(F.substring(F.coalesce(F.nullif(c, F.lit("")), F.lit(DEFAULT_CURRENCY)), 1, 3))


def _nonempty(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _amount(c: Column) -> Column:
    return c.try_cast(MONEY)


# -- A2-A5: page parsing ----------------------------------------------------------


def first_linked_invoice(lines: Column) -> Column:
    """H7: TxnId of the first LinkedTxn (across Line[] in order) whose TxnType is 'Invoice'."""
    txns = F.flatten(F.transform(F.coalesce(lines, F.array()), lambda l: F.coalesce(l["LinkedTxn"], F.array())))
    inv = F.filter(txns, lambda t: t["TxnType"] == "Invoice")
    return F.try_element_at(inv, F.lit(1))["TxnId"]


_DOCUMENT = ("invoice_id", "payment_id", "type", "status", "amount", "date", "currency", "contact_id", "contact_name")


def _document(**fields: Column) -> Column:
    """A document in the form that all kinds share."""
    return F.struct(*[fields.get(f, F.lit(None).cast("string")).alias(f) for f in _DOCUMENT])


def _xero_invoice(d: Column) -> Column:
    return _document(invoice_id=d["InvoiceID"], type=d["Type"], status=d["Status"], amount=d["Total"], date=d["Date"], currency=d["CurrencyCode"],
                     contact_id=d["Contact"]["ContactID"], contact_name=d["Contact"]["Name"])


def _xero_payment(d: Column) -> Column:
    """The contact comes from the invoice, else from the payment."""
    of_invoice = d["Invoice"]["Contact"]
    has = of_invoice["ContactID"].isNotNull() | of_invoice["Name"].isNotNull()
    contact = lambda f: F.when(has, of_invoice[f]).otherwise(d["Contact"][f])
    return _document(invoice_id=d["Invoice"]["InvoiceID"], payment_id=d["PaymentID"], type=d["Invoice"]["Type"], status=d["Status"], amount=d["Amount"],
                     date=d["Date"], currency=d["CurrencyCode"], contact_id=contact("ContactID"), contact_name=contact("Name"))


def _qbo_invoice(d: Column) -> Column:
    return _document(invoice_id=d["Id"], amount=d["TotalAmt"], date=d["TxnDate"], currency=d["CurrencyRef"]["value"],
                     contact_id=d["CustomerRef"]["value"], contact_name=d["CustomerRef"]["name"])


def _qbo_payment(d: Column) -> Column:
    return _document(invoice_id=first_linked_invoice(d["Line"]), payment_id=d["Id"], amount=d["TotalAmt"], date=d["TxnDate"],
                     currency=d["CurrencyRef"]["value"], contact_id=d["CustomerRef"]["value"], contact_name=d["CustomerRef"]["name"])


def _is(provider: str, kind: str) -> Column:
    return F.col("provider").eqNullSafe(provider) & F.col("kind").eqNullSafe(kind)


def page_documents(pages: DataFrame) -> DataFrame:
    """A2-A5: provider, tenant_id, kind, page_no, known, malformed, docs (array, in the shared form) of every page, from one parse.

    A page is malformed if it is no JSON object or its document field is something else than documents; a page
    whose field is absent or null has no documents and is well formed; a page of another provider or kind is not known.
    """
    parsed = pages.select("provider", "tenant_id", "kind", "page_no", "body", F.from_json("body", PAGE).alias("p"))
    listed = F.from_json(F.when(F.col("kind") == "invoices", F.col("p.QueryResponse.Invoice")).otherwise(F.col("p.QueryResponse.Payment")), QBO_DOCUMENTS)
    docs = (F.when(_is("xero", "invoices"), F.transform("p.Invoices", _xero_invoice))
            .when(_is("xero", "payments"), F.transform("p.Payments", _xero_payment))
            .when(_is("quickbooks", "invoices"), F.transform(listed, _qbo_invoice))
            .when(_is("quickbooks", "payments"), F.transform(listed, _qbo_payment)))
    path = (F.when(_is("xero", "invoices"), F.lit("$.Invoices")).when(_is("xero", "payments"), F.lit("$.Payments"))
            .when(_is("quickbooks", "invoices"), F.lit("$.QueryResponse.Invoice")).when(_is("quickbooks", "payments"), F.lit("$.QueryResponse.Payment")))
    whole = F.try_parse_json("body")
    is_object = F.coalesce(F.startswith(F.schema_of_variant(whole), F.lit("OBJECT")), F.lit(False))
    # only pages without documents are looked at a second time
    bad = F.when(F.col("docs").isNull() & F.col("known"), ~is_object | F.try_variant_get(whole, path, "string").isNotNull()).otherwise(F.lit(False))
    return (parsed.withColumn("docs", docs).withColumn("known", path.isNotNull()).withColumn("malformed", bad)
            .select("provider", "tenant_id", "kind", "page_no", "known", "malformed", "docs"))


def document_lines(pages: DataFrame) -> DataFrame:
    """One row per document of every page, with the reason why it is no line; a page that gives no documents for a fault is one row."""
    known, xero, invoice = F.col("known"), F.col("xero"), F.col("invoice")
    # what holds for a whole page is found once per page
    found = page_documents(pages).withColumns({"xero": F.col("provider") == "xero", "invoice": F.col("kind") == "invoices"})
    found = found.withColumn("basis", F.when(known, F.when(invoice, "accrual").otherwise("cash")))
    of_page = {"line_kind": F.when(known, F.when(xero & invoice, "invoice_total").when(xero, "invoice_payment").when(invoice, "qbo_invoice").otherwise("qbo_payment")),
               "key_head": F.when(known, F.concat_ws(":", F.when(xero, "xero").otherwise("qbo"), "tenant_id", "basis", F.when(invoice, "invoice").otherwise("payment")))}
    rows = (found.withColumns(of_page).select("provider", "tenant_id", "page_no", "known", "malformed", "xero", "invoice", "basis", *of_page,
                                              F.posexplode_outer("docs").alias("pos", "d"))
            .filter(F.col("d").isNotNull() | F.col("malformed") | ~known))
    # what several columns need is a column first, each from the one before: named twice in one select, a date is parsed at every mention
    rows = rows.withColumns({"epoch_text": F.when(xero, epoch_text(F.col("d.date"))), "amount": _amount(F.col("d.amount")),
                             "own_id": F.when(invoice, F.col("d.invoice_id")).otherwise(F.col("d.payment_id"))})
    rows = rows.withColumn("epoch", F.col("epoch_text").try_cast("bigint"))
    rows = rows.withColumn("posted_date", F.when(F.col("epoch_text").isNotNull(), date_of_epoch(F.col("epoch"))).otherwise(iso_prefix_date(F.col("d.date"))))
    status = F.upper(F.coalesce(F.col("d.status"), F.lit("")))
    kind_type = F.col("d.type")
    of_invoice = (F.when(F.coalesce(kind_type, F.lit("")) != "ACCREC", "not_receivable").when(status.isin(*XERO_SKIP_INVOICE_STATUS), "voided_or_draft")
                  .when(~status.isin(*XERO_POSTED_INVOICE_STATUS), "status_not_posted"))
    of_payment = (F.when(status.isin(*XERO_SKIP_PAYMENT_STATUS), "voided").when(_nonempty(kind_type) & (kind_type != "ACCREC"), "not_receivable")
                  .when(~_nonempty(F.col("d.invoice_id")), "missing_invoice"))
    rows = rows.withColumn("of_xero", F.when(xero, F.when(invoice, of_invoice).otherwise(of_payment)))
    of_date = F.when(F.col("posted_date").isNull(), F.when(F.col("epoch_text").isNotNull(), "date_out_of_range").otherwise("bad_date"))
    reason = (F.when(~known, "unknown_kind").when(F.col("malformed"), "malformed_page").when(F.col("of_xero").isNotNull(), F.col("of_xero"))
              .when(~_nonempty(F.col("own_id")), "missing_id").when(F.col("d.amount").isNull(), "missing_amount").when(F.col("amount").isNull(), "bad_amount").otherwise(of_date))
    # a page of an unknown kind has no document: its fields are NULL
    return rows.select("tenant_id", "page_no", "pos", "provider", "basis", "line_kind", F.col("d.invoice_id").alias("external_invoice_id"),
                       F.col("d.payment_id").alias("external_payment_id"), F.nullif(F.col("d.contact_id"), F.lit("")).alias("external_contact_id"),
                       F.col("d.contact_name").alias("contact_name"), "amount", F.when(known, _currency(F.col("d.currency"))).alias("currency"), "posted_date",
                       F.when(known, F.concat_ws(":", "key_head", "own_id")).alias("idempotency_key"), reason.alias("reject_reason"))


def with_companies(docs: DataFrame, connections: DataFrame) -> DataFrame:
    """Documents with the company and connection of their tenant; one without is rejected."""
    conn = connections.select(F.col("id").alias("connection_id"), "company_id",
                              F.col("service_name").alias("provider"),
                              F.coalesce("tenant_id", "realm_id").alias("tenant_id"))
    j = docs.join(conn, ["provider", "tenant_id"], "left")
    reason = F.coalesce(F.col("reject_reason"), F.when(F.col("company_id").isNull(), F.lit("no_connection")))
    return j.withColumn("reject_reason", reason)


def normalised_documents(pages: DataFrame, connections: DataFrame) -> DataFrame:
    """G1 + tenant resolution: every document of every page, accepted or not, with company and connection."""
    return with_companies(document_lines(pages), connections)


def _with_leads(lines: DataFrame, links: DataFrame) -> DataFrame:
    """The lead of (company, provider, contact) beside each line, and all leads as a list where there are several."""
    key = ["company_id", "provider", "external_contact_id"]
    lk = links.groupBy(*key).agg(F.collect_list(F.struct("lead_id")).alias("_all"))
    lk = lk.select(*key, F.lit(0).cast("long").alias("_salt"), F.col("_all")[0]["lead_id"].alias("_lead"), F.when(F.size("_all") > 1, F.col("_all")).alias("_leads"))
    # lines without a contact share one key that cannot match: the salt spreads them, so the lines are made once for both
    salt = F.when(F.col("external_contact_id").isNull(), F.xxhash64("idempotency_key")).otherwise(F.lit(0).cast("long"))
    return lines.withColumn("_salt", salt).join(lk, [*key, "_salt"], "left").drop("_salt")


def _one_per_lead(lines: DataFrame) -> DataFrame:
    """A line for each of its leads; one with NULL if it has none."""
    leads = F.coalesce("_leads", F.array(F.struct(F.col("_lead").alias("lead_id"))))
    return lines.select(*[c for c in lines.columns if c not in ("_lead", "_leads")], F.explode(leads).alias("_one")).select("*", "_one.lead_id").drop("_one")


def resolve_leads(lines: DataFrame, links: DataFrame) -> DataFrame:
    """Lead of (company, provider, contact); no contact -> NULL lead."""
    return _one_per_lead(_with_leads(lines, links))


def accepted_lines(docs: DataFrame, links: DataFrame) -> DataFrame:
    """J5 (batch part): accepted documents, one per (company, idempotency key), last delivery wins.

    Leads are looked up first, so that the lines come out partitioned by their key and an upsert by it need not shuffle them again.
    """
    ok = _with_leads(docs.filter(F.col("reject_reason").isNull()), links)
    order = F.struct("page_no", "pos")
    # keys hardly repeat: whole rows are sorted once, behind the shuffle, not also before it for a partial aggregate that merges nothing
    latest = ok.repartition("company_id", "idempotency_key").groupBy("company_id", "idempotency_key").agg(
        F.max_by(F.struct(*[c for c in LINE_COLUMNS if c not in ("company_id", "idempotency_key")], "_lead", "_leads"), order).alias("l"))
    return _one_per_lead(latest.select("company_id", "idempotency_key", "l.*"))


def lines_output(lines: DataFrame) -> DataFrame:
    return lines.select(*[dbl(c).alias(c) if c == "amount" else F.col(c) for c in LINE_COLUMNS], "lead_id")


def reject_report(docs: DataFrame) -> DataFrame:
    """Documents dropped by the acceptance rules, counted by provider, basis and reason."""
    r = docs.filter(F.col("reject_reason").isNotNull())
    return r.groupBy("provider", "basis", "reject_reason").agg(F.count(F.lit(1)).alias("documents"))


def sync_counts(docs: DataFrame) -> DataFrame:
    """Rows upserted per company x provider x basis (every accepted document counts)."""
    ok = docs.filter(F.col("reject_reason").isNull())
    return ok.groupBy("company_id", "provider", "basis").agg(F.count(F.lit(1)).alias("rows_upserted"))
