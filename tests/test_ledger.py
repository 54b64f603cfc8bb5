"""Ledger payload rules (FIXTURES section 3/4) on handwritten JSON pages."""

import datetime as dt

from pyspark.sql import functions as F

from cashcurve.operators import ledger as lg

PAGES = "provider string, tenant_id string, kind string, page_no long, body string"


def _pages(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def test_xero_date_forms(spark):
    df = spark.createDataFrame([("/Date(-1)/",), ("/Date(1735689600000+0100)/",), ("",), (None,),
                                ("/Date(1735689600000)/trailing",), ("2024-02-30",), ("2024-02-03T10:00:00",),
                                ("  /Date(86400000)/",)], "v string")
    got = [r.d for r in df.select(lg.xero_date(F.col("v")).alias("d")).collect()]
    assert got == [dt.date(1969, 12, 31), dt.date(2025, 1, 1), None, None, dt.date(2025, 1, 1), None,
                   dt.date(2024, 2, 3), dt.date(1970, 1, 2)]


def test_invoice_rules_and_rejects(spark):
    inv = ('{"Invoices":['
           '{"InvoiceID":"A","Type":"ACCREC","Status":"authorised","Total":10.5,"Date":"/Date(1735689600000)/",'
           '"Contact":{"ContactID":"C1","Name":"N"}},'
           '{"InvoiceID":"B","Type":"ACCPAY","Status":"PAID","Total":1,"Date":"2024-01-01"},'
           '{"InvoiceID":"C","Type":"ACCREC","Status":"DRAFT","Total":1,"Date":"2024-01-01"},'
           '{"InvoiceID":"D","Type":"ACCREC","Status":"PAID","Total":1,"Date":"2024-13-01","CurrencyCode":"usd"},'
           '{"InvoiceID":"","Type":"ACCREC","Status":"PAID","Total":1,"Date":"2024-01-01"},'
           '{"InvoiceID":"F","Type":"ACCREC","Status":"PAID","Date":"2024-01-01"}]}')
    qbo_obj = ('{"QueryResponse":{"Payment":{"Id":"P1","TotalAmt":"5","TxnDate":"2024-03-04",'
               '"CustomerRef":{"value":"C2"},"CurrencyRef":{"value":"eur"},'
               '"Line":[{"LinkedTxn":[{"TxnId":"9","TxnType":"CreditMemo"}]},{"LinkedTxn":[{"TxnId":"7","TxnType":"Invoice"}]}]}}}')
    qbo_list = ('{"QueryResponse":{"Invoice":[{"Id":"I1","TotalAmt":3,"TxnDate":"2024-03-04"},'
                '{"Id":"I2","TotalAmt":4,"TxnDate":"bad"}]}}')
    pages = _pages(spark, [("xero", "T1", "invoices", 0, inv), ("quickbooks", "T1", "payments", 0, qbo_obj),
                           ("quickbooks", "T1", "invoices", 1, qbo_list)])
    conns = spark.createDataFrame([(2, 1, "xero", "T1", None), (3, 1, "quickbooks", None, "T1")],
                                  "id int, company_id int, service_name string, tenant_id string, realm_id string")
    docs = lg.normalised_documents(pages, conns)
    reasons = {(r.external_payment_id if r.basis == "cash" else r.external_invoice_id): r.reject_reason
               for r in docs.collect()}
    assert reasons == {"A": None, "B": "not_receivable", "C": "voided_or_draft", "D": "bad_date",
                       "": "missing_id", "F": "missing_amount", "P1": None, "I1": None, "I2": "bad_date"}
    links = spark.createDataFrame([(1, 1, 42, "xero", "C1")],
                                  "id long, company_id int, lead_id long, provider string, external_contact_id string")
    lines = {r.idempotency_key: r for r in lg.accepted_lines(docs, links).collect()}
    a = lines["xero:T1:accrual:invoice:A"]
    assert (float(a.amount), a.currency, a.posted_date, a.lead_id, a.connection_id) == (
        10.5, "GBP", dt.date(2025, 1, 1), 42, 2)
    p = lines["qbo:T1:cash:payment:P1"]
    assert (p.external_invoice_id, p.currency, p.lead_id) == ("7", "EUR", None)   # first *invoice* link
    # accepted + rejected = input
    rej = lg.reject_report(docs).agg(F.sum("documents")).first()[0]
    assert rej + lg.sync_counts(docs).agg(F.sum("rows_upserted")).first()[0] == docs.count()


def test_last_delivery_wins_within_a_batch(spark):
    p1 = '{"Invoices":[{"InvoiceID":"A","Type":"ACCREC","Status":"PAID","Total":1,"Date":"2024-01-01"}]}'
    p2 = '{"Invoices":[{"InvoiceID":"A","Type":"ACCREC","Status":"PAID","Total":2,"Date":"2024-01-02"}]}'
    pages = _pages(spark, [("xero", "T1", "invoices", 0, p1), ("xero", "T1", "invoices", 1, p2)])
    conns = spark.createDataFrame([(2, 1, "xero", "T1", None)],
                                  "id int, company_id int, service_name string, tenant_id string, realm_id string")
    links = spark.createDataFrame([], "id long, company_id int, lead_id long, provider string, external_contact_id string")
    out = lg.accepted_lines(lg.normalised_documents(pages, conns), links).collect()
    assert len(out) == 1 and float(out[0].amount) == 2.0 and out[0].posted_date == dt.date(2024, 1, 2)


def test_missing_contact_payment_fallback_and_voided_later(spark):
    from cashcurve.operators import upsert as up
    conns = spark.createDataFrame([(2, 1, "xero", "T1", None)],
                                  "id int, company_id int, service_name string, tenant_id string, realm_id string")
    links = spark.createDataFrame([(1, 1, 42, "xero", "C9")],
                                  "id long, company_id int, lead_id long, provider string, external_contact_id string")
    first = ('{"Invoices":[{"InvoiceID":"A","Type":"ACCREC","Status":"PAID","Total":5,"Date":"2024-01-01"}]}')
    pays = ('{"Payments":[{"PaymentID":"P","Status":"AUTHORISED","Amount":5,"Date":"2024-01-02",'
            '"Invoice":{"InvoiceID":"A"},"Contact":{"ContactID":"C9","Name":"Payer"}}]}')
    pages = _pages(spark, [("xero", "T1", "invoices", 0, first), ("xero", "T1", "payments", 0, pays)])
    base = lg.accepted_lines(lg.normalised_documents(pages, conns), links)
    got = {r.line_kind: r for r in base.collect()}
    assert got["invoice_total"].external_contact_id is None and got["invoice_total"].lead_id is None
    assert got["invoice_payment"].external_contact_id == "C9" and got["invoice_payment"].lead_id == 42
    # the invoice is voided later: the re-sync skips it and the stored line stays as it was
    voided = first.replace('"PAID"', '"VOIDED"').replace('"Total":5', '"Total":7')
    delta = lg.accepted_lines(lg.normalised_documents(_pages(spark, [("xero", "T1", "invoices", 0, voided)]), conns),
                              links)
    assert delta.count() == 0
    after = up.upsert(base, delta, ["company_id", "idempotency_key"], replace=["amount"])
    assert {r.idempotency_key: float(r.amount) for r in after.collect()}["xero:T1:accrual:invoice:A"] == 5.0


def test_no_page_and_no_document_is_lost(spark):
    good = '{"Invoices":[{"InvoiceID":"A","Type":"ACCREC","Status":"PAID","Total":1,"Date":"2024-01-01"}]}'
    pages = _pages(spark, [
        ("xero", "T1", "invoices", 0, good), ("xero", "T1", "invoices", 1, good.replace('"A"', '"B"')[:-2]),      # no closing brace
        ("xero", "T1", "invoices", 2, '{"Invoices":"none"}'), ("xero", "T1", "payments", 3, '[1, 2]'),
        ("xero", "T1", "invoices", 4, '{"Invoices":[]}'), ("xero", "T1", "invoices", 5, '{}'), ("xero", "T1", "payments", 6, None),
        ("quickbooks", "T1", "invoices", 7, '{"QueryResponse":{"Invoice":"x"}}'), ("quickbooks", "T1", "payments", 8, '{"QueryResponse":{}}'),
        ("sage", "T1", "invoices", 9, good), ("xero", "T1", "bills", 10, good), (None, "T1", None, 11, good)])
    conns = spark.createDataFrame([(2, 1, "xero", "T1", None), (3, 1, "quickbooks", None, "T1")],
                                  "id int, company_id int, service_name string, tenant_id string, realm_id string")
    docs = lg.normalised_documents(pages, conns).collect()
    assert {r.page_no: r.reject_reason for r in docs} == {
        0: None, 1: "malformed_page", 2: "malformed_page", 3: "malformed_page", 6: "malformed_page", 7: "malformed_page",
        9: "unknown_kind", 10: "unknown_kind", 11: "unknown_kind"}           # 4, 5, 8: valid pages without documents


def test_extreme_dates_are_rejected_not_fatal(spark):
    inv = ('{"Invoices":[' + ",".join(
        f'{{"InvoiceID":"{k}","Type":"ACCREC","Status":"PAID","Total":1,"Date":"{d}"}}' for k, d in (
            ("min", "/Date(-9223372036854775808)/"), ("max", "/Date(9223372036854775807)/"), ("huge", "/Date(99999999999999999999999)/"),
            ("old", "/Date(-99999999999999)/"), ("no", "soon"), ("ok", "/Date(0)/"))) + "]}")
    conns = spark.createDataFrame([(2, 1, "xero", "T1", None)], "id int, company_id int, service_name string, tenant_id string, realm_id string")
    got = {r.external_invoice_id: r.reject_reason for r in lg.normalised_documents(_pages(spark, [("xero", "T1", "invoices", 0, inv)]), conns).collect()}
    assert got == {"min": "date_out_of_range", "max": "date_out_of_range", "huge": "date_out_of_range", "old": "date_out_of_range",
                   "no": "bad_date", "ok": None}
