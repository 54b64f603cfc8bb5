"""Full sync in one pass, raw page files and their gaps, dead letters of the stream."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from cashcurve.operators import ledger as lg
from cashcurve.operators.sync import full_sync
from cashcurve.session import checkpoint_dir
from cashcurve.sources.page_files import page_gaps, read_page_files, write_page_files
from cashcurve.streaming.ingest import LedgerSink

PAGES = "provider string, tenant_id string, kind string, page_no long, body string"
INVOICE = '{{"InvoiceID":"{}","Type":"{}","Status":"PAID","Total":{},"Date":"2024-01-01"}}'


def _folder(spark):
    return os.path.join(checkpoint_dir(spark), "test-sync", uuid.uuid4().hex)


def _page(n, *docs, tenant="T1", provider="xero"):
    return (provider, tenant, "invoices", n, '{"Invoices":[' + ",".join(docs) + "]}")


@pytest.fixture(scope="module")
def tables(spark):
    conns = spark.createDataFrame([(2, 1, "xero", "T1", None), (4, 2, "xero", "T2", None)],
                                  "id int, company_id int, service_name string, tenant_id string, realm_id string")
    links = spark.createDataFrame([], "id long, company_id int, lead_id long, provider string, external_contact_id string")
    return conns, links


def test_landed_equals_accepted_and_rejected_and_pages_are_parsed_once(spark, tables):
    pages = spark.createDataFrame([
        _page(1, INVOICE.format("A", "ACCREC", 1), INVOICE.format("B", "ACCPAY", 2)), _page(2, INVOICE.format("A", "ACCREC", 3)),
        _page(1, INVOICE.format("C", "ACCREC", 4), tenant="T9"), ("xero", "T1", "invoices", 3, "{"), ("sage", "T1", "invoices", 1, "{}")], PAGES)
    s = full_sync(pages, *tables, _folder(spark))
    assert (s.landed, s.accepted, s.rejected) == (6, 2, 4)
    assert [(r.idempotency_key, float(r.amount)) for r in s.lines.collect()] == [("xero:T1:accrual:invoice:A", 3.0)]
    assert sorted(r.outcome for r in s.rejects.collect()) == ["malformed_page", "no_connection", "not_receivable", "unknown_kind"]
    got = {(r.company_id, r.provider, r.basis): (r.landed, r.accepted, r.rejected, r.lines, r.amount) for r in s.summary().collect()}
    assert got[1, "xero", "accrual"] == (4, 2, 2, 1, 3.0) and got[None, "xero", "accrual"] == (1, 0, 1, 0, None)
    assert sum(v[0] for v in got.values()) == 6
    # one scan and one parse of the pages; results read what was written, accepted lines only their directory
    parse = lg.normalised_documents(pages, tables[0])._jdf.queryExecution().optimizedPlan().toString()
    assert parse.count("LogicalRDD") + parse.count("LocalRelation") <= 2 and parse.count("from_json(JsonToStructs") <= 2 and "Union" not in parse
    plan = s.lines._jdf.queryExecution().executedPlan().toString()
    assert "from_json" not in plan and "PartitionFilters: [isnotnull(outcome" in plan


def test_doubled_tenants_are_an_error_and_an_empty_sync_is_not(spark, tables):
    pages = spark.createDataFrame([_page(1, INVOICE.format("A", "ACCREC", 1))], PAGES)
    with pytest.raises(ValueError, match="landed"):
        full_sync(pages, tables[0].unionByName(tables[0]), tables[1], _folder(spark))
    s = full_sync(pages.limit(0), *tables, _folder(spark))
    assert (s.landed, s.accepted, s.rejected) == (0, 0, 0) and s.lines.count() == 0 and s.summary().count() == 0


def test_raw_files_keep_body_and_feed_and_short_pages_end_a_run(spark):
    docs = spark.range(530).select(
        F.lit("xero").alias("provider"), F.lit("invoices").alias("kind"), F.when(F.col("id") < 330, "T 1+ü").otherwise("T2").alias("tenant_id"),
        F.col("id").alias("doc_order"), F.concat(F.lit('{"InvoiceID":"'), F.col("id").cast("string"), F.lit('"}')).alias("doc"))
    root = _folder(spark)
    write_page_files(docs, root)
    with open(os.path.join(root, "stray.txt"), "w") as f:
        f.write("{\n}")
    pages = read_page_files(spark, root)
    got = {(r.tenant_id, r.page_no): r.body for r in pages.collect()}
    assert set(got) == {("T 1+ü", k) for k in (1, 2, 3, 4)} | {("T2", 1), ("T2", 2), (None, None)}
    assert got["T 1+ü", 4].strip() == '{"Invoices":[' + ",".join(f'{{"InvoiceID":"{i}"}}' for i in range(300, 330)) + "]}"
    assert [(r.tenant_id, r.first_page, r.last_page, r.reason) for r in page_gaps(pages).collect()] == [("T2", 3, None, "open_end")]


def test_gaps_of_a_feed(spark):
    full = ",".join(INVOICE.format(i, "ACCREC", 1) for i in range(3))
    rows = [_page(n, full) for n in (2, 3, 7, 8)] + [_page(9, INVOICE.format("z", "ACCREC", 1)), _page(10, full), _page(12, full)]
    rows += [_page(1, INVOICE.format("y", "ACCREC", 1), tenant="T2"), _page(1, full, tenant="T3"), _page(1, full, tenant="T3"), _page(2, tenant="T3")]
    got = {(r.tenant_id, r.first_page, r.last_page, r.reason) for r in page_gaps(spark.createDataFrame(rows, PAGES), page_size=3).collect()}
    assert got == {("T1", 1, 1, "missing"), ("T1", 4, 6, "missing"), ("T1", 11, 11, "missing"), ("T1", 13, None, "open_end"), ("T1", 10, 10, "after_short_page")}
    assert page_gaps(spark.createDataFrame([], PAGES)).count() == 0


def test_a_batch_that_dies_between_its_outputs_is_whole_after_the_replay(spark, tables, monkeypatch):
    sink = LedgerSink(spark, _folder(spark), lambda: tables[0], lambda: tables[1])
    first = spark.createDataFrame([_page(1, INVOICE.format("A", "ACCREC", 1), INVOICE.format("B", "ACCPAY", 2))], PAGES)
    second = spark.createDataFrame([_page(2, INVOICE.format("A", "ACCREC", 5), INVOICE.format("C", "ACCPAY", 2)), ("xero", "T1", "invoices", 3, "[")], PAGES)
    assert sink.rejects() is None
    sink(first, 0)
    monkeypatch.setattr(sink.table, "write", lambda *a: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError):
        sink(second, 1)
    monkeypatch.undo()
    assert [float(r.amount) for r in sink.table.read().collect()] == [1.0] and sink.rejects().count() == 1     # nothing of the broken batch
    for _ in range(2):                                                                                          # Spark re-runs it, then once more
        sink(second, 1)
        assert [float(r.amount) for r in sink.table.read().collect()] == [5.0]
        assert sorted((r.batch_id, r.reject_reason) for r in sink.rejects().collect()) == [(0, "not_receivable"), (1, "malformed_page"), (1, "not_receivable")]
    assert sink.documents().count() == 5
