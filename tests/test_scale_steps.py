"""Steps that large tables pass once: no second sort, sample or text on the way, and no file per response."""

import os
import uuid

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashcurve.operators import ledger as lg
from cashcurve.operators import upsert as up
from cashcurve.session import checkpoint_dir, partitioned_by_part_of_key, setting, sorted_groups, unsorted_partitions
from cashcurve.sources.ledger_pages import landed_pages
from cashcurve.sources.model import ModelTables
from cashcurve.sources.page_files import read_page_files, write_page_files
from cashcurve.sources.stored import StoredTables

SF_SMALL = "/root/testdata/sf0.001"
PAGES = "provider string, tenant_id string, kind string, page_no bigint, body string"
CONNECTIONS = "id long, company_id int, service_name string, tenant_id string, realm_id string"
LINKS = "company_id int, provider string, external_contact_id string, lead_id long"


def _plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _folder(spark):
    return os.path.join(checkpoint_dir(spark), "scale", uuid.uuid4().hex)


def test_raw_responses_share_archives_and_single_files_are_still_read(spark):
    docs = spark.range(2000).select(F.lit("xero").alias("provider"), F.lit("invoices").alias("kind"), F.concat(F.lit("T ü+"), (F.col("id") % 2).cast("string")).alias("tenant_id"),
                                    (-F.col("id")).alias("doc_order"), F.col("id").alias("k"))
    root = _folder(spark)
    write_page_files(docs, root, F.concat(F.lit('{"InvoiceID":"'), F.col("k").cast("string"), F.lit('"}')))
    assert not [d for d, _, _ in os.walk(root) if "page=" in d]
    single = f"{root}/provider=xero/kind=payments/tenant_id=T9/page=7"
    os.makedirs(single)
    with open(f"{single}/response.json", "w") as f:
        f.write('{"Payments":[]}')
    pages = read_page_files(spark, root)
    one = pages.filter("kind = 'payments'").collect()
    assert [(r.tenant_id, r.page_no, r.body) for r in one] == [("T9", 7, '{"Payments":[]}')]
    ids = pages.filter("kind = 'invoices'").select("page_no", F.posexplode(F.from_json("body", lg.PAGE)["Invoices"])).collect()
    assert sorted((r.page_no - 1) * 100 + r.pos for r in ids) == sorted([*range(1000), *range(1000)])
    assert {int(r.col.InvoiceID) // 2 + (r.page_no - 1) * 100 + r.pos for r in ids} == {999}             # in the order of doc_order


def test_documents_are_written_where_their_page_is(spark):
    plan = landed_pages(ModelTables(spark, SF_SMALL, stored=False))._jdf.queryExecution().analyzed().toString()
    assert plan.count("RepartitionByExpression") == 2 and "to_json" in plan and "to_json" not in plan.split("RepartitionByExpression")[-1]


def test_a_date_is_parsed_once(spark):
    page = '{"Invoices":[{"InvoiceID":"A","Type":"ACCREC","Status":"PAID","Total":"1","Date":"%s","Contact":{"ContactID":"C"}}]}'
    dates = ["/Date(0+0100)/", "/Date(99999999999999999999)/", "2024-02-30", "2024-02-29T10:00:00", "0999-01-01", "", "2025-13-01", " 2024-01-01"]
    pages = spark.createDataFrame([("xero", "T1", "invoices", i, page % d) for i, d in enumerate(dates)], PAGES)
    lines = lg.document_lines(pages)
    assert _plan(lines).count("regexp_extract") <= 2                            # the same match may stand in a NULLIF twice
    got = [(str(r.posted_date), r.reject_reason) for r in lines.orderBy("page_no").collect()]
    assert got == [("1970-01-01", None), ("None", "date_out_of_range"), ("None", "bad_date"), ("2024-02-29", None), ("0999-01-01", None), ("None", "bad_date"),
                   ("None", "bad_date"), ("None", "bad_date")]


@pytest.mark.parametrize("step", ["lines", "upsert"])
def test_rows_are_sorted_once_behind_the_shuffle(spark, step):
    if step == "lines":
        docs = lg.normalised_documents(spark.createDataFrame([], PAGES).union(spark.createDataFrame([("xero", "T1", "invoices", 1, "{}")], PAGES)), spark.createDataFrame([], CONNECTIONS))
        plan = _plan(lg.accepted_lines(docs, spark.createDataFrame([], LINKS)))
    else:
        rows = spark.range(10).select("id", F.col("id").cast("string").alias("v"))
        plan = _plan(up.upsert(rows, rows, ["id"], replace=["v"]))
    assert "SortAggregate" not in plan[plan.rindex("Exchange hashpartitioning("):] or "LocalTableScan <empty>" in plan


def test_lines_without_contact_are_made_once(spark):
    lines = spark.range(4).select(F.lit(1).alias("company_id"), F.lit("xero").alias("provider"), F.when(F.col("id") > 1, F.concat(F.lit("C"), F.col("id").cast("string"))).alias("external_contact_id"),
                                  F.col("id").cast("string").alias("idempotency_key"))
    links = spark.createDataFrame([(1, "xero", "C2", 7), (1, "xero", "C2", 8), (1, "xero", None, 9)], LINKS)
    out = lg.resolve_leads(lines, links)
    assert _plan(out).count("Range (") == 1
    assert sorted((r.idempotency_key, r.lead_id) for r in out.collect() if r.lead_id) == [("2", 7), ("2", 8)] and out.count() == 5


def test_stored_tables_are_made_once_not_for_a_sample_too(spark, monkeypatch):
    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda *a: pytest.fail("a range partitioning runs the derivation for its sample"))
    for cls in {type(spark.range(1))}:
        monkeypatch.setattr(cls, "repartitionByRange", lambda *a: pytest.fail("a range partitioning runs the derivation for its sample"))
    m = ModelTables(spark, SF_SMALL)
    m.__dict__["source_digest"] = uuid.uuid4().hex[:12]
    stored, pure = m.forecast_entries, ModelTables(spark, SF_SMALL, stored=False).forecast_entries
    assert stored.columns == pure.columns and stored.exceptAll(pure).count() == 0 and stored.count() == pure.count()


def test_the_writer_setting_comes_back(spark):
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    with pytest.raises(KeyError), unsorted_partitions(spark):
        assert spark.conf.get(key) == "32"
        raise KeyError
    assert spark.conf.get(key, None) == before


def test_facts_of_pages_are_shuffled_once(spark):
    m = ModelTables(spark, SF_SMALL)
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"), partitioned_by_part_of_key(spark), sorted_groups(spark):
        plan = _plan(landed_pages(m))
    assert plan.count("Exchange hashpartitioning(") == 3 and "ObjectHashAggregate" not in plan          # invoices, lines and the lines' orders


def test_lines_come_out_partitioned_by_their_key(spark):
    page = '{"Invoices":[%s]}' % ",".join('{"InvoiceID":"%s","Type":"ACCREC","Status":"PAID","Total":"1","Date":"2024-01-01","Contact":{"ContactID":"%s"}}' % d
                                          for d in [("A", "C1"), ("B", "C2"), ("D", ""), ("E", "C4"), ("A", "C3")])
    docs = lg.normalised_documents(spark.createDataFrame([("xero", "T1", "invoices", 1, page)], PAGES), spark.createDataFrame([(5, 1, "xero", "T1", None)], CONNECTIONS))
    links = spark.createDataFrame([(1, "xero", "C1", 6), (1, "xero", "C2", 7), (1, "xero", "C2", 8), (1, "xero", "C2", None), (1, "xero", "C3", 9), (1, "xero", None, 10)], LINKS)
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        lines = lg.accepted_lines(docs, links)
        plan = _plan(lines)
        assert plan[plan.index("Exchange hashpartitioning("):].startswith("Exchange hashpartitioning(company_id") and "idempotency_key" in plan[plan.index("Exchange hashpartitioning("):].split(")")[0]
        got = sorted((r.idempotency_key[-1], r.lead_id or 0) for r in lines.collect())
        again = up.upsert(lines, lines, ["company_id", "idempotency_key"], replace=["amount"])
        assert _plan(again).count("Exchange hashpartitioning(company_id") == 2 * plan.count("Exchange hashpartitioning(company_id")
    assert got == [("A", 9), ("B", 0), ("B", 7), ("B", 8), ("D", 0), ("E", 0)]


def test_a_table_that_only_lost_keys_is_read_without_sorting_rows(spark):
    root = _folder(spark)
    spark.range(6).selectExpr("id", "cast(1 as int) company_id", "'n' name").write.parquet(f"{root}/products.parquet")
    t = StoredTables(spark, root)
    t.delete("products", spark.range(2))
    assert "SortAggregate" not in _plan(t.products) and sorted(r.id for r in t.products.collect()) == [2, 3, 4, 5]
