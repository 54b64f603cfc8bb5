"""A2-A5 from the providers' own raw JSON responses, and which pages are missing.

A fetcher leaves every response as it came, under ``provider=<p>/kind=<k>/tenant_id=<t>/page=<n>/``: as a file of its own, or, as
``write_page_files`` does, with many others in the archives (parquet) of the folder ``_archives``, whose records are a path and the response.
``read_page_files`` reads both and takes provider, kind, tenant and page from the path, so the ledger operators work on raw responses as on
landed tables.  A file per response costs a listing, an open and a task's share each; archives cost what their bytes cost.

A feed (provider, kind, tenant) is complete if its pages follow each other from 1 and the last one holds fewer documents than a full page:
that is how a fetcher knows that it has reached the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cashcurve.functions.grouped import numbered
from cashcurve.operators.ledger import page_documents
from cashcurve.sources.files import SharedFiles

PAGE_SIZE = 100                # fixed value: documents of a full page
LAYOUT = r"provider=([^/]+)/kind=([^/]+)/tenant_id=([^/]+)/page=([0-9]+)/"
ARCHIVES = "_archives"         # the underscore keeps it out of the listing of single files
FEED = ["provider", "kind", "tenant_id"]


def page_body(provider: Column, kind: Column, docs: Column) -> Column:
    """The response of a page of documents (JSON texts): provider 2 gives a single document as an object."""
    joined = F.array_join(docs, ",")
    field = F.when(kind == "invoices", "Invoice").otherwise("Payment")
    listed = F.when(F.size(docs) == 1, F.element_at(docs, 1)).otherwise(F.concat(F.lit("["), joined, F.lit("]")))
    return F.when(provider == "xero", F.concat(F.lit('{"'), field, F.lit('s":['), joined, F.lit("]}"))).otherwise(
        F.concat(F.lit('{"QueryResponse":{"'), field, F.lit('":'), listed, F.lit("}}")))


def _encoded(c: Column) -> Column:
    """A value as part of a path, as Spark's writer names folders."""
    return F.regexp_replace(F.url_encode(F.coalesce(F.nullif(c, F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__"))), r"\+", "%20")


def write_page_files(documents: DataFrame, root: str, doc: Column | None = None) -> None:
    """Write documents (feed columns, doc_order, doc) as a fetcher would: pages of PAGE_SIZE in order, many to an archive.

    ``doc``, if given, makes the text from the other columns, so that those travel instead of it.  Documents are numbered over range
    partitions, so a tenant with a third of all documents is no single task.
    """
    fields = [c for c in documents.columns if c not in FEED]
    text = F.col("doc") if doc is None else doc
    with numbered(documents.withColumn("feed", F.concat_ws("/", *FEED)), "feed", ["doc_order"], "n") as rows:
        key = [*FEED, "page"]
        paged = rows.select(*FEED, F.ceil(F.col("n") / PAGE_SIZE).cast("long").alias("page"), "n", *fields).repartition(*key)
        pages = paged.select(*key, "n", text.alias("doc")).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("n", "doc"))).alias("docs"))   # at most PAGE_SIZE
        body = page_body(F.col("provider"), F.col("kind"), F.transform("docs", lambda d: d["doc"]))
        path = F.concat(*[F.concat(F.lit(f"{k}="), _encoded(F.col(k).cast("string")), F.lit("/")) for k in key])
        pages.select(path.alias("path"), body.alias("body")).write.parquet(f"{root}/{ARCHIVES}")


def read_page_files(spark: SparkSession, root: str, layout: str = LAYOUT) -> DataFrame:
    """provider, tenant_id, kind, page_no, body of every raw response; a path that does not follow the layout gives NULLs (an unknown kind)."""
    files = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(root)
    raw = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    if SharedFiles(spark).exists(f"{root}/{ARCHIVES}"):
        raw = raw.unionByName(spark.read.schema("path string, body string").parquet(f"{root}/{ARCHIVES}"))
    path = F.try_url_decode(F.regexp_replace("path", r"\+", "%2B"))
    part = lambda k: F.nullif(F.regexp_extract(path, layout, k), F.lit(""))
    return raw.select(part(1).alias("provider"), part(3).alias("tenant_id"), part(2).alias("kind"), part(4).try_cast("bigint").alias("page_no"), "body")


def page_gaps(pages: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """Per fault of a feed: its columns, first_page, last_page, reason.

    ``missing``: pages first to last are not there, later ones are.  ``open_end``: the last page is full, so the pages from first on may be
    missing (last_page NULL).  ``after_short_page``: the page follows one that should have been the last.

    Every page speaks for itself and for the page after it; where only one of the two is there, a run of pages ends or begins.  Only those
    edges are sorted per feed, so the work does not depend on how long a feed is.
    """
    counted = page_documents(pages).filter("known").groupBy(*FEED, "page_no").agg(F.max(F.coalesce(F.size("docs"), F.lit(0))).alias("n"))
    page, n = F.col("page_no"), F.col("n")
    mark = lambda at, here, size: F.struct(at.cast("long").alias("page"), F.lit(here).alias("here"), F.lit(1 - here).alias("before"), size.cast("int").alias("n"))
    marks = F.array(mark(page, 1, F.lit(None)), mark(page + 1, 0, n), mark(F.lit(1), 0, F.lit(page_size)))     # page 1 is always expected
    met = counted.select(*FEED, F.explode(marks).alias("m")).groupBy(*FEED, F.col("m.page").alias("page")).agg(
        F.max("m.here").alias("here"), F.max("m.before").alias("before"), F.max("m.n").alias("n"))
    edges = met.filter("here != before").withColumn("next", F.lead("page").over(Window.partitionBy(*FEED).orderBy("page")))
    ends = edges.filter("before = 1").filter(F.col("next").isNotNull() | (F.col("n") >= page_size))
    gaps = ends.select(*FEED, F.col("page").alias("first_page"), (F.col("next") - 1).alias("last_page"),
                       F.when(F.col("next").isNull(), "open_end").otherwise("missing").alias("reason"))
    late = met.filter((F.col("here") == 1) & (F.col("before") == 1) & (F.col("n") < page_size)).select(
        *FEED, F.col("page").alias("first_page"), F.col("page").alias("last_page"), F.lit("after_short_page").alias("reason"))
    return gaps.unionByName(late)
