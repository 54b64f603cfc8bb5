"""Continuous ledger ingest with Structured Streaming.

Landed provider pages (JSON lines: provider, tenant_id, kind, page_no, body)
arrive as files.  ``readStream`` picks them up; every micro-batch runs the same
normalisation as the batch job (L1-L5, G1, C6) and upserts the accepted lines
into a snapshot table (J5) keyed by (company_id, idempotency_key):

* a micro-batch has two outputs, each a folder of its ``batch_id``: all its documents by outcome (``outcomes``, the rejected ones are the
  stream's dead letters) and its accepted lines (``changes`` of a ``BatchTable``), which readers fold, so a batch costs what it
  changes, also for a tenant that holds a third of all lines;
* the lines come last and make the batch count: when Spark re-runs a micro-batch after a failure (at-least-once ``foreachBatch``), a whole
  one is skipped and a broken one replaces both its folders -- a redelivered document changes nothing but ``synced_at``;
* connections and contact links are read inside every micro-batch, so tenants and links added while the
  stream runs count from the next batch on;
* the stream checkpoint lives next to the snapshot, so a restarted query
  resumes from the last committed offsets.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cashcurve.operators import ledger as lg
from cashcurve.operators.sync import full_sync
from cashcurve.sources.batches import BatchTable

PAGE_SCHEMA = StructType([
    StructField("provider", StringType()), StructField("tenant_id", StringType()),
    StructField("kind", StringType()), StructField("page_no", LongType()), StructField("body", StringType()),
])
REPLACED_ON_CONFLICT = ["amount", "posted_date", "contact_name", "currency", "external_invoice_id",
                        "external_payment_id", "external_contact_id", "synced_at"]


class LedgerSink:
    """foreachBatch target: sync one micro-batch of pages into the folders of its batch.

    ``connections`` and ``links`` are functions that return the tables as they are now.
    """

    def __init__(self, spark: SparkSession, root: str, connections: Callable[[], DataFrame], links: Callable[[], DataFrame]):
        self.spark, self.root = spark, root
        self.table = BatchTable(spark, root, ["company_id", "idempotency_key"], REPLACED_ON_CONFLICT)
        self.connections = connections
        self.links = links

    def _outcomes(self, batch_id: int) -> str:
        return f"{self.root}/outcomes/batch_id={batch_id:010d}"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self.table.applied(batch_id):
            return                                           # replayed micro-batch: already there
        synced = full_sync(batch, self.connections(), self.links(), self._outcomes(batch_id))
        self.table.write(batch_id, synced.lines.withColumn("synced_at", F.current_timestamp()))

    def documents(self) -> DataFrame | None:
        """Every document of the applied batches with its outcome and batch_id; None before the first."""
        paths = [self._outcomes(b) for b in self.table.batches()]
        if not paths:
            return None
        schema = lg.normalised_documents(self.spark.createDataFrame([], PAGE_SCHEMA), self.connections()).schema
        return (self.spark.read.schema(schema.add("batch_id", "long").add("outcome", "string")).option("basePath", f"{self.root}/outcomes").parquet(*paths))

    def rejects(self) -> DataFrame | None:
        """Dead letters: the documents that no batch accepted."""
        docs = self.documents()
        return None if docs is None else docs.filter(F.col("outcome") != "accepted")


def start_ingest(spark: SparkSession, landing_glob: str, root: str, connections: Callable[[], DataFrame],
                 links: Callable[[], DataFrame], files_per_trigger: int = 2, available_now: bool = True):
    """Start the streaming ingest; returns (StreamingQuery, LedgerSink)."""
    sink = LedgerSink(spark, root, connections, links)
    pages = (spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
             .json(landing_glob))
    w = pages.writeStream.foreachBatch(sink).option("checkpointLocation", os.path.join(root, "_stream_checkpoint"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start(), sink


def land_pages(pages: DataFrame, landing_root: str, arrivals: int, files_per_arrival: int = 2) -> str:
    """Write pages as ``arrivals`` successive drops of compressed JSON-lines files; returns the glob to stream from."""
    for a in range(arrivals):
        part = pages.filter(F.pmod(F.col("page_no"), F.lit(arrivals)) == a)
        part.coalesce(files_per_arrival).write.mode("overwrite").option("compression", "gzip").json(
            os.path.join(landing_root, f"arrival_{a:04d}"))
    return os.path.join(landing_root, "arrival_*")
