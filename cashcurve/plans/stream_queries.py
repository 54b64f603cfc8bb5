"""Query key for step 12 (streaming): N1 -- final snapshot of the streaming ingest."""

from __future__ import annotations

import os
import uuid

from cashcurve.operators import ledger as lg
from cashcurve.plans.ledger_queries import LEDGER_CTES, REJECTS_ORACLE
from cashcurve.plans.oracle_tables import with_tables
from cashcurve.plans.registry import register
from cashcurve.session import checkpoint_dir
from cashcurve.sources.files import SharedFiles
from cashcurve.sources.ledger_pages import LANDING_VERSION, landing_zone
from cashcurve.sources.model import ModelTables, ensure_stored
from cashcurve.streaming.ingest import PAGE_SCHEMA, land_pages, start_ingest

ARRIVALS = 3


@register("stream_ingest", oracle=with_tables(["lead_links"], """
    SELECT a.company_id, a.connection_id, a.provider, a.basis, a.line_kind, a.external_invoice_id,
           a.external_payment_id, a.external_contact_id, a.contact_name, CAST(a.amount AS DOUBLE) AS amount,
           a.currency, a.posted_date, a.idempotency_key, ll.lead_id
    FROM all_lines a LEFT JOIN lead_links ll
      ON ll.company_id = a.company_id AND ll.provider = a.provider AND ll.external_contact_id = a.external_contact_id
    """, LEDGER_CTES))
def q_stream_ingest(spark, sf_dir):
    """Land every page in three arrivals, stream them (availableNow) into the snapshot, return its final state.

    The state must equal the batch ingest (``ledger_lines``); ``synced_at`` is left out of the comparison.
    """
    return lg.lines_output(_streamed(spark, sf_dir)[0].table.read())


def _streamed(spark, sf_dir):
    """The sink after the whole stream, and the folder glob that it read."""
    m = ModelTables(spark, sf_dir)
    base = checkpoint_dir(spark)
    landing = os.path.join(base, "stream-landing", f"{LANDING_VERSION}-{m.source_digest}-{ARRIVALS}-gz")
    glob = os.path.join(landing, "arrival_*")
    # the arrivals are deterministic per source: land them once, stream them every run
    files = max(2, spark.sparkContext.defaultParallelism)
    ensure_stored(spark, landing, lambda path: land_pages(landing_zone(m), path, ARRIVALS, files))
    # an arrival is about one micro-batch, read by all cores
    files = max(1, sum(n.startswith("part-") for n in SharedFiles(spark).names(f"{landing}/arrival_0000")))
    root = os.path.join(base, f"stream-ingest-{uuid.uuid4().hex[:12]}")
    # read anew in every micro-batch, so tenants and links added meanwhile count
    q, sink = start_ingest(spark, glob, os.path.join(root, "snapshot"), lambda: ModelTables(spark, sf_dir).connections,
                           lambda: ModelTables(spark, sf_dir).lead_links, files_per_trigger=files)
    q.awaitTermination()
    return sink, glob


@register("stream_rejects", oracle=REJECTS_ORACLE)
def q_stream_rejects(spark, sf_dir):
    """Dead letters of the stream by provider, basis and reason, after its newest batch was delivered again: the batch job's rejects."""
    sink, glob = _streamed(spark, sf_dir)
    newest = max(sink.table.batches())
    sink(spark.read.schema(PAGE_SCHEMA).json(glob), newest)
    return lg.reject_report(sink.rejects())
