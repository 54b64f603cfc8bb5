"""A full sync as one job -- every page is parsed once, its documents are written once, and every count comes from that write.

The documents are written partitioned by their outcome (``accepted`` or the reject reason, L7), and observed on the way: how many
the pages hold (``landed``), and how many of those end up accepted or rejected after tenants are resolved.  A join that lost or
doubled documents would make the sums differ, and is an error.  Lines (J5, C6), counts (D15) and rejects read the written documents;
the accepted ones are a directory of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashcurve.functions.exprs import dbl
from cashcurve.operators import ledger as lg
from cashcurve.session import unsorted_partitions


@dataclass
class Sync:
    documents: DataFrame        # every document with its outcome
    links: DataFrame
    landed: int
    accepted: int
    rejected: int

    @property
    def accepted_documents(self) -> DataFrame:
        return self.documents.filter(F.col("outcome") == "accepted")

    @property
    def lines(self) -> DataFrame:
        """The lines to upsert: one per idempotency key, with its lead."""
        return lg.accepted_lines(self.accepted_documents, self.links)

    @property
    def rejects(self) -> DataFrame:
        """The rejected documents themselves."""
        return self.documents.filter(F.col("outcome") != "accepted")

    @property
    def counts(self) -> DataFrame:
        return lg.sync_counts(self.accepted_documents)

    def summary(self) -> DataFrame:
        """Per company, provider and basis: documents landed, accepted and rejected, lines, and their sum."""
        key = ["company_id", "provider", "basis"]
        ok = F.col("outcome") == "accepted"
        of_documents = self.documents.groupBy(*key).agg(F.count(F.lit(1)).alias("landed"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"))
        of_lines = self.lines.groupBy(*key).agg(F.count(F.lit(1)).alias("lines"), dbl(F.sum("amount")).alias("amount"))
        match = [F.col(f"d.{k}").eqNullSafe(F.col(f"l.{k}")) for k in key]
        return of_documents.alias("d").join(of_lines.alias("l"), match, "left").select(
            *[f"d.{k}" for k in key], "landed", "accepted", "rejected", F.coalesce("lines", F.lit(0)).cast("long").alias("lines"), "amount")


def full_sync(pages: DataFrame, connections: DataFrame, links: DataFrame, folder: str) -> Sync:
    """Parse ``pages`` once and write their documents to ``folder`` (replacing what a broken run left there)."""
    before, after = Observation(), Observation()
    found = lg.document_lines(pages).observe(before, F.count(F.lit(1)).alias("landed"))
    ok = F.col("outcome") == "accepted"
    docs = (lg.with_companies(found, connections).withColumn("outcome", F.coalesce("reject_reason", F.lit("accepted")))
            .observe(after, F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected")))
    with unsorted_partitions(pages.sparkSession):
        docs.write.mode("overwrite").partitionBy("outcome").parquet(folder)
    # a plan that is known to be empty is not observed
    landed, out = (0, {"accepted": 0, "rejected": 0}) if pages.isEmpty() else (before.get["landed"], after.get)
    if landed != out["accepted"] + out["rejected"]:
        raise ValueError(f"{landed} documents landed, but {out['accepted']} were accepted and {out['rejected']} rejected")
    return Sync(stored_documents(pages.sparkSession, folder, docs.schema), links, landed, out["accepted"], out["rejected"])


def stored_documents(spark, folder: str, schema: T.StructType) -> DataFrame:
    """The documents of a sync, also of one without any."""
    return spark.read.schema(schema).parquet(folder)
