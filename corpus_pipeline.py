"""Corpus pipeline: filter, deduplicate, decontaminate, redact and tokenise the documents.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept.  All but the last return the columns of
documents; each is written and read again before the next one, and its folder goes once the next one is written, so a run leaves
the last stage's folder only (and, unless ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on, the operators' checkpoints).

Defined results: texts without words (null and empty ones too) are one group of near duplicates, of which one document stays, and pass
the other filters; a null text gets null ids, an empty one empty ids; rows with null or repeated ids are judged one by one, and of
a near-duplicate group the smallest id stays, null last; very long texts are read whole; ties go to the smaller id; further columns, also with
names that operators use, are kept as they are; an empty table passes through all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashcurve.llm import decontaminate, pieces, pii, simhash, toxicity
from cashcurve.llm.common import fold_is, read_table
from cashcurve.session import checkpoint_dir
from cashcurve.sources.files import SharedFiles


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents scored as toxic go; the field learns from the labels of the training folds."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), ~fold_is(F.col("doc_id"), 3, 1))
    return toxicity.drop_toxic(docs, model)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each near-duplicate group the document with the smallest id stays."""
    return simhash.keep_one(docs, shingle=4, distance=4)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents in which a window of a benchmark item occurs go."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: personal data are replaced by their kinds; no document goes."""
    return pii.redact(docs, pii.train(docs))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: piece ids of every document, and whether they decode to its text."""
    return pieces.round_trip(docs)


STAGES = [("toxicity", toxicity_stage), ("simhash near-dedup", simhash_stage), ("benchmark decontamination", decontaminate_stage),
          ("pii", pii_stage), ("sentencepiece encoding and decoding", pieces_stage)]
#: No stage but the redaction could be written in SQL, so the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again."""
    base = f"{checkpoint_dir(spark)}/corpus-pipeline/{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            SharedFiles(spark).remove(f"{base}/{k - 1}")
    return docs
