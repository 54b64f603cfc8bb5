"""Tables written in buckets of a key, so that joins and sums by it need no exchange."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from cashcurve.session import checkpoint_dir


def bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """``df`` written once as a catalog table of ``buckets`` buckets by ``column``, sorted inside, and read back.

    One file per bucket; on a cluster take about as many buckets as there are 200 MB in the larger of the tables that are to
    meet, and the same number for all of them.  A join by further columns beside the key needs no exchange either if
    ``spark.sql.requireAllClusterKeysForCoPartition`` is false.  The files lie in the shared folder; the name is of this session.
    """
    spark: SparkSession = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    (df.repartition(buckets, column).write.bucketBy(buckets, column).sortBy(column)
     .option("path", os.path.join(checkpoint_dir(spark), "bucketed", name)).saveAsTable(name))
    return spark.table(name)
