"""Snapshot updates: A7 A9 C9 J1-J9.

The reference changes one row per request (``INSERT ... ON CONFLICT``,
``UPDATE``, ``DELETE`` with foreign-key actions).  Here a change set is a
DataFrame of many keys for many companies and every update is
"old snapshot + change set -> new snapshot":

* ``upsert`` is ONE aggregate over ``base UNION delta``: per key, each column
  takes the delta value (replace), the newest non-NULL value (keep-if-null) or
  the base value (identity columns).  max_by/min_by keep one buffer per key,
  so a key holding a third of all rows is read once, row by row; there is no
  full outer join and no per-key collect.
* deletes are ``left_anti`` joins, SET NULL is a left join + ``when``.
* validation (lead must exist for the company) is one left join that flags each patch.
* change sets are stored as folders of their own (``sources.batches``): parquet has no MERGE, so readers fold them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], replace: list[str],
           keep_if_null: list[str] | None = None, delta_seq: str | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT (keys) DO UPDATE SET <replace> for a whole change set.

    Columns in ``replace`` take the newest delta value (also NULL); columns in
    ``keep_if_null`` take the newest non-NULL value; every other column keeps
    the base value and is only taken from the delta for new keys.  Within the
    delta, ``delta_seq`` orders repeated keys (last wins).
    """
    keep_if_null = keep_if_null or []
    cols = [c for c in base.columns if c not in keys]
    kept = [c for c in cols if c not in replace and c not in keep_if_null]
    replace = [c for c in replace if c in cols]
    # the sequence keeps its own type: a cast to double would tie large numbers
    seq = F.col(delta_seq) if delta_seq else F.lit(0)
    seq_type = delta.schema[delta_seq].dataType if delta_seq else "int"
    b = base.select(*keys, *cols, F.lit(0).alias("_src"), F.lit(None).cast(seq_type).alias("_seq"))
    d = delta.select(*keys, *[F.col(c) if c in delta.columns else F.lit(None).cast(base.schema[c].dataType).alias(c)
                              for c in cols], F.lit(1).alias("_src"), seq.alias("_seq"))
    return fold(b.unionByName(d), keys, replace, keep_if_null, kept, F.struct("_src", "_seq")).select(*base.columns)


def fold(rows: DataFrame, keys: list[str], replace: list[str], keep_if_null: list[str], kept: list[str], order) -> DataFrame:
    """One row per key: the last row's ``replace`` columns, the last non-NULL of each ``keep_if_null``, the first
    row's ``kept`` columns.  Columns of one rule travel as one struct, so a key has two aggregation buffers, not one per column."""
    aggs = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in keep_if_null]
    if replace:
        aggs.append(F.max_by(F.struct(*replace), order).alias("_new"))
    if kept:
        aggs.append(F.min_by(F.struct(*kept), order).alias("_old"))
    # a key has a row in the base and few in a change set: rows are sorted once, behind the shuffle, not also before it for a partial aggregate
    g = rows.repartition(*keys).groupBy(*keys).agg(*aggs) if aggs else rows.select(*keys).distinct()
    return g.select(*keys, *keep_if_null, *[F.col(f"_new.{c}") for c in replace], *[F.col(f"_old.{c}") for c in kept])


def delete_by_keys(base: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    """DELETE ... WHERE key IN (change set)."""
    return base.join(doomed.select(*keys).distinct(), keys, "left_anti")


def cascade(child: DataFrame, surviving_parent: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """J8 ON DELETE CASCADE: children whose parent no longer exists are removed (NULL FKs stay)."""
    p = surviving_parent.select(F.col(pk).alias(fk))
    return child.filter(F.col(fk).isNull()).unionByName(child.join(p, fk, "left_semi"))


def set_null(child: DataFrame, surviving_parent: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """J8 ON DELETE SET NULL: a dangling foreign key becomes NULL, the row stays."""
    p = surviving_parent.select(F.col(pk).alias("_pk"), F.lit(True).alias("_alive"))
    j = child.join(p, child[fk] == p["_pk"], "left")
    return j.select(*[F.when(F.col("_alive"), F.col(fk)).alias(fk) if c == fk else F.col(c) for c in child.columns])


def annotate_lead_patches(patches: DataFrame, leads: DataFrame) -> DataFrame:
    """Mark each (company, line, lead) patch accepted when it clears the lead (NULL) or the
    lead exists *for that company*; otherwise it is rejected ("Lead not found for this company")."""
    ld = leads.select(F.col("id").alias("lead_id"), "company_id", F.lit(True).alias("_lead_ok"))
    j = patches.join(ld, ["lead_id", "company_id"], "left")
    return j.select(*patches.columns,
                    (F.col("lead_id").isNull() | F.coalesce(F.col("_lead_ok"), F.lit(False))).alias("accepted"))


def validate_lead_patches(patches: DataFrame, leads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C9 split form: (accepted patches, rejected patches)."""
    a = annotate_lead_patches(patches, leads)
    return a.filter("accepted").drop("accepted"), a.filter(~F.col("accepted")).drop("accepted")


def patch_lines_lead(lines: DataFrame, patches: DataFrame) -> DataFrame:
    """UPDATE lines SET lead_id = patch WHERE (company, line key) matches (set or clear).

    ``patches`` may carry an ``accepted`` flag (from ``annotate_lead_patches``);
    rejected patches leave the line unchanged.
    """
    ok = F.col("accepted") if "accepted" in patches.columns else F.lit(True)
    p = patches.select("company_id", "idempotency_key", F.col("lead_id").alias("_new_lead"), ok.alias("_patched"))
    j = lines.join(p, ["company_id", "idempotency_key"], "left")
    return j.select(*[F.when(F.coalesce(F.col("_patched"), F.lit(False)), F.col("_new_lead"))
                      .otherwise(F.col("lead_id")).alias("lead_id")
                      if c == "lead_id" else F.col(c) for c in lines.columns])


def assign_ids(rows: DataFrame, order_cols: list[str], start) -> DataFrame:
    """Dense ids start+1, start+2, ... in ``order_cols`` order, without a single-partition window.

    Rows are range-partitioned on the order, numbered inside each partition and
    shifted by the row count of all earlier partitions (one row per partition,
    so the offset table has a proven size bound and is broadcast).  ``start``
    is an int or a scalar Column such as ``base.select(max(id)).scalar()``.
    """
    from cashcurve.functions.grouped import pinned_partitions
    r = pinned_partitions(rows.repartitionByRange(*order_cols))
    counts = r.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p").rowsBetween(
        Window.unboundedPreceding, -1))).alias("_off"))
    w = Window.partitionBy("_p").orderBy(*order_cols)
    numbered = r.withColumn("_rn", F.row_number().over(w)).join(F.broadcast(offsets), "_p")
    base = F.lit(start) if isinstance(start, int) else start
    return numbered.withColumn("id", base + F.coalesce(F.col("_off"), F.lit(0)) + F.col("_rn")).drop(
        "_p", "_rn", "_off")


def max_id(df: DataFrame, col: str = "id"):
    """Scalar subquery ``(SELECT coalesce(max(id), 0) FROM df)`` as a Column."""
    return df.select(F.coalesce(F.max(col), F.lit(0))).scalar()
