"""Tables that grow by change sets, as Parquet folders that Spark's own writer makes.

``<root>/changes/batch_id=<n>`` holds one change set (one row per key), ``<root>/base/batch_id=<n>`` all change sets up to n folded
by an ordinary batch job.  A folder counts once Spark has put its ``_SUCCESS`` file there, so a reader sees a change set whole
or not at all, and a change set that is written again replaces itself.  Reading folds the newest base and the later change sets with one
aggregate per key.

Change sets may differ in their columns.  A column that a change set lacks keeps the value it has; a column that appears later
is, for keys no change set with it has touched, its declared default (NULL without one).  A column that changes its type is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashcurve.sources.files import SharedFiles


class BatchTable:
    """Rows by ``keys``; columns in ``replace`` take the newest change set's value, all others keep the first one."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], replace: list[str], defaults: dict[str, object] | None = None):
        self.spark, self.root, self.keys, self.replace, self.defaults = spark, root.rstrip("/"), keys, replace, defaults or {}
        self.files = SharedFiles(spark)

    def _path(self, kind: str, batch_id: int) -> str:
        return f"{self.root}/{kind}/batch_id={batch_id:010d}"

    def _complete(self, kind: str) -> list[int]:
        names = [n for n in self.files.names(f"{self.root}/{kind}") if n.startswith("batch_id=")]
        return sorted(b for n in names if self.files.exists(self._path(kind, b := int(n.split("=")[1])) + "/_SUCCESS"))

    def base(self) -> int | None:
        return max(self._complete("base"), default=None)

    def batches(self) -> list[int]:
        """Complete change sets, also those that the base holds already."""
        return self._complete("changes")

    def applied(self, batch_id: int) -> bool:
        base = self.base()
        return (base is not None and batch_id <= base) or self.files.exists(self._path("changes", batch_id) + "/_SUCCESS")

    def write(self, batch_id: int, delta: DataFrame) -> None:
        """Add a change set, or replace it by itself if the same batch comes again."""
        delta.write.mode("overwrite").parquet(self._path("changes", batch_id))

    def read(self) -> DataFrame | None:
        """The folded table; None if nothing has been written."""
        base = self.base()
        later = [b for b in self.batches() if base is None or b > base]
        steps = {b: self._path("changes", b) for b in later}
        rows = None
        if later:
            rows = (self.spark.read.option("mergeSchema", "true").option("basePath", f"{self.root}/changes").parquet(*steps.values())
                    .withColumn("_step", F.col("batch_id").cast("long")).drop("batch_id"))
        if base is not None:
            steps[base] = self._path("base", base)
            old = self.spark.read.parquet(steps[base]).withColumn("_step", F.lit(base).cast("long"))
            rows = old if rows is None else self._checked(old, rows)
        if rows is None:
            return None
        return self._folded(rows, {b: set(self.spark.read.parquet(p).columns) for b, p in steps.items()})

    @staticmethod
    def _checked(old: DataFrame, new: DataFrame) -> DataFrame:
        types = {f.name: f.dataType for f in old.schema}
        changed = [f.name for f in new.schema if types.get(f.name, f.dataType) != f.dataType]
        if changed:
            raise ValueError(f"columns with another type than in the base: {changed}")
        return old.unionByName(new, allowMissingColumns=True)

    def _folded(self, rows: DataFrame, given: dict[int, set[str]]) -> DataFrame:
        cols = [c for c in rows.columns if c not in (*self.keys, "_step")]
        groups: dict[tuple, list[str]] = {}                     # columns of one rule that the same change sets have
        for c in cols:
            groups.setdefault((c in self.replace, tuple(sorted(b for b, names in given.items() if c in names))), []).append(c)
        aggs, out = [], {}
        for i, ((newest, has), names) in enumerate(groups.items()):
            order = F.col("_step") if len(has) == len(given) else F.when(F.col("_step").isin(*has), F.col("_step"))
            aggs.append((F.max_by if newest else F.min_by)(F.struct(*names), order).alias(f"_g{i}"))
            for c in names:
                value = F.col(f"_g{i}.{c}")
                if c in self.defaults and len(has) < len(given):
                    value = F.when(F.col(f"_g{i}").isNull(), F.lit(self.defaults[c]).cast(rows.schema[c].dataType)).otherwise(value)
                out[c] = value.alias(c)
        folded = rows.groupBy(*self.keys).agg(*aggs) if aggs else rows.select(*self.keys).distinct()
        return folded.select(*[out.get(c, F.col(c)) for c in rows.columns if c != "_step"])

    def rewrite_base(self) -> int | None:
        """Fold everything up to the newest change set into a base of its own; earlier folders are left to expire."""
        newest = max(self.batches(), default=None)
        if newest is not None and newest != self.base():
            self.read().write.mode("overwrite").parquet(self._path("base", newest))
        return newest
