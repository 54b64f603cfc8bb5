"""A7, A8, J1-J9 over a user's own tables: requests are stored beside the tables and read back by everything that reads them.

The tables lie as ``<root>/<table>.parquet``.  A request adds one folder ``<root>/changes/batch_id=<n>`` with, per table it touches, the
rows it leaves (``<table>/rows``, whole rows) and the keys it removes (``<table>/gone``), each written by Spark's own writer, and at last
``done``.  Readers take the folders that have it, so parent, child and cascaded tables of a request appear together or not at all, and
a request that died is written again under its number.  A request costs what it changes: reading leaves out of a table only the keys that
later requests name (a join with a side of the requests' size), and ``rewrite`` folds a table's requests into a new base by an ordinary batch job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashcurve.operators import inserts as ins
from cashcurve.operators import onboarding as ob
from cashcurve.operators import upsert as up
from cashcurve.sources.files import SharedFiles
from cashcurve.sources.schemas import FOREIGN_KEYS, SCHEMAS, OwnTables, read_own_table

#: Keys of tables that have no id; rows of the tables in PARTS belong to their parent and go with it.
KEYS = {"accounting_actual_lines": ["company_id", "idempotency_key"], "monthly_metrics": ["company_id", "month_date"],
        "profile_patches": ["company_id", "seq", "key"]}
PARTS = {"installments": "budget_item_id"}


def key_of(table: str) -> list[str]:
    return [PARTS[table]] if table in PARTS else KEYS.get(table, ["id"])


def parents_first() -> list[str]:
    """Tables in an order in which every one comes after those that its foreign keys name."""
    out: list[str] = []

    def visit(table: str) -> None:
        for _, parent, _ in FOREIGN_KEYS.get(table, []):
            visit(parent)
        if table not in out:
            out.append(table)
    for table in SCHEMAS:
        visit(table)
    return out


class StoredTables(OwnTables):
    """Own tables with stored requests; has the attributes of ``OwnTables``."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root)
        self.files = SharedFiles(spark)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        return self.read(name)

    # -- folders ---------------------------------------------------------------------------------
    def _batch(self, batch_id: int) -> str:
        return f"{self.root}/changes/batch_id={batch_id:010d}"

    def batches(self) -> list[int]:
        """Numbers of the complete requests."""
        names = [n for n in self.files.names(f"{self.root}/changes") if n.startswith("batch_id=")]
        return sorted(b for n in names if self.files.exists(self._batch(b := int(n.split("=")[1])) + "/done/_SUCCESS"))

    def _base(self, table: str) -> tuple[int, DataFrame | None]:
        """The newest base and the number of the last request in it (-1: the user's own file)."""
        found = [int(n.split("=")[1]) for n in self.files.names(f"{self.root}/rewritten/{table}") if n.startswith("batch_id=")]
        paths = {b: f"{self.root}/rewritten/{table}/batch_id={b:010d}" for b in found}
        whole = [b for b, p in paths.items() if self.files.exists(f"{p}/_SUCCESS")]
        if whole:
            return max(whole), read_own_table(self.spark, paths[max(whole)], table)
        own = f"{self.root}/{table}.parquet"
        return -1, read_own_table(self.spark, own, table) if self.files.exists(own) else None

    def _changes(self, table: str, what: str, schema, after: int) -> DataFrame | None:
        paths = {b: f"{self._batch(b)}/{table}/{what}" for b in self.batches() if b > after}
        parts = [self.spark.read.schema(schema).parquet(p).withColumn("_step", F.lit(b)) for b, p in paths.items() if self.files.exists(p)]
        return reduce(DataFrame.unionByName, parts) if parts else None

    # -- reading ---------------------------------------------------------------------------------
    def read(self, table: str) -> DataFrame:
        """The table as the complete requests leave it."""
        schema, key = SCHEMAS[table], key_of(table)
        done, base = self._base(table)
        if base is None:
            base = self.spark.createDataFrame([], schema)
        rows = self._changes(table, "rows", schema, done)
        gone = self._changes(table, "gone", base.select(*key).schema, done)
        if rows is None and gone is None:
            return base
        none = self.spark.createDataFrame([], schema).withColumn("_step", F.lit(0))
        gone = none.select(*key, "_step") if gone is None else gone
        if table in PARTS:
            rows = none if rows is None else rows
            last = gone.groupBy(*key).agg(F.max("_step").alias("_gone"))
            kept = base.withColumn("_step", F.lit(-1)).unionByName(rows).join(last, key, "left")
            return kept.filter(F.col("_gone").isNull() | (F.col("_step") > F.col("_gone"))).select(*schema.names)
        if rows is None:                    # keys only: no rows to be sorted for the newest
            return base.join(gone.select(*key).distinct(), key, "left_anti").select(*schema.names)
        rest = [c for c in schema.names if c not in key]
        named = rows.select(*key, "_step", F.struct(*rest).alias("_row")).unionByName(gone.select(*key, "_step"), allowMissingColumns=True)
        newest = named.groupBy(*key).agg(F.max_by(F.struct("_row"), "_step").alias("_last"))
        left = newest.filter(F.col("_last._row").isNotNull()).select(*key, "_last._row.*")
        return base.join(newest.select(*key), key, "left_anti").select(*schema.names).unionByName(left.select(*schema.names))

    def rewrite(self, table: str) -> None:
        """Fold the requests so far into a new base of the table; older folders are left to expire."""
        newest = max(self.batches(), default=None)
        if newest is not None:
            self.read(table).write.mode("overwrite").parquet(f"{self.root}/rewritten/{table}/batch_id={newest:010d}")

    # -- requests --------------------------------------------------------------------------------
    def _number(self, request: int | None) -> int:
        return max(self.batches(), default=-1) + 1 if request is None else request

    def _put(self, batch_id: int, table: str, what: str, df: DataFrame) -> DataFrame:
        """Write one part of a request and return it as it is stored."""
        path = f"{self._batch(batch_id)}/{table}/{what}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _finish(self, batch_id: int) -> None:
        self.spark.range(1).write.mode("overwrite").parquet(f"{self._batch(batch_id)}/done")

    def commit(self, rows: dict[str, DataFrame], request: int | None = None) -> int:
        """Store whole rows of one or more tables as one request; a request number that is complete already is left as it is."""
        n = self._number(request)
        if n not in self.batches():
            for table, df in rows.items():
                self._put(n, table, "rows", df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[table].fields]))
            self._finish(n)
        return n

    def stored_rows(self, batch_id: int, table: str) -> DataFrame:
        """What a request wrote to a table."""
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self._batch(batch_id)}/{table}/rows")

    def insert(self, table: str, requests: DataFrame, order: list[str], request: int | None = None) -> DataFrame:
        """Append rows with defaults and ids, and return them."""
        n = self._number(request)
        if n not in self.batches():
            self.commit({table: ins.insert_rows(self.read(table), requests, table, order)}, n)
        return self.stored_rows(n, table)

    def insert_budgets(self, requests: DataFrame, order: list[str], request: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Budget items and their installments as one request; returns both as stored."""
        n = self._number(request)
        if n not in self.batches():
            items, parts = ins.insert_budgets(self.project_budgets, requests, order)
            self.commit({"project_budgets": items, "installments": parts}, n)
        return self.stored_rows(n, "project_budgets"), self.stored_rows(n, "installments")

    def upsert(self, table: str, delta: DataFrame, keys: list[str], replace: list[str], keep_if_null: list[str] | None = None, seq: str | None = None,
               request: int | None = None) -> int:
        """Insert or update by ``keys``; only the rows that the change set names are written.

        New rows of a table with a numeric id get the next ones; ``delta`` may bring ids of its own (as forecast entries do).
        """
        table_now = self.read(table)
        touched = table_now.join(delta.select(*keys).distinct(), keys, "left_semi")
        new = up.upsert(touched, delta, keys, replace, keep_if_null, seq)
        if "id" in SCHEMAS[table].names and "id" not in delta.columns:
            known = new.filter(F.col("id").isNotNull())
            fresh = up.assign_ids(new.filter(F.col("id").isNull()).drop("id"), keys, up.max_id(table_now))
            new = known.unionByName(fresh.select(*known.columns))
        return self.commit({table: new}, request)

    def patch_leads(self, patches: DataFrame, request: int | None = None) -> DataFrame:
        """J6 + C9: set or clear the lead of lines by (company_id, idempotency_key); returns the patches with ``accepted``."""
        checked = up.annotate_lead_patches(patches, self.leads)
        lines = self.accounting_actual_lines.join(checked.filter("accepted").select("company_id", "idempotency_key"), ["company_id", "idempotency_key"], "left_semi")
        self.commit({"accounting_actual_lines": up.patch_lines_lead(lines, checked)}, request)
        return checked

    def complete_sessions(self, requests: DataFrame, now: str, request: int | None = None) -> int:
        """Complete sessions once; the time is stored with them."""
        done = ob.complete_sessions(self.onboarding_sessions, requests, now).filter("completed_now").select(F.col("session_id").alias("id"))
        s = self.onboarding_sessions.join(done, "id", "left_semi")
        at = F.lit(now).cast("timestamp")
        return self.commit({"onboarding_sessions": s.withColumn("status", F.lit("completed")).withColumn("is_completed", F.lit(True))
                            .withColumn("completed_at", at).withColumn("updated_at", at)}, request)

    def delete(self, table: str, doomed: DataFrame, request: int | None = None) -> int:
        """J7 + J8: delete rows by key and follow the foreign keys, in one request.

        Every child table is read once: rows under a deleted parent go (cascade) or lose the reference (set null).
        """
        n = self._number(request)
        if n in self.batches():
            return n
        gone = {table: self._put(n, table, "gone", self.read(table).join(doomed, key_of(table), "left_semi").select(*key_of(table)))}
        for child in parents_first():
            links = [(fk, parent, action) for fk, parent, action in FOREIGN_KEYS.get(child, []) if parent in gone and key_of(parent) == ["id"]]
            if not links or child == table:
                continue
            rows = self.read(child)
            flags = {}
            for i, (fk, parent, _) in enumerate(links):
                flags[i] = F.coalesce(F.col(f"_gone{i}"), F.lit(False))
                rows = rows.join(gone[parent].select(F.col("id").alias(fk), F.lit(True).alias(f"_gone{i}")), fk, "left")
            dies = reduce(lambda a, b: a | b, [flags[i] for i, k in enumerate(links) if k[2] == "cascade"], F.lit(False))
            loses = {fk: flags[i] for i, (fk, _, action) in enumerate(links) if action != "cascade"}
            if any(action == "cascade" for _, _, action in links):
                gone[child] = self._put(n, child, "gone", rows.filter(dies).select(*key_of(child)).distinct())
            if loses:
                cut = rows.filter(~dies & reduce(lambda a, b: a | b, loses.values()))
                self._put(n, child, "rows", cut.select(*[F.when(~loses[c], F.col(c)).alias(c) if c in loses else F.col(c) for c in SCHEMAS[child].names]))
        self._finish(n)
        return n
