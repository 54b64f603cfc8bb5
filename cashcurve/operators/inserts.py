"""Inserts with defaults and generated ids (A7, A8), deletes by id and foreign-key actions over all tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashcurve.operators import upsert as up
from cashcurve.sources.schemas import DEFAULTS, FOREIGN_KEYS, SCHEMAS


def with_defaults(requests: DataFrame, table: str) -> DataFrame:
    """The request columns of ``table``: absent ones and NULLs take the default, the rest their declared type."""
    defaults = DEFAULTS.get(table, {})
    cols = []
    for f in SCHEMAS[table].fields:
        if f.name == "id":
            continue
        given = F.col(f.name).cast(f.dataType) if f.name in requests.columns else F.lit(None).cast(f.dataType)
        cols.append((F.coalesce(given, F.lit(defaults[f.name]).cast(f.dataType)) if f.name in defaults else given).alias(f.name))
    extra = [c for c in requests.columns if c not in SCHEMAS[table].names]
    return requests.select(*cols, *extra)


def insert_rows(base: DataFrame, requests: DataFrame, table: str, order: list[str]) -> DataFrame:
    """The inserted rows, with ids after the table's largest in the order of the requests (``order`` columns)."""
    rows = up.assign_ids(with_defaults(requests, table), order, up.max_id(base))
    return rows.select(*SCHEMAS[table].names)


def insert_budgets(base: DataFrame, requests: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(budget items, their installments) from requests that carry an ``installments`` array of
    (payment_amount, expected_payment_date); an empty or missing list gives a parent without children."""
    rows = up.assign_ids(with_defaults(requests, "project_budgets"), order, up.max_id(base))
    children = rows.select(F.col("id").alias("budget_item_id"), F.explode("installments").alias("i"))
    child_cols = [F.col(f"i.{f.name}").cast(f.dataType).alias(f.name) for f in SCHEMAS["installments"].fields[1:]]
    return rows.select(*SCHEMAS["project_budgets"].names), children.select("budget_item_id", *child_cols)


def delete_everywhere(tables: dict[str, DataFrame], table: str, doomed: DataFrame) -> dict[str, DataFrame]:
    """J7 + J8: the tables after ``DELETE FROM table WHERE id IN doomed`` and the foreign-key actions that follow.

    Actions run parents first, so a cascade reaches children of children; tables that no action reaches stay as they are.
    """
    out = dict(tables)
    out[table] = up.delete_by_keys(tables[table], doomed, ["id"])
    changed, pending = {table}, True
    while pending:
        pending = False
        for child, keys in FOREIGN_KEYS.items():
            if child not in out:
                continue
            for fk, parent, action in keys:
                if parent in changed and (child, fk) not in changed:
                    alive = out[parent].select("id")
                    out[child] = (up.cascade if action == "cascade" else up.set_null)(out[child], alive, fk)
                    changed |= {(child, fk)} | ({child} if action == "cascade" and "id" in out[child].columns else set())
                    pending = True
    return out
