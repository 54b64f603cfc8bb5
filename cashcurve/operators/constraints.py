"""M1-M4 compiled from the declared constraints: one aggregate over one scan per table.

Every row of a table states what it has to do with each constraint: its key (unique), the value it refers to or is referred to by
(foreign key), or whether it breaks a rule (not null, domain, month grain).  The statements of all tables are one column, summed by
(constraint, value) and then by constraint, so a value that a third of all rows share is combined map-side.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashcurve.sources.schemas import CONSTRAINTS, FOREIGN_KEYS


def declared() -> list[tuple[str, str, str, object]]:
    """(table, kind, name, definition) of every declared constraint."""
    out = []
    for table, kinds in CONSTRAINTS.items():
        out += [(table, "unique", ", ".join(k), k) for k in kinds.get("unique", [])]
        out += [(table, "not_null", c, f"{c} IS NOT NULL") for c in kinds.get("not_null", [])]
        out += [(table, "domain", rule, rule) for rule in kinds.get("domain", [])]
        out += [(table, "month_grain", c, f"{c} = trunc({c}, 'MM')") for c in kinds.get("month_grain", [])]
    out += [(table, "foreign_key", f"{fk} -> {parent}", (fk, parent)) for table, keys in FOREIGN_KEYS.items() for fk, parent, _ in keys]
    return out


def _said(number: int, key: Column, role: str, bad: Column) -> Column:
    return F.struct(F.lit(number).alias("c"), key.alias("key"), F.lit(role).alias("role"), bad.cast("int").alias("bad"))


def check_constraints(read: Callable[[str], DataFrame | None]) -> DataFrame:
    """table_name, kind, constraint_name, checked, violations of all declared constraints.

    ``read`` gives a table by its name, None if there is none (its constraints, and references to it, are left out).  Violations: keys that
    occur more than once, references without a row, rows that break the rule; a NULL key or reference is not checked.
    """
    rules = declared()
    tables = {t: read(t) for t in sorted({r[0] for r in rules} | {r[3][1] for r in rules if r[1] == "foreign_key"})}
    parts = []
    for table, df in tables.items():
        if df is None:
            continue
        said = []
        for number, (owner, kind, _, what) in enumerate(rules):
            if kind == "foreign_key":
                fk, parent = what
                if owner == table and tables.get(parent) is not None:
                    said.append(F.when(F.col(fk).isNotNull(), _said(number, F.col(fk).cast("string"), "child", F.lit(0))))
                if parent == table and tables.get(owner) is not None:
                    said.append(_said(number, F.col("id").cast("string"), "parent", F.lit(0)))
            elif owner == table and kind == "unique":
                whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in what])
                said.append(F.when(whole, _said(number, F.to_json(F.struct(*what)), "key", F.lit(0))))
            elif owner == table:
                ok = F.coalesce(F.expr(what), F.lit(kind == "month_grain"))       # a NULL date has no grain
                said.append(_said(number, F.lit(None).cast("string"), "row", ~ok))
        if said:
            parts.append(df.select(F.explode(F.array_compact(F.array(*said))).alias("s")).select("s.*"))
    said = reduce(DataFrame.unionByName, parts)
    by_key = said.groupBy("c", "key").agg(F.count_if(F.col("role") != "parent").alias("n"), F.max((F.col("role") == "parent").cast("int")).alias("found"),
                                          F.max((F.col("role") == "key").cast("int")).alias("is_key"), F.max((F.col("role") == "row").cast("int")).alias("is_row"),
                                          F.sum("bad").alias("bad"))
    broken = (F.when(F.col("is_row") == 1, F.col("bad")).when(F.col("is_key") == 1, (F.col("n") > 1).cast("long"))
              .otherwise(F.when(F.col("found") == 0, F.col("n")).otherwise(F.lit(0))))
    summed = by_key.groupBy("c").agg(F.sum("n").alias("checked"), F.sum(broken).alias("violations"))
    names = said.sparkSession.createDataFrame([(i, t, k, n) for i, (t, k, n, _) in enumerate(rules)], "c int, table_name string, kind string, constraint_name string")
    known = [i for i, (t, k, _, what) in enumerate(rules) if tables.get(t) is not None and (k != "foreign_key" or tables.get(what[1]) is not None)]
    # as many rows as constraints
    return names.filter(F.col("c").isin(known)).join(summed, "c", "left").select(
        "table_name", "kind", "constraint_name", F.coalesce("checked", F.lit(0)).cast("long").alias("checked"), F.coalesce("violations", F.lit(0)).cast("long").alias("violations"))
