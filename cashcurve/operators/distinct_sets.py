"""X2 and X3 over any period: exact distinct sets that merge, as bitmaps per company, month and bucket of ids.

A set of entities is kept as bitmaps (one bit per id, 32,768 ids a bucket), so the union of months is a bitwise OR and no event is read
again.  Intersections follow from unions: the sizes of A, B and their union give what they share.  The work grows with companies x months x
buckets, whatever the number of events; ids are expected to be dense (surrogate keys), not negative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashcurve.functions.exprs import round_dp

KEY = ["company_id", "bucket"]


def monthly_bitmaps(rows: DataFrame, company: Column, entity: Column, month: Column, kind: Column) -> DataFrame:
    """company_id, kind, month, bucket, bits: the entities seen, one row per bucket; rows with a NULL are left out."""
    r = rows.select(company.alias("company_id"), entity.cast("long").alias("e"), month.alias("month"), kind.alias("kind")).na.drop()
    return (r.withColumn("bucket", F.bitmap_bucket_number("e")).groupBy("company_id", "kind", "month", "bucket")
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("e")).alias("bits")))


def _in(bitmaps: DataFrame, first: str, last: str) -> DataFrame:
    return bitmaps.filter(F.col("month").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def conversion_range(bitmaps: DataFrame, first: str, last: str, seen: str = "view", done: str = "purchase") -> DataFrame:
    """X2 for the months first to last: entities with ``seen``, and those of them with ``done`` as well (in whatever month)."""
    b = _in(bitmaps, first, last).filter(F.col("kind").isin(seen, done))
    of = lambda k: F.bitmap_or_agg(F.when(F.col("kind") == k, F.col("bits")).otherwise(F.lit(b"")))
    size = F.bitmap_count
    per = b.groupBy(*KEY).agg(size(of(seen)).alias("s"), size(of(done)).alias("d"), size(F.bitmap_or_agg("bits")).alias("either"))
    g = per.groupBy("company_id").agg(F.sum("s").alias("visitors"), F.sum(F.col("s") + F.col("d") - F.col("either")).alias("converted"))
    return g.select("company_id", "visitors", "converted",
                    F.when(F.col("visitors") > 0, round_dp(F.col("converted") / F.col("visitors") * 100, 2)).alias("conversion_percent"))


def retention_range(bitmaps: DataFrame, first: str, last: str) -> DataFrame:
    """X3 for the months first to last, per cohort and age: the cohort of a month are the entities first seen in it within the period.

    With U(c) the union of the months up to c, those of cohort c that are active in month m number
    |U(c)| - |U(c-1)| - |U(c) or m| + |U(c-1) or m|.
    """
    b = _in(bitmaps, first, last).groupBy(*KEY, "month").agg(F.bitmap_or_agg("bits").alias("bits"))
    start = F.lit(first).cast("date")
    # the months of the period are bounded by the calendar: every month enters the unions of the months from it on
    months = F.sequence(F.trunc(start, "MM"), F.trunc(F.lit(last).cast("date"), "MM"), F.expr("INTERVAL 1 MONTH"))
    upto = b.select(*KEY, F.explode(F.filter(months, lambda x: x >= F.col("month"))).alias("c"), "bits").groupBy(*KEY, "c").agg(F.bitmap_or_agg("bits").alias("bits"))
    sizes = upto.select("company_id", "c", F.bitmap_count("bits").alias("n")).groupBy("company_id", "c").agg(F.sum("n").alias("u"))
    # U(c) or m for all months m >= c, and for c one month before m's first (nothing) as well
    active = b.select(*KEY, F.col("month").alias("m"), F.explode(F.filter(months, lambda x: x <= F.col("month"))).alias("c"), "bits")
    grown = upto.join(active.select(*KEY, "m", "c"), [*KEY, "c"]).select(*KEY, "c", "m", "bits")
    either = grown.unionByName(active.select(*KEY, "c", "m", "bits")).groupBy(*KEY, "c", "m").agg(F.bitmap_or_agg("bits").alias("bits"))
    met = (either.select("company_id", "c", "m", F.bitmap_count("bits").alias("n")).groupBy("company_id", "c", "m").agg(F.sum("n").alias("t")))
    # U(c) also holds ids of buckets in which month m has nobody
    active_buckets = b.select(*KEY, F.col("month").alias("m"))
    apart = (upto.join(active_buckets.select("company_id", "m").distinct(), "company_id").filter("c <= m")
             .join(active_buckets, [*KEY, "m"], "left_anti").select("company_id", "c", "m", F.bitmap_count("bits").alias("n"))
             .groupBy("company_id", "c", "m").agg(F.sum("n").alias("rest")))
    pairs = met.join(apart, ["company_id", "c", "m"], "left").join(sizes, ["company_id", "c"], "left").select(
        "company_id", "c", "m", (F.col("t") + F.coalesce("rest", F.lit(0))).alias("t"), F.coalesce("u", F.lit(0)).alias("u"))
    before = pairs.select("company_id", F.add_months("c", 1).alias("c"), "m", F.col("t").alias("t0"), F.col("u").alias("u0"))
    alone = b.select("company_id", F.col("month").alias("m"), F.bitmap_count("bits").alias("n")).groupBy("company_id", "m").agg(F.sum("n").alias("a"))
    j = pairs.join(before, ["company_id", "c", "m"], "left").join(alone, ["company_id", "m"])
    kept = F.col("u") - F.coalesce("u0", F.lit(0)) - F.col("t") + F.coalesce("t0", F.col("a"))
    out = j.select("company_id", F.col("c").alias("cohort"), F.months_between("m", "c").cast("int").alias("age"), kept.cast("long").alias("active"),
                   (F.col("u") - F.coalesce("u0", F.lit(0))).cast("long").alias("cohort_size"))
    return out.filter("active > 0").select("company_id", "cohort", "age", "cohort_size", "active",
                                           round_dp(F.col("active") / F.col("cohort_size") * 100, 2).alias("retention_percent"))
