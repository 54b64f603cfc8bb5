"""Sharding (operator 6): fixed virtual slots and a versioned slot-to-shard map.

A record's virtual slot is a hash of its id modulo a fixed number of slots (thousands) and never changes.  Spark sums
rows and bytes per slot; shards own slots, by a small map that is stored as numbered versions and *edited*: version 1
deals the slots out in turn, a rebalancing moves the slots that even out the bytes, growing by a shard moves slots into the
new one only.  Rows follow their slots, so only rows of moved slots change shard.

The law that the result obeys is ``bytes``: the shards' sizes are near equal (as near as whole slots allow).

A row's place in its shard: slots follow each other in the shard, a slot's input partitions follow each other in the slot,
and rows are numbered inside (slot, partition), so no task numbers more than one input partition's share of a slot.  The slim
rows (no text) are checkpointed first, as the places are made of two reads of the same rows.

A slot that is large beside a shard's share and holds several rows (a repeated id) is dealt out: its rows go to slots by a hash of their stored
place as well, so that the law holds whatever the ids.

Main path: DataFrame functions only.  The map has as many rows as there are slots, which is fixed: it alone is
collected, edited and broadcast.

Defined results: a null text has no bytes and the CRC-32 of nothing, 0; a null id is hashed by its text; rows repeated
under one id share a slot unless there are too many; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cashcurve.llm.common import reliable
from cashcurve.session import checkpoint_dir

SLOTS, OVERHEAD = 4096, 16


def virtual_slot(id_col: Column, text: Column, slots: int = SLOTS) -> Column:
    name = F.coalesce(id_col.cast("string"), F.concat(F.lit("#"), text), F.lit("#"))
    return F.pmod(F.xxhash64(name), F.lit(slots)).cast("int")


def slim_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot and the input partition of every record."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), virtual_slot(F.col(id_col), F.col(text_col), slots).alias("virtual_slot"),
                       F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))


class SlotMap:
    """Slot -> shard, with the slots' bytes; editing keeps the rest of the map as it is."""

    def __init__(self, shard: list[int], size: list[int], shards: int, version: int = 1):
        self.shard, self.size, self.shards, self.version = list(shard), list(size), shards, version

    @classmethod
    def dealt(cls, size: list[int], shards: int) -> SlotMap:
        return cls([s % shards for s in range(len(size))], size, shards)

    def loads(self) -> list[int]:
        load = [0] * self.shards
        for slot, shard in enumerate(self.shard):
            load[shard] += self.size[slot]
        return load

    def rebalanced(self) -> SlotMap:
        """Next version: over-full shards give slots up, the largest of these go to the emptiest shards, and then slots
        move or change places between the fullest and the emptiest shard while that helps."""
        new = SlotMap(self.shard, self.size, self.shards, self.version + 1)
        goal = sum(self.size) / self.shards
        own: list[list[int]] = [[] for _ in range(self.shards)]
        pool, load = [], [0] * self.shards
        for slot in sorted(range(len(self.size)), key=lambda s: (-self.size[s], s)):
            shard = new.shard[slot]
            if load[shard] + self.size[slot] <= goal:
                load[shard] += self.size[slot]
                own[shard].append(slot)
            else:
                pool.append(slot)
        heap = [(x, i) for i, x in enumerate(load)]
        heapq.heapify(heap)
        for slot in pool:
            x, shard = heapq.heappop(heap)
            new.shard[slot] = shard
            own[shard].append(slot)
            heapq.heappush(heap, (x + self.size[slot], shard))
        load = new.loads()
        for _ in range(4 * len(self.size)):
            top, low = max(range(self.shards), key=lambda i: load[i]), min(range(self.shards), key=lambda i: load[i])
            gap = load[top] - load[low]
            options = [(abs(gap - 2 * self.size[a]), a, None) for a in own[top] if 0 < self.size[a] < gap]
            small = sorted(own[low], key=lambda s: self.size[s])
            sizes = [self.size[s] for s in small]
            for a in own[top]:
                at = _bisect(sizes, self.size[a] - gap / 2)
                options += [(abs(gap - 2 * (self.size[a] - sizes[i])), a, small[i]) for i in (at - 1, at)
                            if 0 <= i < len(small) and 0 < self.size[a] - sizes[i] < gap]
            if not options:
                break
            _, a, b = min(options, key=lambda o: (o[0], o[1], -1 if o[2] is None else o[2]))
            for slot, frm, to in ((a, top, low), (b, low, top)):
                if slot is not None:
                    own[frm].remove(slot)
                    own[to].append(slot)
                    new.shard[slot] = to
                    load[frm] -= self.size[slot]
                    load[to] += self.size[slot]
        return new

    def grown(self) -> SlotMap:
        """Next version with one more shard, which takes slots from the fullest ones until it has its share."""
        new = SlotMap(self.shard, self.size, self.shards + 1, self.version + 1)
        load, goal = new.loads(), sum(self.size) / (self.shards + 1)
        own: list[list[int]] = [[] for _ in range(self.shards)]
        for slot in sorted(range(len(self.size)), key=lambda s: (self.size[s], s)):
            own[self.shard[slot]].append(slot)
        while True:
            top = max(range(self.shards), key=lambda i: load[i])
            fit = [s for s in own[top] if load[-1] + self.size[s] <= goal]
            if not fit or load[top] <= load[-1]:
                return new
            slot = fit[-1]
            own[top].remove(slot)
            new.shard[slot] = self.shards
            load[top] -= self.size[slot]
            load[-1] += self.size[slot]


def _bisect(values: list[int], x: float) -> int:
    lo, hi = 0, len(values)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if values[mid] < x else (lo, mid)
    return lo


class MapStore:
    """Numbered, immutable versions of a slot map in the shared folder."""

    def __init__(self, spark: SparkSession, name: str | None = None):
        self.spark = spark
        self.base = f"{checkpoint_dir(spark)}/slot-maps/{name or uuid.uuid4().hex}"

    def path(self, version: int) -> str:
        return f"{self.base}/version={version:06d}"

    def save(self, m: SlotMap, rows: list[int]) -> None:
        """One file of as many rows as slots; an existing version is never replaced."""
        first: dict[int, int] = {}
        table = []
        for slot, shard in enumerate(m.shard):
            table.append(f"({slot}, {shard}, {first.get(shard, 0)}L, {m.size[slot]}L, {m.version})")
            first[shard] = first.get(shard, 0) + rows[slot]
        (self.spark.sql(f"SELECT * FROM VALUES {', '.join(table)} AS t(virtual_slot, shard, first_place, bytes, map_version)")
         .coalesce(1).write.mode("errorifexists").parquet(self.path(m.version)))

    def load(self, version: int) -> DataFrame:
        return self.spark.read.parquet(self.path(version))


def slot_totals(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of every slot (as many numbers as slots)."""
    size, count = [0] * slots, [0] * slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect():
        size[r["virtual_slot"]], count[r["virtual_slot"]] = r["size"], r["n"]
    return size, count


def dealt_out(rows: DataFrame, size: list[int], count: list[int], shards: int, share: int = 8) -> DataFrame | None:
    """The rows with those of overfull slots (several rows, over 1/``share`` of a shard's bytes) spread over all slots; None if there are none."""
    large = sum(size) / shards / share
    hot = [s for s, (b, n) in enumerate(zip(size, count, strict=True)) if n > 1 and b > large]         # fewer than shards x share
    if not hot:
        return None
    spread = F.pmod(F.xxhash64("virtual_slot", "row"), F.lit(len(size))).cast("int")
    return rows.withColumn("virtual_slot", F.when(F.col("virtual_slot").isin(hot), spread).otherwise(F.col("virtual_slot")))


def assign(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard and gapless place in the shard of every slim row (see ``slim_rows``; checkpointed)."""
    counts = rows.groupBy("virtual_slot", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("virtual_slot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("virtual_slot", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    numbered = rows.withColumn("inside", inside).join(before, ["virtual_slot", "part"])
    return numbered.join(F.broadcast(slot_map), "virtual_slot").withColumn(
        "slot", (F.col("first_place") + F.col("before") + F.col("inside")).cast("long"))


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version of every record."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    rows = reliable(slim_rows(docs, id_col, text_col, slots))
    size, count = slot_totals(rows, slots)
    spread = dealt_out(rows, size, count, shards)
    if spread is not None:
        rows, (size, count) = spread, slot_totals(spread, slots)
    store = MapStore(spark)
    first = SlotMap.dealt(size, shards)
    store.save(first, count)
    even = first.rebalanced()
    store.save(even, count)
    return assign(rows, store.load(even.version)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot", "map_version")
