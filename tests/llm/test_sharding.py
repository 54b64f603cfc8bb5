import random
import zlib

import pytest
from pyspark.sql import functions as F

from cashcurve.llm import sharding as sd

from .conftest import ODD_TEXTS, prose


def _docs(make_docs, n=1500):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randrange(1, 60)), "en") for i in range(n)]
    return rows + [(9000 + i, t, None) for i, t in enumerate(ODD_TEXTS)] + [
        (None, "x", None), (None, None, None), (7, rows[7][1], "en"), (7, rows[7][1], "en")]


def test_shards_and_places(spark, make_docs):
    rows = _docs(make_docs)
    got = sd.shard_documents(make_docs(rows).repartition(6), shards=10).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((str(i), size(t), zlib.crc32((t or "").encode())) for i, t, _ in rows)
    load = {s: sum(r["size"] for r in got if r.shard == s) for s in range(10)}
    assert max(load.values()) - min(load.values()) <= max(size(t) for _, t, _ in rows)
    for s in range(10):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    slot = {}
    assert all(slot.setdefault(r.virtual_slot, r.shard) == r.shard for r in got)
    assert all(0 <= r.virtual_slot < sd.SLOTS for r in got)
    assert sd.shard_documents(make_docs([])).count() == 0


def test_the_slot_depends_on_the_id_alone(spark, make_docs):
    a = make_docs([(i, f"text {i}", "en") for i in range(50)])
    b = make_docs([(i, "other", None) for i in range(50)])
    slot = lambda df: {r.doc_id: r.s for r in df.select("doc_id", sd.virtual_slot(F.col("doc_id"), F.col("text")).alias("s")).collect()}
    assert slot(a) == slot(b)


def test_rebalancing_edits_and_growing_takes_only_into_the_new_shard():
    rng = random.Random(2)
    size = [rng.randrange(1000, 3000) for _ in range(512)]
    first = sd.SlotMap.dealt(size, 8)
    even = first.rebalanced()
    assert even.version == 2 and max(even.loads()) - min(even.loads()) <= 4
    moved = sum(a != b for a, b in zip(first.shard, even.shard, strict=True))
    assert moved < 128                                         # an edit, not a new map
    grown = even.grown()
    assert all(b in (a, 8) for a, b in zip(even.shard, grown.shard, strict=True))
    assert min(grown.loads()) > 0.9 * sum(size) / 9
    hot = [10_000_000 if s == 5 else v for s, v in enumerate(size)]
    again = sd.SlotMap(even.shard, hot, 8, even.version).rebalanced()
    rest = [x for i, x in enumerate(again.loads()) if i != again.shard[5]]
    assert max(rest) - min(rest) < 4000


def test_stored_versions_are_never_replaced(spark):
    store = sd.MapStore(spark)
    m = sd.SlotMap.dealt([5, 6, 7, 8], 2)
    store.save(m, [1, 2, 3, 4])
    got = store.load(1).orderBy("virtual_slot").collect()
    assert [(r.virtual_slot, r.shard, r.first_place, r.bytes) for r in got] == [(0, 0, 0, 5), (1, 1, 0, 6), (2, 0, 1, 7), (3, 1, 2, 8)]
    with pytest.raises(Exception, match="(?i)exist"):
        store.save(m, [1, 2, 3, 4])


def test_no_python_on_the_main_path(spark, make_docs):
    plan = sd.shard_documents(make_docs([(1, "a", "en")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_one_id_on_a_third_of_the_rows_leaves_shards_even(spark, make_docs):
    rng = random.Random(8)
    rows = [(7 if i % 3 == 0 else i, "same text" if i % 6 == 0 else prose(rng, rng.randrange(5, 30)), "en") for i in range(3000)]
    got = sd.shard_documents(make_docs(rows).repartition(7), shards=40).collect()
    load = [sum(r["size"] for r in got if r.shard == s) for s in range(40)]
    assert len(got) == 3000 and max(load) - min(load) <= 0.1 * sum(load) / 40
    for s in range(40):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_shards_equal_a_loop_over_the_rows(spark, make_docs):
    import xxhash
    rows = [(i, t, l) for i, t, l in _docs(make_docs, 400) if i != 7]              # repeated ids: dealt out where a slot is overfull
    got = {(r.doc_id, r.text_crc32): r for r in sd.shard_documents(make_docs(rows).repartition(3), shards=6, slots=64).collect()}
    size, count, slot = [0] * 64, [0] * 64, {}
    for i, t, _ in rows:
        name = str(i) if i is not None else "#" if t is None else "#" + t
        s = xxhash.xxh64(name.encode(), seed=42).intdigest()
        s = (s - (1 << 64) if s >> 63 else s) % 64
        slot[i, zlib.crc32((t or "").encode())] = s
        size[s] += len((t or "").encode()) + 16
        count[s] += 1
    large = sum(size) / 6 / 8
    hot = {s for s in range(64) if count[s] > 1 and size[s] > large}
    assert all(r.virtual_slot == slot[k] for k, r in got.items() if slot[k] not in hot) and hot != set(range(64))
    shard = {}
    assert all(shard.setdefault(r.virtual_slot, r.shard) == r.shard for r in got.values())
    load = [sum(r["size"] for r in got.values() if r.shard == s) for s in range(6)]
    assert sum(load) == sum(size)
