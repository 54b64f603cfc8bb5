import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from cashcurve.llm import simhash as sh

from .conftest import ODD_TEXTS, prose


def _print(text, k=4):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(prints, distance=4):
    """Root per fingerprint by comparing all pairs."""
    parent = {p: p for p in prints}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in itertools.combinations(sorted(set(prints)), 2):
        if bin(a ^ b).count("1") <= distance:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {p: find(p) for p in prints}


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def test_fingerprint_follows_the_contract():
    rng = random.Random(0)
    for t in [*(t for t in ODD_TEXTS if t is None or len(t) < 10_000), prose(rng, 3), prose(rng, 4), prose(rng, 77).title(), "A\x0bB\x85C d e f"]:
        assert sh.fingerprint(t) == _print(t)


def test_every_four_positions_contain_a_triple():
    t = sh.triples()
    assert all(any(set(x) <= set(c) for x in t) for c in itertools.combinations(range(8), 4))


def test_finer_masks_keep_every_linked_pair():
    rng = random.Random(1)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(5)):
            b ^= 1 << bit
        masks = [m for m in (sh._mask(t) for t in sh.triples()) if not (a ^ b) & m]
        assert masks
        for _ in range(4):                                    # at every depth some list still holds both
            masks = [f for m in masks for f in (sh._finer_masks(m, 4) or [m]) if not (a ^ b) & f]
            assert masks


def _clusters(rng, sizes):
    out = []
    for n in sizes:
        center = rng.getrandbits(64)
        for _ in range(n):
            p = center
            for bit in rng.sample(range(64), rng.randrange(6)):
                p ^= 1 << bit
            out.append(p)
    return out


@pytest.mark.parametrize("long_list", [20_000, 40])
def test_links_connect_what_all_pairs_connect(spark, long_list):
    rng = random.Random(2)
    prints = sorted(set(_clusters(rng, [1] * 150 + [2] * 60 + [7] * 20 + [300]) + [0, 1, 3, (1 << 64) - 1, 15, 1 << 63]))
    df = spark.createDataFrame([(_signed(p),) for p in prints], "fp long").repartition(7)
    want = _components(prints)
    roots = {r.node: r.root for r in sh.components(sh.links(df, 4, long_list)).collect()}
    got = {p: roots.get(_signed(p), _signed(p)) for p in prints}
    same = lambda m: {frozenset(q for q in prints if m[q] == m[p]) for p in prints}
    assert same(got) == same(want)


def test_a_dense_list_sends_a_tree_not_all_pairs():
    rng = random.Random(3)
    fp = np.array(sorted({_signed(p) for p in _clusters(rng, [2000])}), dtype=np.int64)
    a, _ = sh.list_links(np.zeros(len(fp), dtype=np.int64), fp, 4)
    assert len(a) < len(fp)


def test_components_of_chains_and_rings(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100 + (i + 1) % 9) for i in range(9)] + [(500, 500 - 37)]
    got = {r.node: r.root for r in sh.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(61)}) == 1 and len({got[100 + i] for i in range(9)}) == 1
    assert len(set(got.values())) == 3 and got[500] == got[463]
    assert sh.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _corpus():
    rng = random.Random(4)
    base = [prose(rng, 300) for _ in range(12)]
    rows = [(100 + i, t, "en") for i, t in enumerate(base)]
    rows += [(50 + i, base[i] + " " + prose(rng, 1), "en") for i in range(4)] + [(200 + i, base[5], "en") for i in range(30)]
    return rows + [(1000 + i, t, None) for i, t in enumerate(ODD_TEXTS)] + [(None, base[2], None), (100, base[0], "en"), (None, "alone here", None)]


def test_query_columns_on_spark(spark, make_docs):
    rows = _corpus()
    got = sh.near_duplicates(make_docs(rows).repartition(5)).collect()
    prints = {t: _print(t) for t in {t for _, t, _ in rows}}
    root = _components(set(prints.values()))
    low = {}
    for i, t, _ in rows:
        r = root[prints[t]]
        low[r] = min([x for x in (low.get(r), i) if x is not None], default=None)
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=key) == sorted(
        ((i, f"{prints[t]:016x}", low[root[prints[t]]]) for i, t, _ in rows), key=key)
    assert sh.near_duplicates(make_docs([])).count() == 0


def test_one_document_of_each_group_stays(spark, make_docs):
    rows = _corpus()
    df = make_docs(rows).repartition(5)
    kept = sh.keep_one(df)
    assert kept.schema == df.schema
    got = kept.collect()
    root = _components({_print(t) for _, t, _ in rows})
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(root[_print(t)], []).append(i)
    assert len(got) == len(groups)
    assert {r.doc_id for r in got} == {min((i for i in ids if i is not None), default=None) for ids in groups.values()}
    assert sh.keep_one(make_docs([])).count() == 0
