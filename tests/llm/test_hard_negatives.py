import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cashcurve.llm import hard_negatives as hn
from cashcurve.llm.queries import op12_strassen_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int, slice int"


def _rows(rng, n, d=8):
    centers = [[rng.uniform(-0.4, 0.4) for _ in range(d)] for _ in range(10)]
    out = []
    for i in range(n):
        label = rng.randrange(10)
        out.append((i, [c + rng.uniform(-0.3, 0.3) for c in centers[label]], label, 0.5, 1, 2))
    return out


def _brute(rows):
    """The contract's rows, as a sorted list."""
    kept = []
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, [max(-hn.LARGEST, min(hn.LARGEST, math.floor(256 * float(np.float32(x))))) for x in v]))
    out = []
    for a, (i, la, va) in enumerate(kept):
        if i % 100:
            continue
        score = [(-sum(x * y for x, y in zip(va, vb, strict=False)), j, lb, b) for b, (j, lb, vb) in enumerate(kept)]
        pos = sorted(s for s in score if s[2] == la and s[3] != a)[:5]
        for p in pos:
            neg = sorted((s, j) for s, j, lb, _ in score if lb != la and 30 * -p[0] <= 100 * -s <= 90 * -p[0])[:10]
            out += [(i, p[1], r + 1, j, -p[0], -s) for r, (s, j) in enumerate(neg)]
    return sorted(out)


def _got(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def test_query_equals_brute_force(spark, write_tables):
    rng = random.Random(3)
    rows = _rows(rng, 1500)
    rows += [(20_000 + i, v, label, None, None, None) for i, (v, label) in enumerate([
        (None, 1), ([0.1] * 8, None), ([None] + [0.1] * 7, 2), ([float("nan")] + [0.1] * 7, 2), ([float("inf")] + [0.1] * 7, 2), ([], 3), ([0.0] * 8, 4),
        ([1e30] * 8, 5), ([0.2, 0.3], 6), ([0.2] * 11, 7)])]
    rows += [(None, [0.1] * 8, 1, None, None, None), (100, rows[100][1], rows[100][2], 0.1, 2, 3), (100, rows[100][1], rows[100][2], 0.1, 2, 3), (200, rows[7][1], 4, 0.1, 2, 3)]
    rows += [(30_000 + i, rows[11][1], rows[11][2], None, None, None) for i in range(40)]        # ties
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = op12_strassen_negatives(spark, write_tables(embeddings=df))
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [
        ("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    want = _brute(rows)
    assert len(want) > 300 and _got(got) == want


def test_many_slices_and_blocks_give_the_same_rows(spark):
    from pyspark.sql import functions as F
    rows = _rows(random.Random(4), 900, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    small = hn.mine(df, F.col("vec_id") % 100 == 0, label, slice_rows=50, block_rows=3)
    assert _got(small) == _brute(rows)


@pytest.mark.parametrize(("m", "k", "n", "leaf"), [(1, 1, 1, 1), (7, 5, 9, 1), (16, 16, 16, 2), (33, 64, 130, 8), (0, 3, 2, 4), (64, 1, 64, 4)])
def test_strassen_equals_the_plain_product(m, k, n, leaf):
    rng = np.random.default_rng(m * 100 + k)
    a, b = rng.integers(-(1 << 24), 1 << 24, (m, k)), rng.integers(-(1 << 24), 1 << 24, (k, n))
    want = (a.astype(object) @ b.astype(object)) if m and k and n else np.zeros((m, n), dtype=object)
    assert (hn.multiply(a, b, leaf).astype(object) == want).all()


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 20), st.integers(1, 20), st.integers(1, 20), st.integers(0, 1 << 30))
def test_strassen_is_exact_at_the_largest_components(m, k, n, seed):
    rng = np.random.default_rng(seed)
    a, b = (rng.choice(np.array([-hn.LARGEST, hn.LARGEST, 1, 0]), size) for size in ((m, k), (k, n)))
    assert (hn.multiply(a, b, 2).astype(object) == a.astype(object) @ b.astype(object)).all()


def test_empty_tables_and_no_partners(spark):
    from pyspark.sql import functions as F
    none = spark.createDataFrame([], SCHEMA)
    assert hn.mine(none, F.col("vec_id") % 100 == 0, F.col("label")).count() == 0
    alone = spark.createDataFrame([(0, [0.5, 0.5], 1, None, None, None), (1, [0.5, 0.4], 2, None, None, None)], SCHEMA)
    assert hn.mine(alone, F.col("vec_id") % 100 == 0, F.col("label")).count() == 0
