import math

import numpy as np
from pyspark.sql import functions as F

from cashcurve.llm import ann
from cashcurve.llm.queries import op1_learned_partitions


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1.0, 3) for i, v in rows], "vec_id long, embedding array<float>, label int, score double, part int")


def _rows(n=3000, d=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + 3 * rng.normal(size=(20, d))[rng.integers(0, 20, n)]
    return [(i, [float(v) for v in r.astype(np.float32)]) for i, r in enumerate(x)]


def _recall(got, rows, queries):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=float)
    hits = total = 0
    for q in queries:
        want = ann.brute_force(ids, x, q)
        mine = {r.vec_id: r.score for r in got if r.query_id == q}
        hits += sum(v in mine for v, _ in want)
        total += len(want)
        assert all(math.isclose(mine[v], s, rel_tol=1e-12, abs_tol=1e-12) for v, s in want if v in mine)
    return hits / total


def test_recall_and_ranks(spark):
    rows = _rows()
    got = ann.search(_frame(spark, rows), F.col("vec_id") % 20 == 0, slice_rows=200, query_rows=50).collect()
    queries = list(range(0, 3000, 20))
    assert {r.query_id for r in got} == set(queries) and all(r.query_id != r.vec_id for r in got)
    for q in queries[:20]:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
    assert _recall(got, rows, queries) >= 0.9


def test_probing_every_part_is_exact(spark):
    rows = _rows(1500, 8, 1)
    got = ann.search(_frame(spark, rows), F.col("vec_id") % 50 == 0, mass=2.0, parts=6, slice_rows=100).collect()
    assert _recall(got, rows, range(0, 1500, 50)) == 1.0


def test_a_vector_with_many_copies(spark):
    rows = _rows(600, 8, 2) + [(10_000 + i, [1.0] * 8) for i in range(400)]
    got = ann.search(_frame(spark, rows), F.col("vec_id") % 100 == 0, slice_rows=64).collect()
    for q in (10_000, 10_100):
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [
            (i, 0.0) for i in range(10_000, 10_011) if i != q][:10]


def test_balance_of_the_graph_partition():
    x = np.array([v for _, v in _rows(2000, 16, 3)])
    part = ann.balanced_parts(x, ann.neighbour_graph(x, 10), 16)
    size = np.bincount(part, minlength=16)
    assert size.min() >= 0.85 * 125 and size.max() <= 1.15 * 125


def test_rows_that_take_no_part_and_few_rows(spark, write_tables):
    odd = [(100, None), (200, [0.0, 0.0]), (300, [1.0, None]), (400, [1.0, float("nan")]), (500, [float("inf"), 1.0]), (None, [1.0, 1.0]),
           (600, [1.0]), (700, [])]
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0001]), (2, [5.0, 5.0])]
    got = op1_learned_partitions(spark, write_tables(embeddings=_frame(spark, rows + odd))).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in got) == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 2, 6.403124)]
    assert op1_learned_partitions(spark, write_tables(embeddings=_frame(spark, odd))).count() == 0
    assert op1_learned_partitions(spark, write_tables(embeddings=_frame(spark, []))).count() == 0


def test_rows_are_shuffled_once_whatever_the_number_of_queries(spark):
    """Index rows stay in their slice: what is dealt out is the rows once and each query once per slice that it visits."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6_000, 6))
    df = _frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    found = {}
    for every in (600, 20):
        out = ann.search(df, F.col("vec_id") % every == 0, slice_rows=500, query_rows=16, parts=4)
        got = {}
        for r in out.collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
        found[every] = got
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("sequence(0") == 1                          # only queries are repeated
    hits = 0
    for q, rows in found[20].items():
        near = {i for i, _ in ann.brute_force(np.arange(len(x)), x, q)}
        hits += len(near & {v for _, v in rows})
    assert hits >= 0.9 * 10 * len(found[20])
    assert all(found[20][q] == rows for q, rows in found[600].items())
