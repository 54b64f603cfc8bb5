"""Approximate nearest neighbours (operator 1): learned partitions.

Fit, on a bounded sample (``sample_rows`` rows with the smallest id hashes): the exact neighbour graph of the sample, a
balanced partitioning of that graph (bisection along principal directions, then moves that cut fewer edges while
parts stay within the balance), and a two-layer softmax classifier trained to predict, for a vector, the share of its graph
neighbours in each part.

Index: the classifier puts EVERY row into its most probable part.  Search: a query goes to its most probable parts,
until their predicted shares sum to ``mass`` and they hold more than 4 k rows; as the classifier predicts where neighbours are, ``mass`` steers recall on
data with and without clusters alike.  All candidates there are compared exactly, in double precision.

Slices: a part is cut into slices of about ``slice_rows`` rows by a hash of the id, so that a part (or one vector's copies)
holding most rows is spread over many tasks.  Every row lies in one slice and stays there; the queries, which are few, go to the slices of
their parts and pass them as a stream.  A task holds one slice and ``query_rows`` queries, and gives the k best per query and slice.

Defined results: rows with a null id, a null, zero, or differently long vector, or null or non-finite components
take no part; a repeated id is one query (its smallest vector) and its rows are not its own candidates; fewer than k
candidates give all of them; empty tables give empty results; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashcurve.llm.common import bound_batches, per_batch


@dataclass
class Router:
    """Small classifier: vector -> predicted share of its neighbours in each part."""

    center: np.ndarray
    scale: float
    layers: tuple[np.ndarray, ...]

    @property
    def parts(self) -> int:
        return len(self.layers[3])

    def shares(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        z = np.tanh((x - self.center) / self.scale @ w1 + b1) @ w2 + b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Exact k nearest sample rows of each sample row, in row blocks."""
    k = min(k, len(x) - 1)
    square, out = (x * x).sum(axis=1), np.empty((len(x), k), dtype=np.int64)
    for at in range(0, len(x), 1024):
        d = square[at:at + 1024, None] + square - 2 * x[at:at + 1024] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out[at:at + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 0.1, rounds: int = 12) -> np.ndarray:
    """Part of each row: halves along principal directions, then moves to the part with most graph neighbours."""
    pieces = [np.arange(len(x))]
    while len(pieces) < parts:
        rows = pieces.pop(max(range(len(pieces)), key=lambda i: (len(pieces[i]), -i)))
        direction = np.linalg.svd(x[rows] - x[rows].mean(axis=0), full_matrices=False)[2][0]
        rows = rows[np.argsort(x[rows] @ direction, kind="stable")]
        pieces += [rows[:len(rows) // 2], rows[len(rows) // 2:]]
    part = np.zeros(len(x), dtype=np.int64)
    for i, rows in enumerate(pieces):
        part[rows] = i
    own = np.repeat(np.arange(len(x)), graph.shape[1])
    ends = np.concatenate([own, graph.ravel()]), np.concatenate([graph.ravel(), own])
    mean = len(x) / parts
    for _ in range(rounds):
        near = np.zeros((len(x), parts))
        np.add.at(near, (ends[0], part[ends[1]]), 1)
        gain = near - near[np.arange(len(x)), part][:, None]
        to, best, size, moved = gain.argmax(axis=1), gain.max(axis=1), np.bincount(part, minlength=parts), 0
        for i in np.argsort(-best, kind="stable"):
            if best[i] <= 0:
                break
            if size[to[i]] < mean * (1 + slack) and size[part[i]] > mean * (1 - slack):
                size[part[i]] -= 1
                size[to[i]] += 1
                part[i] = to[i]
                moved += 1
        if not moved:
            break
    return part


def fit_router(x: np.ndarray, parts: int, neighbours: int = 10, hidden: int = 64, epochs: int = 20, seed: int = 11) -> Router:
    """Graph, partition and classifier on the sample ``x``."""
    rng = np.random.default_rng(seed)
    graph = neighbour_graph(x, neighbours)
    part = balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph.ravel()]), 1 / graph.shape[1])
    center, scale, d = x.mean(axis=0), float(x.std()) or 1.0, x.shape[1]
    z = (x - center) / scale
    p = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            h = np.tanh(z[rows] @ p[0] + p[1])
            s = h @ p[2] + p[3]
            s = np.exp(s - s.max(axis=1, keepdims=True))
            e = (s / s.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            back = e @ p[2].T * (1 - h * h)
            t += 1
            for k, g in enumerate((z[rows].T @ back, back.sum(0), h.T @ e, e.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 3e-3 * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
    return Router(center, scale, tuple(p))


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """An Arrow column of equally long lists as a double matrix."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), dimensions)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part, with the commonest vector length only."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
            .filter(F.col("vec_id").isNotNull() & v.isNotNull()).filter(finite & F.exists(v, lambda x: x != 0)))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (common["d"] if common else 0))


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
           mass: float = 0.95, sample_rows: int = 8_000, parts: int | None = None, slice_rows: int = 8_192,
           query_rows: int = 1_024) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of each query's k nearest found; ``is_query`` is a condition
    on the column ``vec_id``."""
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = usable(vectors, id_col, vector_col)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()
    if len(sample) < 3:
        sample = []
    n = rows.count()
    x = np.array([r["v"] for r in sample], dtype=np.float64)
    d = x.shape[1] if len(sample) else 1
    if parts is None:        # parts of growing size, as many as the sample can tell apart
        parts = max(1, min(int(round(n ** 0.5 / 7)), len(sample) // 50))
    router = fit_router(x, parts) if len(sample) and parts > 1 else Router(np.zeros(d), 1.0, (np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)))
    shared = spark.sparkContext.broadcast(router)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        part = shared.value.shares(matrix(batch.column(1), d)).argmax(axis=1) if shared.value.parts > 1 else np.zeros(len(batch), dtype=np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], ["vec_id", "v", "part"])

    def route(batch: pa.RecordBatch) -> pa.RecordBatch:
        shares = shared.value.shares(matrix(batch.column(1), d)) if shared.value.parts > 1 else np.ones((len(batch), 1))
        order = np.argsort(-shares, axis=1, kind="stable")
        enough = (np.cumsum(np.take_along_axis(shares, order, 1), axis=1) >= mass) & (np.cumsum(rows_in[order], axis=1) > 4 * k)
        need = np.where(enough.any(axis=1), enough.argmax(axis=1) + 1, order.shape[1])
        probes = pa.array([o[:n].tolist() for o, n in zip(order, need, strict=True)], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([*batch.columns, probes], ["query_id", "q", "parts"])

    placed = rows.mapInArrow(per_batch(place), "vec_id long, v array<double>, part int")
    sizes = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}            # one row per part
    rows_in = np.array([sizes.get(p, 0) for p in range(parts)])
    queries = rows.filter(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))
    slices = F.create_map(*[c for p in range(parts) for c in (F.lit(p), F.lit(max(1, -(-sizes.get(p, 0) // slice_rows))))])
    routed = (queries.mapInArrow(per_batch(route), "query_id long, q array<double>, parts array<int>")
              .select(F.col("query_id").alias("id"), F.col("q").alias("v"), F.explode("parts").alias("part"))
              .select("part", F.explode(F.sequence(F.lit(0), slices[F.col("part")] - 1)).alias("slice"), F.lit(1).alias("kind"), "id", "v"))
    indexed = placed.select("part", F.pmod(F.xxhash64("vec_id", "v"), slices[F.col("part")]).cast("int").alias("slice"), F.lit(0).alias("kind"),
                            F.col("vec_id").alias("id"), "v")
    met = indexed.unionByName(routed).repartition("part", "slice").sortWithinPartitions("part", "slice", "kind")

    def pass_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a slice come first, then the queries that visit it."""
        now, rows_here = None, []
        for batch in batches:
            column = (np.asarray(batch.column(0)).astype(np.int64) << 32 | np.asarray(batch.column(1))) * 2 + np.asarray(batch.column(2))
            edges = [0, *(np.flatnonzero(np.diff(column)) + 1).tolist(), len(column)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                where, kind = divmod(int(column[a]), 2)
                if where != now:
                    now, rows_here = where, []
                part = pa.Table.from_batches([batch.slice(a, b - a).select([3, 4])])
                if kind == 0:
                    rows_here.append(part.rename_columns(["vec_id", "v"]))
                elif rows_here:
                    rows_here = [pa.concat_tables(rows_here).combine_chunks()]
                    for at in range(0, part.num_rows, query_rows):
                        yield from nearest(rows_here[0], part.slice(at, query_rows).rename_columns(["query_id", "q"]), k, d).to_batches()

    found = met.mapInArrow(pass_by, "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(v: pa.Table, q: pa.Table, k: int, d: int) -> pa.Table:
    """The k nearest rows of ``v`` for each query, by exact distance; a fast product form only discards the far ones."""
    ids, queries = v.column("vec_id").to_numpy(), q.column("query_id").to_numpy()
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(ids) and len(queries):
        x, y = matrix(v.column("v").combine_chunks(), d), matrix(q.column("q").combine_chunks(), d)
        square, size = (x * x).sum(axis=1), (y * y).sum(axis=1)
        for at in range(0, len(y), 128):
            rough = size[at:at + 128, None] + square - 2 * y[at:at + 128] @ x.T
            for i, row in enumerate(rough, start=at):
                others = ids != queries[i]
                row = np.where(others, row, np.inf)
                limit = np.partition(row, min(k, len(row)) - 1)[min(k, len(row)) - 1]
                slack = 1e-9 * (size[i] + square.max())
                near = np.flatnonzero((row <= limit + slack) & others)
                score = np.sqrt(((x[near] - y[i]) ** 2).sum(axis=1))
                pick = np.lexsort((ids[near], score))[:k]
                out.append((np.full(len(pick), queries[i]), ids[near][pick], score[pick]))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, dtype=np.int64)] * 2 + [np.empty(0)]
    return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})


def brute_force(ids: np.ndarray, x: np.ndarray, query: int, k: int = 10) -> list[tuple[int, float]]:
    """Reference answer for tests and for measuring recall: the k nearest other rows."""
    at = int(np.flatnonzero(ids == query)[0])
    score = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, score)) if ids[i] != query][:k]
    return [(int(ids[i]), float(score[i])) for i in order]
