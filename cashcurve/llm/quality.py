"""Quality classifier (operator 2): random-indexing word vectors, pooled per document, and a two-layer network.

*Random indexing.*  Every word bucket owns a fixed sparse random index vector (a few +1/-1 entries).  A word's vector
is the sum of the index vectors of its neighbours, within ``window`` words, over the whole corpus, so words used
alike get alike vectors without any factorisation.  Words (and runs of punctuation) are hashed into ``buckets``, which
bounds the table (buckets x dimensions) whatever the corpus; each task sums its rows into one such table, and the
tables are added blockwise in two shuffles, so no task ever holds more than its blocks.

*Pooling.*  A document is the mean and the spread of its word vectors, the length of the mean (repetition makes it long) and its
size on a log scale.

*Network.*  inputs -> tanh layer -> one logit, trained in numpy on at most ``max_docs`` labelled documents of the
training folds; a temperature, fitted on a fifth of them that the network did not see, calibrates the probabilities.

Defined results: null and empty texts pool to zeros and are scored like any other; with fewer than two training
labels of either class every score is the smoothed share of label 1; repeated rows are scored one by one; labels
given twice count once, the largest; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashcurve.llm.common import bound_batches, one_per_id

TOKEN = re.compile(r"\w+|[^\w\s]+")


@dataclass(frozen=True)
class Space:
    """Sizes of the random-indexing space; ``nonzero`` entries per index vector."""

    buckets: int = 8192
    dimensions: int = 48
    nonzero: int = 4
    window: int = 2
    block: int = 256

    def index_vectors(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(20_240_229)
        where = np.argsort(rng.random((self.buckets, self.dimensions)), axis=1)[:, :self.nonzero]
        return where.astype(np.int64), rng.choice(np.array([-1.0, 1.0]), (self.buckets, self.nonzero))


class _Buckets(dict):
    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, token: str) -> int:
        self[token] = b = zlib.crc32(token.encode("utf-8", "surrogatepass")) % self.n
        return b


def bucket_ids(text: str | None, cache: _Buckets) -> np.ndarray:
    tokens = TOKEN.findall(text or "")
    return np.fromiter(map(cache.__getitem__, tokens), dtype=np.int64, count=len(tokens))


def add_contexts(table: np.ndarray, ids: list[np.ndarray], space: Space, where: np.ndarray, sign: np.ndarray) -> None:
    """Add every word's neighbours' index vectors to the word's row; texts are kept apart."""
    gap = np.full(space.window, -1, dtype=np.int64)
    flat = np.concatenate([x for t in ids for x in (t, gap)]) if ids else gap
    size = space.buckets * space.dimensions
    for off in range(1, space.window + 1):
        a, b = flat[:-off], flat[off:]
        both = (a >= 0) & (b >= 0)
        for word, near in ((a[both], b[both]), (b[both], a[both])):
            for k in range(space.nonzero):
                table += np.bincount(word * space.dimensions + where[near, k], weights=sign[near, k], minlength=size)


def word_vectors(docs: DataFrame, text_col: str, space: Space) -> np.ndarray:
    """Unit word vectors (buckets x dimensions) from ALL documents."""
    bound_batches(docs.sparkSession)
    row = pa.schema([("block", pa.int32()), ("salt", pa.int32()), ("v", pa.binary())])
    per_block = space.block * space.dimensions

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(space.buckets * space.dimensions)
        where, sign = space.index_vectors()
        cache, salt = _Buckets(space.buckets), 0
        for batch in batches:
            ids, n = [], 0
            for text in batch.column(0):
                ids.append(bucket_ids(text.as_py(), cache))
                n += len(ids[-1])
                salt = (salt * 31 + n) % 64
                if n > 1_000_000:
                    add_contexts(table, ids, space, where, sign)
                    ids, n = [], 0
            add_contexts(table, ids, space, where, sign)
            if len(cache) > 300_000:
                cache.clear()
        for k, part in enumerate(table.reshape(-1, per_block)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": [k], "salt": [salt], "v": [part.astype(np.float32).tobytes()]}, row)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, salt, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(v, dtype=np.float32).astype(np.float64)
                sums[k, salt] = sums[k, salt] + x if (k, salt) in sums else x
        for (k, salt), x in sums.items():
            yield pa.RecordBatch.from_pydict({"block": [k], "salt": [salt], "v": [x.astype(np.float32).tobytes()]}, row)

    kind = "block int, salt int, v binary"
    parts = docs.select(text_col).mapInArrow(collect, kind)
    parts = parts.repartition("block", "salt").mapInArrow(add, kind)
    sums = parts.withColumn("salt", F.lit(0)).repartition("block").mapInArrow(add, kind).collect()  # buckets / block rows
    table = np.zeros((space.buckets // space.block, per_block))
    for r in sums:
        table[r["block"]] = np.frombuffer(r["v"], dtype=np.float32)
    table = table.reshape(space.buckets, space.dimensions)
    table = np.sign(table) * np.sqrt(np.abs(table))            # damp the commonest neighbours
    norms = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(norms > 0, norms, 1)).astype(np.float32)


def pool(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean, spread, length of the mean, log size of one document (whole text, in slices)."""
    d = vectors.shape[1]
    if not len(ids):
        return np.zeros(2 * d + 2, dtype=np.float32)
    total, squares = np.zeros(d), np.zeros(d)
    for at in range(0, len(ids), 65_536):
        v = vectors[ids[at:at + 65_536]]
        total += v.sum(0)
        squares += np.einsum("ij,ij->j", v, v)
    mean = total / len(ids)
    spread = np.sqrt(np.maximum(squares / len(ids) - mean * mean, 0))
    return np.concatenate([mean, spread, [np.linalg.norm(mean), np.log1p(len(ids)) / 10]]).astype(np.float32)


@dataclass
class QualityModel:
    vectors: np.ndarray
    space: Space
    center: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: tuple[np.ndarray, ...] = ()
    temperature: float = 1.0
    prior: float = 0.5

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.center) / self.scale @ w1 + b1) @ w2 + b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-(self.logits(x) / self.temperature).clip(-40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, batch: int = 128, rate: float = 3e-3,
                decay: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, ...]:
    """Two layers trained with Adam on the log loss."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    p = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(max(epochs, -(-2_000 * batch // max(n, 1)) if n < 4_000 else epochs)):
        for rows in np.array_split(rng.permutation(n), max(1, n // batch)):
            h = np.tanh(x[rows] @ p[0] + p[1])
            e = (1 / (1 + np.exp(-(h @ p[2] + p[3]).clip(-40, 40))) - y[rows]) / len(rows)
            back = np.outer(e, p[2]) * (1 - h * h)
            t += 1
            for k, g in enumerate((x[rows].T @ back + decay * p[0], back.sum(0), h.T @ e + decay * p[2], np.array([e.sum()]))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
    return tuple(p)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature, on a log grid, of the smallest log loss."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 121))
    losses = [np.mean(np.logaddexp(0, -(2 * y - 1) * logits / t)) for t in grid]
    return float(grid[int(np.argmin(losses))])


def pooled(docs: DataFrame, text_col: str, vectors, space: Space) -> DataFrame:
    """All columns but the text, plus ``pooled``: the document's inputs to the network."""
    keep = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Buckets(space.buckets)
        for batch in batches:
            rows = [pool(bucket_ids(x.as_py(), cache), vectors.value).tolist() for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(pa.float32()))], [*batch.schema.names[:-1], "pooled"])
            if len(cache) > 300_000:
                cache.clear()

    return docs.select(*keep, text_col).mapInArrow(run, docs.select(*keep).schema.add("pooled", T.ArrayType(T.FloatType())))


def train(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", max_docs: int = 20_000, space: Space = Space()) -> QualityModel:  # noqa: B008 - frozen
    """Word vectors from all documents; network and temperature from up to ``max_docs`` labelled ones.

    ``allowed`` is a condition on the labels' id column (the training folds); the labelled rows taken are
    those with the smallest hash of their id.
    """
    spark = docs.sparkSession
    vectors = word_vectors(docs, text_col, space)
    model = QualityModel(vectors, space)
    picked = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & allowed)
              .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
              .orderBy(F.xxhash64("id"), "id").limit(max_docs))
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    rows = pooled(one_per_id(sample.select(F.col("id").cast("string").alias("id"), "y", "text")).select("id", "y", "text"), "text",
                  spark.sparkContext.broadcast(vectors), space).collect()
    rows = sorted(rows, key=lambda r: (zlib.crc32(r["id"].encode()), r["id"]))
    y = np.array([r["y"] for r in rows], dtype=float)
    model.prior = float((y.sum() + 1) / (len(y) + 2))
    if min(y.sum(), len(y) - y.sum()) < 2:
        return model
    x = np.array([r["pooled"] for r in rows], dtype=np.float64)
    tune = np.arange(len(y)) % 5 == 0
    model.center, model.scale = x.mean(0), x.std(0) + 1e-6
    z = (x - model.center) / model.scale
    model.layers = fit_network(z[~tune], y[~tune])
    if 0 < y[tune].sum() < tune.sum():
        model.temperature = fit_temperature(model.logits(x[tune]), y[tune])
    return model


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """All columns but the text, plus score and predicted; one map over the scan."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        cache = _Buckets(model.space.buckets)
        for batch in batches:
            x = np.array([pool(bucket_ids(t.as_py(), cache), model.vectors) for t in batch.column(batch.num_columns - 1)], dtype=np.float64)
            p = model.probability(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, pa.float64()), pa.array((p >= cut).astype(np.int32))],
                                             [*batch.schema.names[:-1], "score", "predicted"])
            if len(cache) > 300_000:
                cache.clear()

    return docs.select(*keep, text_col).mapInArrow(run, docs.select(*keep).schema.add("score", "double").add("predicted", "integer"))
