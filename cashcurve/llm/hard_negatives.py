"""Hard-negative mining (operator 12): Strassen products of anchor and candidate tiles, and mergeable heaps.

Vectors become whole numbers, so every score is an exact integer.  The scores of a tile of anchors and a tile of candidates are one matrix
product, by Strassen's recursion on int64: seven half-size products and integer additions, on tiles padded with zeros.  int64
additions and products wrap, and wrapping is a ring homomorphism, so all sums inside the recursion cancel exactly and a score is right
whenever the score itself fits in 64 bits (components are held within +-2^24, which guarantees it).  The smallest
products run in double precision if the bound of their sums is below 2^53, where doubles are exact, else in int64.

Two passes over the tiles: the first fills, per anchor, a heap of its best rows of the same label; the second, per anchor and
positive, a heap of the best rows of other labels whose score lies in the positive's window.  A task's heaps hold at most ``positives`` or
``negatives`` entries, and heaps of different tasks are merged by keeping the first of their union in the same order.

*Slices stay, anchors move.*  Candidates are cut by a hash of the row into slices of about ``slice_rows``; every row is in one
slice.  The anchors are the stated query set, and each slice meets them all, in blocks, as a stream: a task holds one slice and one block of
anchors, whatever the table's size, the labels or the copies of one vector.

Defined results: rows with a null id, a null label, a null vector, or a null or non-finite component take no part; vectors of different
lengths are padded with zeros, an empty one is all zeros; components beyond +-2^24 after scaling count as that bound; rows that repeat an id are
rows of their own, and only an anchor's own row is not its candidate; an anchor without positives, or a positive without negatives in its
window, gives no row; ties go to the smaller id; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashcurve.llm.common import bound_batches, reliable

LARGEST = 1 << 24
LEAF = 16


def multiply(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices by Strassen's recursion (exact modulo 2^64)."""
    m, k = a.shape
    n = b.shape[1]
    if not (m and k and n):
        return np.zeros((m, n), dtype=np.int64)
    depth = 0
    while min(m, k, n) >> (depth + 1) >= leaf:
        depth += 1
    unit = 1 << depth
    with np.errstate(over="ignore"):
        return _strassen(_padded(a, unit), _padded(b, unit), depth)[:m, :n]


def _padded(x: np.ndarray, unit: int) -> np.ndarray:
    """Zero rows and columns up to multiples of ``unit``."""
    more = [(0, -size % unit) for size in x.shape]
    return np.pad(x, more) if any(extra for _, extra in more) else x


def _strassen(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    if depth == 0:
        return _product(a, b)
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2  # noqa: E741
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = _strassen(a11 + a22, b11 + b22, depth - 1)
    p2 = _strassen(a21 + a22, b11, depth - 1)
    p3 = _strassen(a11, b12 - b22, depth - 1)
    p4 = _strassen(a22, b21 - b11, depth - 1)
    p5 = _strassen(a11 + a12, b22, depth - 1)
    p6 = _strassen(a21 - a11, b11 + b12, depth - 1)
    p7 = _strassen(a12 - a22, b21 + b22, depth - 1)
    out = np.empty((2 * i, 2 * l), dtype=np.int64)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A leaf's product: in doubles if no sum can reach 2^53, else in int64."""
    top = [max(int(x.max()), -int(x.min())) for x in (a, b)]
    if top[0] * top[1] * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def prepared(rows: DataFrame, anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256,
             slice_rows: int = 8_192) -> tuple[DataFrame, int]:
    """row, id, label, is_anchor, slice, v (whole numbers) of the rows that take part, checkpointed; and the number of slices.

    ``anchor`` and ``label`` are conditions on the columns of ``rows``.
    """
    v = F.col(vector_col)
    usable = (F.col(id_col).isNotNull() & label.isNotNull() & v.isNotNull()
              & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    # bounded before the cast, so that no component overflows it
    edge = F.lit(float(LARGEST))
    whole = F.transform(v, lambda x: F.floor(F.greatest(-edge, F.least(edge, x.cast("double") * scale))).cast("int"))
    kept = rows.filter(F.coalesce(usable, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"), whole.alias("v"))
    kept = reliable(kept.withColumn("row", F.monotonically_increasing_id()))
    slices = max(1, ceil(kept.count() / slice_rows))
    return kept.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int")), slices


def _matrix(column: pa.ListArray) -> np.ndarray:
    """A list column as a matrix, short rows padded with zeros."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), dtype=np.int64)
    width = int(sizes.max(initial=0))
    if len(flat) == width * len(sizes):
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of all anchors and all candidates."""
    width = min(anchors.shape[1], candidates.shape[1])                # what only one side has is multiplied by zeros
    return multiply(np.ascontiguousarray(anchors[:, :width]), np.ascontiguousarray(candidates[:, :width].T))


def _first(order_id: np.ndarray, scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the columns ``at``, the k with the highest scores; ties by smaller id."""
    if len(at) > 4 * k:                                               # only those that reach the k-th score are sorted
        s = scores[at]
        at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return at[np.lexsort((order_id[at], -scores[at]))[:k]]


_WINDOWS = "array<struct<place:int,id:long,score:long>>"


def _tiles(slim: DataFrame, anchors: DataFrame, slices: int, schema: str, block_rows: int, heaps) -> DataFrame:
    """``heaps(block, candidates, scores)`` of every block of anchors and slice of candidates.

    Rows are dealt by slice and sorted, candidates first, so a task reads a slice into memory and then lets the anchors pass.
    """
    candidates = slim.select("slice", F.lit(0).alias("kind"), "row", "id", "label", "v", F.lit(None).cast(_WINDOWS).alias("windows"))
    # every slice meets the stated query set
    moving = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(1).alias("kind"), "row", "id", "label", "v", "windows")
    both = candidates.unionByName(moving).repartition(slices, "slice").sortWithinPartitions("slice", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tile, pending = None, [], None
        for batch in batches:
            column = np.asarray(batch.column(0)) * 2 + np.asarray(batch.column(1))
            edges = [0, *(np.flatnonzero(np.diff(column)) + 1).tolist(), len(column)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                where, kind = int(column[a]) // 2, int(column[a]) % 2
                if where != now:
                    now, tile, pending = where, [], None
                if kind == 0:
                    tile.append(part)
                    continue
                if not tile:
                    continue                                          # a slice without candidates
                if pending is None:
                    table = pa.Table.from_batches(tile).combine_chunks()
                    pending = (np.asarray(table["row"]), np.asarray(table["id"]), np.asarray(table["label"]), _matrix(table["v"].chunk(0)))
                for at in range(0, part.num_rows, block_rows):
                    block = part.slice(at, block_rows)
                    yield from heaps(block, pending, _scores(_matrix(block.column(5)), pending[3]))

    return both.mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "place" else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)


def positives(slim: DataFrame, slices: int, k: int, block_rows: int = 256) -> DataFrame:
    """row, windows: per anchor its ``k`` first other rows of the same label, as (place, id, score)."""
    names = ["row", "id", "score", "other"]

    def heaps(block, tile, scores):
        rows, ids, labels, _ = tile
        out = []
        for i, (row, label) in enumerate(zip(block.column(2).to_pylist(), block.column(4).to_pylist(), strict=True)):
            at = np.flatnonzero((labels == label) & (rows != row))
            at = _first(ids, scores[i], at, k)
            out += [(row, int(ids[j]), int(scores[i, j]), int(rows[j])) for j in at]
        yield from _batch(out, names)

    anchors = slim.filter("is_anchor").withColumn("windows", F.lit(None).cast(_WINDOWS))
    found = _tiles(slim, anchors, slices, "row long, id long, score long, other long", block_rows, heaps)
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "id", "other"))
    merged = found.withColumn("place", place).filter(F.col("place") <= k)
    return merged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("windows"))   # k entries


def mine(rows: DataFrame, anchor: Column, label: Column, k_positives: int = 5, k_negatives: int = 10, lowest: int = 30, highest: int = 90,
         id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, slice_rows: int = 8_192, block_rows: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A negative's score lies between ``lowest`` and ``highest`` percent of the positive's.
    """
    bound_batches(rows.sparkSession)
    slim, slices = prepared(rows, anchor, label, id_col, vector_col, scale, slice_rows)
    found = reliable(positives(slim, slices, k_positives, block_rows))
    names = ["anchor", "place", "score", "id", "anchor_id", "positive_id", "positive_score"]

    def heaps(block, tile, scores):
        rows, ids, labels, _ = tile
        out = []
        columns = (block.column(c).to_pylist() for c in (2, 3, 4, 6))
        for i, (row, name, label, windows) in enumerate(zip(*columns, strict=True)):
            other = np.flatnonzero(labels != label)
            values = scores[i]
            for w in windows:
                low, high = -(-lowest * w["score"] // 100), highest * w["score"] // 100      # whole scores of the window
                inside = other[(values[other] >= low) & (values[other] <= high)]
                out += [(row, w["place"], int(values[j]), int(ids[j]), name, w["id"], w["score"]) for j in _first(ids, values, inside, k_negatives)]
        yield from _batch(out, names)

    anchors = slim.filter("is_anchor").join(found, "row")
    schema = "anchor long, place int, score long, id long, anchor_id long, positive_id long, positive_score long"
    mined = _tiles(slim, anchors, slices, schema, block_rows, heaps)
    rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id"))
    merged = mined.withColumn("rank", rank).filter(F.col("rank") <= k_negatives)
    return merged.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
                         F.col("score").alias("negative_score"))
