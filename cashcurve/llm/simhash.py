"""SimHash near-duplicates (operator 7): an inverted index over positional bytes, with count filtering.

*Fingerprint.*  Lower-case A-Z, split at blanks, take all shingles of ``shingle`` words (repeats included), hash each with
XXH64 (seed 42); a bit is set if it is set in more than half of the hashes.

*Guaranteed matches.*  Two 64-bit fingerprints that differ in at most d = 4 bits agree in at least 8 - d = 4 of their 8
positional bytes.  *Index.*  Postings are keyed by positional bytes.  One byte per key would make 2,048 lists that each
hold 1/256 of the corpus, so keys take three positions at once: any 4 of 8 positions contain one of the chosen
triples, so a pair that shares 4 positional bytes meets in some list.  *Count filter.*  For a pair that meets, the shared
positional bytes are tallied; pairs below the guaranteed minimum go; the others are verified by their bit distance.

*Skew.*  Copies collapse first: the index holds distinct fingerprints.  A list longer than ``long_list`` is refined: a
linked pair in it also agrees on one more position, so the list is replaced by the five lists of its members' next bytes;
after that, on one of five runs of the bits left.  A list never yields all its pairs: its members are searched by
breadth first, each new member against the ones not reached yet, and only the links of the search tree leave the task.

*Components.*  Links between distinct fingerprints are contracted: each fingerprint points to its smallest neighbour, chains
are shortened, edges move to the new names and shrink, until none is left.  Every round is checkpointed.

Defined results: null and empty texts have no words and fingerprint 0; fingerprint 0 links like any other; with fewer
than ``shingle`` words the whole sequence is the only shingle; repeated rows share a component; null ids are
kept, and a component of null ids only has a null component_id; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashcurve.llm.common import bound_batches, fresh, reliable, with_fields

BYTES = 8
_BITS = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def triples(groups: int = 3, positions: int = BYTES) -> list[tuple[int, int, int]]:
    """Triples of positions of which every set of 4 positions contains one.

    Deal the positions to three groups in a ring; take the triples inside a group and those of two from a group with
    one from the next.  Of 4 positions either 3 share a group, or 2 share one and some other is in the next group, or
    2 and 2 share groups of which one is the next of the other.
    """
    group = [p % groups for p in range(positions)]

    def taken(t: tuple[int, ...]) -> bool:
        a, b, c = sorted(group[p] for p in t)
        if a == c:
            return True
        if a != b and b != c:
            return False
        double, single = (a, c) if a == b else (c, a)
        return single == (double + 1) % groups

    return [t for t in itertools.combinations(range(positions), 3) if taken(t)]


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit fingerprint of a whole text; its shingles are hashed in slices."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    k = min(shingle, len(words))
    starts = [0, *ends][:len(words) - k + 1]
    stops = ends[k - 1:]
    ones, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), 65_536):
        h = np.array([digest(joined[a:b - 1], 42) for a, b in zip(starts[at:at + 65_536], stops[at:at + 65_536], strict=False)], dtype=np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text_col: str, shingle: int = 4, out: str = "fingerprint") -> DataFrame:
    """All columns but the text, plus the fingerprint as a signed long named ``out``."""
    bound_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), dtype=np.uint64, count=len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp)], [*batch.schema.names[:-1], out])

    return docs.select(*keep, text_col).mapInArrow(run, with_fields(docs.select(*keep).schema, (out, T.LongType())))


def _mask(positions) -> int:
    m = sum(0xFF << (8 * (BYTES - 1 - p)) for p in positions)
    return m - (1 << 64) if m >= 1 << 63 else m


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def postings(prints: DataFrame) -> DataFrame:
    """(mask, value, fp): the index entries of distinct fingerprints ``fp``; mask selects the positional bytes."""
    masks = F.array(*[F.lit(_mask(t)).cast("long") for t in triples()])
    return prints.select("fp", F.explode(masks).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")


def _finer_masks(mask: int, distance: int) -> list[int]:
    """Masks that extend ``mask`` so that a linked pair agreeing on ``mask`` agrees on one of them too.

    While fewer positional bytes are fixed than linked pairs must share: each further position.  After that the free
    bits are cut into distance + 1 runs, of which one has no differing bit.
    """
    unsigned = mask & ((1 << 64) - 1)
    fixed = [p for p in range(BYTES) if unsigned >> (8 * (BYTES - 1 - p)) & 0xFF == 0xFF]
    free = [b for b in range(63, -1, -1) if not unsigned >> b & 1]
    if len(fixed) < BYTES - distance and len(free) == 64 - 8 * len(fixed):
        return [_signed(unsigned | 0xFF << (8 * (BYTES - 1 - p))) for p in range(BYTES) if p not in fixed]
    if len(free) <= distance:
        return []
    return [_signed(unsigned | sum(1 << int(b) for b in run)) for run in np.array_split(free, distance + 1)]


def refine(index: DataFrame, distance: int, long_list: int, rounds: int = 8) -> DataFrame:
    """The index with its over-long lists replaced by finer ones, round after round while there are any."""
    done = []
    for _ in range(rounds):
        sizes = index.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > long_list)
        hot = reliable(sizes.select("mask", "value"))
        masks = [r["mask"] for r in hot.select("mask").distinct().collect()]        # at most the masks of this round
        finer = {m: _finer_masks(m, distance) for m in masks}
        if not any(finer.values()):
            break
        hot = hot.filter(F.col("mask").isin([m for m in masks if finer[m]]))
        done.append(index.join(hot, ["mask", "value"], "left_anti"))
        options = F.create_map(*[x for m in masks if finer[m] for x in (F.lit(m).cast("long"), F.array(*[F.lit(x).cast("long") for x in finer[m]]))])
        index = reliable(index.join(hot, ["mask", "value"], "left_semi").select("fp", F.explode(options[F.col("mask")]).alias("mask"))
                         .select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp").distinct())
    for part in done:
        index = index.unionByName(part)
    return index


def _close(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Tally the shared positional bytes of aligned pairs, keep the guaranteed minimum, verify the bits."""
    x = (a ^ b).view(np.uint8).reshape(len(a), BYTES)
    enough = (x == 0).sum(axis=1) >= BYTES - distance
    near = np.zeros(len(a), dtype=bool)
    near[enough] = _BITS[x[enough]].sum(axis=1) <= distance
    return near


def list_links(value: np.ndarray, fp: np.ndarray, distance: int, short: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the lists of a sorted stretch of postings (equal ``value`` = one list), enough to connect them."""
    left, right = [], []
    edge = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1], [True]]))
    length = np.diff(edge)
    rank = np.repeat(length, length)
    for gap in range(1, min(short, int(length.max(initial=0)))):
        at = np.flatnonzero((value[gap:] == value[:-gap]) & (rank[gap:] <= short))
        if len(at):
            near = at[_close(fp[at], fp[at + gap], distance)]
            left.append(fp[near])
            right.append(fp[near + gap])
    for k in np.flatnonzero(length > short):
        rest = fp[edge[k]:edge[k + 1]]
        queue: list = []
        while len(rest):
            if not queue:
                queue, rest = [rest[0]], rest[1:]
                continue
            one = queue.pop()
            near = _close(np.full(len(rest), one), rest, distance)
            if near.any():
                left.append(np.full(int(near.sum()), one))
                right.append(rest[near])
                queue.extend(rest[near])
                rest = rest[~near]
    none = np.empty(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def links(prints: DataFrame, distance: int = 4, long_list: int = 20_000) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect exactly what all links connect."""
    bound_batches(prints.sparkSession)
    index = refine(postings(prints), distance, long_list)
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None                                          # the last list may go on in the next batch
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                cols = [np.asarray(c) for c in batch.columns]
                held = cols if held is None else [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
            if held is None or not len(held[0]):
                continue
            mask, value, fp = held
            new = np.concatenate([[True], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])])
            cut = len(mask) if batch is None else int(np.flatnonzero(new)[-1])
            held = [x[cut:] for x in held]
            if cut:
                a, b = list_links(np.cumsum(new)[:cut], fp[:cut], distance)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=kind)

    return (index.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp").mapInArrow(run, "a long, b long").distinct())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): one root per connected component, found by contraction."""
    edges = reliable(edges.select("a", "b"))
    names = None
    for _ in range(rounds):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root"))
        point = reliable(point)
        while True:                                          # shorten chains: a root points to itself
            up = point.select(F.col("node").alias("root"), F.col("root").alias("up"))
            longer = reliable(point.join(up, "root").select("node", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")))
            point = longer.drop("moved")
            if longer.filter("moved").isEmpty():
                break
        to = lambda c: point.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        edges = reliable(edges.join(to("a"), "a").join(to("b"), "b").filter("a_root <> b_root")
                         .select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct())
        if names is None:
            names = point
        else:
            moved = names.join(point.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left")
            names = reliable(moved.select("node", F.coalesce("up", "root").alias("root")))
    else:
        raise RuntimeError("components: not settled")
    return names if names is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def group_fingerprints(prints: DataFrame, id_col: str, distance: int = 4, long_list: int = 20_000) -> DataFrame:
    """(fp, component_id) of every distinct fingerprint in ``prints`` (``id_col``, fp)."""
    distinct = reliable(prints.groupBy("fp").agg(F.min(id_col).alias("low")))
    roots = components(links(distinct.select("fp"), distance, long_list))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    low = named.filter("root is not null").groupBy("root").agg(F.min("low").alias("component_id"))
    return named.join(low, "root", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4,
                    long_list: int = 20_000) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = reliable(with_fingerprint(slim, "text", shingle, "fp"))
    groups = group_fingerprints(prints, "doc_id", distance, long_list)
    return prints.join(groups, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """One document, with all its columns, of each near-duplicate group: the one with the smallest id (null ids last).

    The decision is made on (id, text hashes, fingerprint) rows; the texts move once, to meet it.
    """
    k = [fresh(docs, f"key{i}") for i in range(2)]
    hashes = [F.xxhash64(text_col), F.xxhash64(F.lit("#"), text_col)]
    keyed = docs.select("*", hashes[0].alias(k[0]), hashes[1].alias(k[1]))
    slim = keyed.select(F.col(id_col).alias("doc_id"), F.col(k[0]).alias("k0"), F.col(k[1]).alias("k1"), F.col(text_col).alias("text"))
    prints = reliable(with_fingerprint(slim, "text", shingle, "fp"))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k0", "k1")
    first = reliable(prints.groupBy("fp").agg(F.min(row).alias("row")))        # copies are combined before any join
    roots = components(links(first.select("fp"), distance))
    named = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    kept = named.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("row").alias("row")).select("row.doc_id", "row.k0", "row.k1")
    chosen = kept.select(F.col("doc_id").alias("chosen_id"), F.col("k0").alias("chosen_0"), F.col("k1").alias("chosen_1"))
    on = keyed[id_col].eqNullSafe(chosen["chosen_id"]) & (keyed[k[0]] == chosen["chosen_0"]) & (keyed[k[1]] == chosen["chosen_1"])
    left = keyed.join(chosen, on, "left_semi")
    twice = reliable(prints.groupBy("doc_id", "k0", "k1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    if twice.isEmpty():
        return left.drop(*k)
    return left.dropDuplicates([id_col, *k]).drop(*k)
