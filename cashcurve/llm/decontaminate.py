"""Benchmark decontamination (operator 4): Wu-Manber multi-pattern search over words.

The alphabet of the search is the word: texts become sequences of lower-cased words, test items become windows of
ten consecutive words (an item with fewer, but at least one, is a single shorter window).  All patterns of one search
have the same length m.  A *shift table* maps each block of two adjacent words that occurs in some pattern to the
smallest distance from an occurrence of that block to the pattern's end; any other block lets the search jump
m - 1 words ahead.  Only where the shift is zero, the *suffix-hash bucket* of the block lists the patterns ending in it,
and each is compared word by word.  Shorter items form searches of their own, one per length, so that one short
item does not take away the jumps of the others.

Memory: the pattern tables are built per group of items whose distinct texts sum to at most ``group_bytes`` (about 80 bytes of
tables per byte of text, so 160 MB in each Python worker for the default).  The benchmark's size is measured before anything is collected.
A larger benchmark is searched in several passes, each with one broadcast group.  A pass writes the hits it finds, keyed by two hashes of
the text, and no text; the hits of all passes meet the documents once, at the end.

Defined results: null text has no words and no hits; a text without words gives n_words 0; null or word-less items
are not searched; a null item_id is reported as the string ``null``; repeated item ids count once per id; repeated
documents are separate rows; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashcurve.llm.common import bound_batches, fresh, per_batch, reliable, with_fields

#: Words are maximal runs of 0-9, a-z (after lower-casing A-Z) and all non-ASCII characters (fixed by contract).
_WORD_BYTES = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_FOLD = bytes(b if b in _WORD_BYTES else 0x20 for b in bytes(range(256)).lower())


def words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: one table lookup per byte (fold case, blank separators), then a split."""
    return text.translate(_FOLD).split()


def window_items(text: bytes, window: int) -> list[tuple[bytes, ...]]:
    w = words(text)
    if not w:
        return []
    if len(w) < window:
        return [tuple(w)]
    return [tuple(w[i:i + window]) for i in range(len(w) - window + 1)]


class WuManber:
    """Search for patterns of one length over word lists."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[int]]):
        self.m, self.block = length, min(2, length)
        self.jump = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for pat, items in patterns.items():
            for end in range(self.block, length + 1):
                key, far = self._key(pat, end), length - end
                if far < self.shift.get(key, self.jump):
                    self.shift[key] = far
            self.buckets.setdefault(self._key(pat, length), []).append((pat, items))

    def _key(self, seq, end: int):
        return seq[end - 1] if self.block == 1 else (seq[end - 2], seq[end - 1])

    def occurrences(self, w: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(start, item numbers) of every occurrence, by ascending start."""
        shift, jump, m, n, single = self.shift.get, self.jump, self.m, len(w), self.block == 1
        pos = m
        while pos <= n:
            step = shift(w[pos - 1] if single else (w[pos - 2], w[pos - 1]), jump)
            if not step:
                yield from self._confirm(w, pos)
                step = 1
            pos += step

    def _confirm(self, w: list[bytes], pos: int) -> Iterator[tuple[int, list[int]]]:
        start, seen = pos - self.m, None
        for pat, items in self.buckets.get(self._key(w, pos), ()):
            if pat[0] == w[start]:
                seen = seen or tuple(w[start:pos])
                if seen == pat:
                    yield start, items


def build_searches(items: list[tuple[str, bytes]], window: int) -> tuple[list[str], list[WuManber]]:
    """One search per window length over (item id, text) rows; returns the distinct ids and the searches."""
    ids = sorted({i for i, _ in items})
    number = {i: k for k, i in enumerate(ids)}
    by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
    for item, text in items:
        for pat in window_items(text, window):
            owners = by_length.setdefault(len(pat), {}).setdefault(pat, [])
            if number[item] not in owners:
                owners.append(number[item])
    return ids, [WuManber(n, by_length[n]) for n in sorted(by_length)]


def find_hits(w: list[bytes], searches: list[WuManber]) -> tuple[list[tuple[int, int]], set[int]]:
    """Merged, ascending [start, end) word ranges covered by occurrences, and the item numbers found."""
    spans, found = [], set()
    for s in searches:
        for start, items in s.occurrences(w):
            spans.append((start, start + s.m))
            found.update(items)
    return merge_ranges(spans), found


def merge_ranges(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_groups(benchmark: DataFrame, id_col: str, text_col: str, group_bytes: int) -> list[DataFrame]:
    """The benchmark as groups of (item, text) whose texts sum to about ``group_bytes`` at most."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"),
                            F.col(text_col).alias("text")).filter(F.col("text").isNotNull()).distinct()
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = 1 if total <= group_bytes else 2 * -(-total // group_bytes)
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [rows if n == 1 else rows.filter(part == k) for k in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = 10, group_bytes: int = 2 << 20) -> tuple[DataFrame, str]:
    """``docs`` with one more struct column, whose name is returned: n_words, ranges (hit word ranges), items.

    No shuffle if the benchmark is at most ``group_bytes``: the documents are scanned in place.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    out = fresh(docs, "contamination")
    groups = item_groups(benchmark, item_id, item_text, group_bytes)
    if len(groups) == 1:
        return docs.mapInArrow(_scanner(_tables(groups[0], window), text_col, out), with_fields(docs.schema, (out, _KIND))), out
    k1, k2, hits = fresh(docs, "text_k1"), fresh(docs, "text_k2"), fresh(docs, "contamination_hits")
    text = F.col(text_col)
    keyed = docs.withColumn(k1, F.xxhash64(text)).withColumn(k2, F.xxhash64(F.lit("#"), text))
    found = None
    for group in groups:
        tables = _tables(group, window)
        slim = keyed.filter(text.isNotNull()).select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), text.alias("text"))
        scanned = slim.mapInArrow(_scanner(tables, "text", "hit"), with_fields(slim.schema, ("hit", _KIND)))
        # copies of a text have the same hits
        own = reliable(scanned.filter(F.size("hit.ranges") > 0).select("k1", "k2", "hit").groupBy("k1", "k2").agg(F.first("hit").alias("hit")))
        found = own if found is None else found.unionByName(own)
        tables.unpersist()
    merged = found.groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.collect_list("hit").alias(hits))       # one per group at most
    plain = docs.columns
    df = keyed.join(merged, [k1, k2], "left").select(*plain, hits)
    return df.mapInArrow(_merger(text_col, out), with_fields(docs.schema, (out, _KIND))), out


_KIND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("ranges", T.ArrayType(T.ArrayType(T.IntegerType()))),
                      T.StructField("items", T.ArrayType(T.StringType()))])
_ARROW = pa.struct([("n_words", pa.int64()), ("ranges", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.string()))])


def _tables(group: DataFrame, window: int):
    rows = [(r["item"], r["text"].encode()) for r in group.collect()]
    return group.sparkSession.sparkContext.broadcast(build_searches(rows, window))


def _scanner(tables, text_col: str, out: str):
    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, searches = tables.value
        found = []
        for text in batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary()):
            w = words(text.as_py() or b"")
            ranges, items = find_hits(w, searches)
            found.append({"n_words": len(w), "ranges": ranges, "items": sorted(ids[k] for k in items)})
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _ARROW)], [*batch.schema.names, out])

    return per_batch(scan)


def _merger(text_col: str, out: str):
    """The last column, hits by group, becomes one struct."""
    def merge(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary())
        for text, hits in zip(texts, batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            ranges = merge_ranges([tuple(r) for h in hits or () for r in h["ranges"]])
            found.append({"n_words": len(words(text.as_py() or b"")), "ranges": ranges, "items": sorted({i for h in hits or () for i in h["items"]})})
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, _ARROW)], [*batch.schema.names[:-1], out])

    return per_batch(merge)


def contamination_report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text_col: str = "text",
                         **options) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, hit_ranges, items."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text_col).alias("text"))
    df, c = contamination(slim, benchmark, **options)
    col = F.col(c)
    n_hit = F.aggregate(col["ranges"], F.lit(0).cast("long"), lambda acc, r: acc + (r[1] - r[0]).cast("long"))
    return df.select("doc_id", col["n_words"].alias("n_words"), n_hit.alias("n_hit"),
                     F.size(col["items"]).cast("long").alias("n_items"),
                     F.sha2(F.array_join(col["items"], ","), 256).alias("items_sha256"),
                     (n_hit > 0).alias("contaminated"), col["ranges"].alias("hit_ranges"), col["items"].alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents, with all their columns, in which no benchmark window occurs."""
    df, c = contamination(docs, benchmark, text_col=text_col, **options)
    return df.filter(F.size(F.col(c)["ranges"]) == 0).drop(c)


def brute_force(text: str | None, items: list[tuple[str, str]], window: int = 10) -> tuple[int, int, int, str]:
    """Reference answer for tests: every window compared at every position."""
    w = words((text or "").encode())
    hit, found = set(), set()
    for item, t in items:
        for pat in window_items((t or "").encode(), window):
            for i in range(len(w) - len(pat) + 1):
                if tuple(w[i:i + len(pat)]) == pat:
                    hit.update(range(i, i + len(pat)))
                    found.add(item)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
