"""Packing (operator 13): documents into training sequences, by non-negative least squares over length combinations.

*Tokens.*  Every text is tokenised once; the ids, ended by ``end_id``, are stored with their row in the shared folder, and so are the CRC-32
of the document's full windows and of its rest.  A document of at least one window gives full sequences; what is left of it, shorter than a
window, is its rest.

*Patterns.*  Rest lengths are counted in bins of ``step`` tokens, rounded up.  Shallow combinations of bins that fill a window exactly (up to
three rests, or any number up to ``deepest`` of at most two bins) are the columns of a matrix, and non-negative least squares finds
how often to repeat each so that together they use the histogram up.  The repeats are rounded down within what each bin has, after a
share of every bin is set aside.  Only the histogram (window / step numbers) reaches the driver.

*Placing.*  The rests of a bin are numbered, part by part, and the first of them take the places of the patterns, whole and uncut.

*Residuals.*  All other rests are laid end to end and cut where a sequence is full: first into the slack that rounding up has left in the
pattern sequences, then into windows of their own; the few tokens after the last full window become sequences of powers of two, which
need no padding.  Both the slack and the residual tokens are intervals on one line, so they meet by position, in blocks of bounded
length, and are cut by one window function per block.  Padding is left only where pattern sequences have more slack than there are residual
tokens, and the repeats are lowered beforehand so that this is not expected.

Numbers (of rests in a bin, of sequences, of tokens on the line) are running sums inside a stored part plus the sums of the parts before, so
no task numbers more than a part.

Defined results: a null text is an empty one, and an empty one is the end id alone; very long texts are read whole; rows repeated under one id
are packed one by one; null ids stay null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashcurve.llm.common import bound_batches, reliable
from cashcurve.session import checkpoint_dir

MODEL_PATH = public_tokenizers.path("word_bpe_49k.json")
_LETTERS, _SIGNS = "a-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
#: Texts of these letters, digits, signs and blanks fall apart at every change of class and at every digit, whatever stands beside them.
_PLAIN, _CUT = f"^[{_LETTERS}0-9{_SIGNS} \n]*$", f"([0-9]|[{_SIGNS}]+)"


class RunIds:
    """Ids of texts by way of their runs of letters or signs; runs met before come from a bounded memory.

    The tokenizer takes runs of letters, runs of signs and single digits as words of their own, so a plain text's ids are those of its runs.
    Run k's ids lie in one pool, from ``ends[k]`` to ``ends[k + 1]``.  New runs are tokenised many at a time: each has exactly one id that ends a
    word, its last.  Any other text (further scripts, apostrophes, names of special tokens) is tokenised as it is.
    """

    def __init__(self, path: str, remember: int = 700_000, remember_ids: int = 4_000_000, word_end: str = "</w>"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.remember, self.remember_ids = remember, remember_ids
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for name, i in vocabulary.items() if name.endswith(word_end)]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.pool, self.ends = array("i"), array("q", [0, 0])

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, runs: list[str]) -> None:
        known = self.known
        new = [r for r in runs if r not in known]
        if new and (len(known) + len(new) > self.remember or len(self.pool) > self.remember_ids):
            self.forget()
            known = self.known
            new = [r for r in runs if r]
        lines = [" ".join(new[at:at + 64]) for at in range(0, len(new), 64)]
        ids = np.fromiter(chain.from_iterable(self.library(lines)), dtype=np.int32)
        last = np.flatnonzero(self.ends_word[ids]) + 1
        if len(last) != len(new):
            raise AssertionError("a run that is not one word")
        known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        first = self.ends[-1]
        self.ends.frombytes((last + first).astype(np.int64).tobytes())
        self.pool.frombytes(ids.tobytes())

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every text (a null text has none)."""
        texts = pc.fill_null(texts, "")
        low = pc.ascii_lower(texts)
        plain = pc.and_(pc.match_substring_regex(low, _PLAIN), pc.invert(pc.match_substring(low, "<|")))
        spaced = pc.replace_substring_regex(pc.replace_substring(low.filter(plain), "\n", " "), _CUT, r" \1 ")
        lists = pc.split_pattern(spaced, " ")
        names = lists.flatten().dictionary_encode()
        distinct = names.dictionary.to_pylist()
        self.learn(distinct)
        number = np.fromiter(map(self.known.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        which = number[np.asarray(names.indices)]
        ends = np.frombuffer(self.ends, dtype=np.int64)
        first, size = ends[which], ends[which + 1] - ends[which]
        edge = np.concatenate([[0], np.cumsum(size)])
        total = int(edge[-1])
        ids = np.frombuffer(self.pool, dtype=np.int32)[np.repeat(first - edge[:-1], size) + np.arange(total)] if total else np.empty(0, np.int32)
        starts = edge[np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists), dtype=np.int64))])]
        by_runs = (ids[a:b] for a, b in zip(starts, starts[1:], strict=False))
        others = (np.array(x, dtype=np.int32) for x in self.library(texts.filter(pc.invert(plain)).to_pylist()))
        return [next(by_runs) if p else next(others) for p in plain.to_pylist()]


_ENCODERS: dict[str, RunIds] = {}


def _encoder(path: str) -> RunIds:
    """One encoder per worker process, kept between its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = RunIds(path)
    return _ENCODERS[path]


def tokenised(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int, window: int) -> DataFrame:
    """doc_id, n (tokens with the end id), ids (of the rest, 32 bit little-endian), rest_crc, full_crc (one per full window)."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            n, rest, rest_crc, full = [], [], [], []
            for ids in encoder.encode(batch.column(1)):
                raw = np.append(ids, end_id).astype("<u4").tobytes()
                n.append(len(raw) // 4)
                whole = len(raw) // (4 * window) * (4 * window)
                full.append([zlib.crc32(raw[a:a + 4 * window]) for a in range(0, whole, 4 * window)])
                rest.append(raw[whole:])
                rest_crc.append(zlib.crc32(raw[whole:]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(rest, pa.binary()), pa.array(rest_crc, pa.int64()),
                                              pa.array(full, pa.list_(pa.int64()))], ["doc_id", "n", "ids", "rest_crc", "full_crc"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([slim.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType()),
                           T.StructField("rest_crc", T.LongType()), T.StructField("full_crc", T.ArrayType(T.LongType()))])
    return slim.mapInArrow(run, schema)


def combinations(bins: int, deepest: int) -> list[tuple[int, ...]]:
    """Non-decreasing combinations of bins that sum to ``bins``: up to three of any, or up to ``deepest`` of at most two kinds."""
    found = {(bins,)}
    for a in range(1, bins // 2 + 1):
        found.add((a, bins - a))
        found.update((a, b, bins - a - b) for b in range(a, (bins - a) // 2 + 1))
        for n in range(1, min(deepest, bins // a) + 1):
            left = bins - n * a
            if left == 0:
                found.add((a,) * n)
            found.update(tuple(sorted((a,) * n + (left // m,) * m)) for m in range(1, deepest - n + 1) if left and left % m == 0)
    return sorted(found, key=lambda p: (len(p), p))


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 of the least |a x - b|, by the active-set method: a column joins while it lowers the residual, and leaves at zero."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, dtype=bool)
    scale = max(float(np.abs(a.T @ b).max(initial=0)), 1e-30)
    for _ in range(rounds or 3 * a.shape[0] + 10):
        gradient = a.T @ (b - a @ x)
        gradient[free] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= 1e-9 * scale:
            break
        free[best] = True
        while True:
            columns = np.flatnonzero(free)
            s = np.linalg.lstsq(a[:, columns], b, rcond=None)[0]
            if s.min(initial=0.0) >= 0:
                x[:] = 0
                x[columns] = s
                break
            now = x[columns]
            falls = s < 0
            t = float(np.min(now[falls] / (now[falls] - s[falls])))
            x[columns] = np.maximum(now + t * (s - now), 0)
            gone = columns[x[columns] <= 1e-12]
            x[gone] = 0
            free[gone if len(gone) else columns[falls][:1]] = False
    return x


def repeats(count: np.ndarray, patterns: list[tuple[int, ...]], aside: float) -> np.ndarray:
    """How often each pattern is used: the least-squares solution for the histogram, rounded within what each bin has.

    ``count[l]``: rests in bin l (from 1).  ``aside``: share of every bin left to the residuals.
    """
    usable = np.floor(count * (1 - aside)).astype(np.int64)
    a = np.zeros((len(count), len(patterns)))
    for p, pattern in enumerate(patterns):
        for l in pattern:  # noqa: E741
            a[l, p] += 1
    # rare lengths weigh as much as common ones
    weight = 1 / np.sqrt(np.maximum(usable, 1))
    x = non_negative_least_squares(a * weight[:, None], usable * weight)
    out, left = np.zeros(len(patterns), dtype=np.int64), usable.copy()
    for p in np.argsort(-x, kind="stable"):
        need = a[:, p].astype(np.int64)
        most = int((left[need > 0] // need[need > 0]).min())
        out[p] = min(most, round(float(x[p])))
        left -= out[p] * need
    return out


def affordable(times: np.ndarray, patterns: list[tuple[int, ...]], count: np.ndarray, tokens: np.ndarray, step: int) -> np.ndarray:
    """``times``, lowered until the residual tokens are expected to fill the patterns' slack."""
    mean = np.divide(tokens, np.maximum(count, 1))
    for share in np.linspace(1, 0, 41):
        now = np.floor(times * share).astype(np.int64)
        used = np.zeros(len(count), dtype=np.int64)
        for p, pattern in enumerate(patterns):
            np.add.at(used, list(pattern), now[p])
        slack = float(np.sum(used * (np.arange(len(count)) * step - mean)))
        if 1.2 * slack <= float(tokens.sum() - np.sum(used * mean)):
            return now
    return np.zeros_like(times)


def running(df: DataFrame, part: str, order: list[str], value: Column, out: str, keys: list[str] | None = None) -> DataFrame:
    """``out``: the sum of ``value`` over the rows before this one (of the same ``keys``), parts one after the other.

    Sums inside a part, plus the sums of the parts before; ``df`` is read twice and must be stored.
    """
    keys = keys or []
    inside = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = (Window.partitionBy(*keys) if keys else Window).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = df.groupBy(*keys, part).agg(F.sum(value).alias("_sum")).select(*keys, part, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    return (df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(before, [*keys, part])
            .withColumn(out, (F.col("_before") + F.col("_inside")).cast("long")).drop("_before", "_inside"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL_PATH, end_id: int = 2, window: int = 4096, step: int = 32,
         deepest: int = 16, aside: float = 0.125, block: int = 1 << 16) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    ``window`` is a power of two and a multiple of ``step``.
    """
    spark = docs.sparkSession
    # the ids are stored once: row numbers, lengths and checksums are read without them
    store = f"{checkpoint_dir(spark)}/packing/{uuid.uuid4().hex}"
    tokenised(docs, id_col, text_col, path, end_id, window).withColumn("row", F.monotonically_increasing_id()).write.parquet(store)
    stored = spark.read.parquet(store)
    part = F.shiftrightunsigned("row", 33).cast("int")              # the task that numbered the row
    rows = stored.select("row", part.alias("part"), "doc_id", "n", F.floor(F.col("n") / window).cast("long").alias("full"),
                         F.pmod("n", F.lit(window)).cast("long").alias("rest"), "rest_crc", "full_crc")

    # full windows
    numbered = running(rows.filter("full > 0").select("row", "part", "doc_id", "n", "full", "full_crc"), "part", ["row"], F.col("full"), "first")
    full = (numbered.select("doc_id", "n", "first", F.posexplode("full_crc").alias("k", "crc"))
            .select("doc_id", (F.col("k") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"),
                    F.col("n").alias("doc_tokens"), (F.col("first") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))

    # patterns
    bins = window // step
    of_bin = F.ceil(F.col("rest") / step).cast("int")
    rests = rows.filter("rest > 0").withColumn("bin", of_bin)
    count, tokens = np.zeros(bins + 1, dtype=np.int64), np.zeros(bins + 1, dtype=np.int64)
    for r in rests.groupBy("bin").agg(F.count(F.lit(1)).alias("c"), F.sum("rest").alias("t")).collect():     # as many rows as bins
        count[r["bin"]], tokens[r["bin"]] = r["c"], r["t"]
    patterns = combinations(bins, deepest)
    times = affordable(repeats(count, patterns, aside), patterns, count, tokens, step)
    base = rows.agg(F.coalesce(F.sum("full"), F.lit(0))).first()[0]
    runs, taken, sequence = [], [0] * (bins + 1), base
    for p in np.flatnonzero(times):
        for place, l in enumerate(patterns[p]):  # noqa: E741
            runs.append((l, taken[l], int(times[p]), sequence, place))
            taken[l] += int(times[p])
        sequence += int(times[p])
    pattern_sequences = sequence - base

    # places: number k of a bin falls into one run of places
    ranked = running(rests.select("row", "part", "doc_id", "n", "rest", "rest_crc", "bin"), "part", ["row"], F.lit(1), "k", ["bin"])
    table = spark.createDataFrame(runs, "bin int, from_k long, times long, sequence long, place int")      # bounded by the patterns' places
    spans = table.groupBy("bin").agg(F.array_sort(F.collect_list(F.struct("from_k", "times", "sequence", "place"))).alias("runs"))
    hit = F.element_at(F.filter("runs", lambda r: (r["from_k"] <= F.col("k")) & (F.col("k") < r["from_k"] + r["times"])), 1)
    found = ranked.join(F.broadcast(spans), "bin", "left").withColumn(
        "run", F.when(F.exists("runs", lambda r: (r["from_k"] <= F.col("k")) & (F.col("k") < r["from_k"] + r["times"])), hit))
    dealt = reliable(found.select("row", "part", "doc_id", "n", "rest", "rest_crc", (F.col("run.sequence") + F.col("k") - F.col("run.from_k")).alias("sequence_id"),
                                  F.col("run.place").alias("place")))
    in_sequence = Window.partitionBy("sequence_id").orderBy("place")
    placed = dealt.filter(F.col("sequence_id").isNotNull()).withColumn(
        "offset", F.coalesce(F.sum("rest").over(in_sequence.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    whole = placed.select("doc_id", (F.col("n") - F.col("rest")).alias("start"), F.col("rest").alias("length"), F.col("rest_crc").alias("ids_crc32"),
                          F.col("n").alias("doc_tokens"), "sequence_id", "offset")

    # residuals: one line of tokens
    line = reliable(running(dealt.filter(F.col("sequence_id").isNull()).select("row", "part", "doc_id", "n", "rest", "rest_crc"), "part", ["row"],
                            F.col("rest"), "at"))
    length = line.agg(F.coalesce(F.max(F.col("at") + F.col("rest")), F.lit(0))).first()[0]
    used = placed.groupBy("sequence_id").agg(F.sum("rest").alias("used"))
    gaps = reliable(used.filter(F.col("used") < window).select(
        "sequence_id", "used", (F.lit(window) - F.col("used")).alias("room"), F.floor((F.col("sequence_id") - base) / 65_536).alias("part")))
    room = running(gaps, "part", ["sequence_id"], F.col("room"), "at")
    slack = gaps.agg(F.coalesce(F.sum("room"), F.lit(0))).first()[0]
    open_at = base + pattern_sequences
    beyond = max(0, length - slack)
    windows, tail = divmod(beyond, window)
    ends = [(slack + windows * window + sum(1 << b for b in range(b + 1, window.bit_length()) if tail >> b & 1), 1 << b)
            for b in reversed(range(window.bit_length())) if tail >> b & 1]       # powers of two, largest first
    vessels = room.filter(F.col("at") < length).select("sequence_id", F.col("used").alias("offset"), "at", "room")
    vessels = vessels.unionByName(spark.range(windows).select((F.col("id") + open_at).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
                                                              (F.col("id") * window + slack).alias("at"), F.lit(window).cast("long").alias("room")))
    if ends:
        vessels = vessels.unionByName(spark.createDataFrame([(open_at + windows + i, 0, at, size) for i, (at, size) in enumerate(ends)],
                                                            "sequence_id long, offset long, at long, room long"))
    pieces = _cut(line.select("row", "at", F.col("rest").alias("room")), vessels, block)

    # whole residuals keep their checksum; the ids of the cut ones are read again
    joined = pieces.join(line, "row").select("row", "doc_id", "n", "rest", "rest_crc", (F.col("n") - F.col("rest")).alias("base"), "begin", "length", "sequence_id", "offset")
    uncut = joined.filter(F.col("length") == F.col("rest")).select(
        "doc_id", F.col("base").alias("start"), "length", F.col("rest_crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset")
    cuts = joined.filter(F.col("length") < F.col("rest")).join(stored.select("row", "ids"), "row").select(
        "doc_id", (F.col("base") + F.col("begin")).alias("start"), "length",
        F.crc32(F.substring("ids", (F.col("begin") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))).alias("ids_crc32"),
        F.col("n").alias("doc_tokens"), "sequence_id", "offset")
    return full.unionByName(whole).unionByName(uncut).unionByName(cuts)


def _cut(tokens: DataFrame, vessels: DataFrame, block: int) -> DataFrame:
    """row, begin (in the rest), length, sequence_id, offset: where intervals of tokens and of room meet.

    Both are intervals [at, at + room) on one line.  Each enters the blocks that it touches, clipped at their starts; inside a block, whose rows
    are bounded by its length, the latest interval of either kind before a position is the one that covers it.
    """
    def entered(df: DataFrame, kind: Column) -> DataFrame:
        first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("room") - 1) / block)
        e = df.select("at", "room", kind.alias("what"), F.explode(F.sequence(first, last)).alias("block"))
        return e.select("block", F.greatest(F.col("at"), F.col("block") * block).alias("pos"),
                        F.least(F.col("at") + F.col("room"), (F.col("block") + 1) * block).alias("stop"), "what")

    nothing = {"doc": F.lit(None).cast("struct<row:bigint,at:bigint,stop:bigint>"), "seq": F.lit(None).cast("struct<id:bigint,at:bigint,offset:bigint,stop:bigint>")}
    doc = entered(tokens, F.struct("row", "at")).select("block", "pos", F.struct(F.col("what.row").alias("row"), F.col("what.at").alias("at"), "stop").alias("doc"),
                                                        nothing["seq"].alias("seq"))
    seq = entered(vessels, F.struct("sequence_id", "at", "offset")).select(
        "block", "pos", nothing["doc"].alias("doc"),
        F.struct(F.col("what.sequence_id").alias("id"), F.col("what.at").alias("at"), F.col("what.offset").alias("offset"), "stop").alias("seq"))
    order = Window.partitionBy("block").orderBy("pos")
    seen = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = doc.unionByName(seq).select(
        "pos", F.last("doc", ignorenulls=True).over(seen).alias("doc"), F.last("seq", ignorenulls=True).over(seen).alias("seq"), F.lead("pos").over(order).alias("next"))
    stop = F.least(F.coalesce(F.col("next"), F.col("doc.stop")), F.col("doc.stop"), F.col("seq.stop"))
    both = met.filter(F.col("doc").isNotNull() & F.col("seq").isNotNull()).select(
        F.col("doc.row").alias("row"), (F.col("pos") - F.col("doc.at")).alias("begin"), (stop - F.col("pos")).alias("length"),
        F.col("seq.id").alias("sequence_id"), (F.col("seq.offset") + F.col("pos") - F.col("seq.at")).alias("offset")).filter("length > 0")
    # a meeting cut at a block's start is one piece
    return both.groupBy("row", "sequence_id").agg(F.min("begin").alias("begin"), F.sum("length").cast("long").alias("length"), F.min("offset").alias("offset"))
