"""Spelling variant grouping (operator 11): permuterm rotations of the vocabulary.

*Vocabulary.*  Words are the runs of letters of whole texts, lower-cased, and counted over all documents: every task adds up its own
words and hands on partial counts, so a word that stands in a third of all rows is one row per task in the shuffle.

*Rotations.*  A word ``w`` is marked ``w$``.  The rotation that ends in its i-th character is ``w[i+1:] $ w[:i]`` and that character:
without its last character it is the *context* of an edit at i.  A word that lacks the character has the context as a whole rotation.
So all words that differ by replacing the i-th character share one context, and a word with one character less lies in the same group:
replacements and indels are ranges of one prefix that skip the edited character.  The contexts are sorted (range partitioning and a
sort), and one scan of each group gives every member its number of neighbours and its best one.  A group holds a context
once per letter and once whole, so its size is bounded by the alphabet (91 rows), whatever the corpus; a word has 2 n + 1 contexts, so the
rows grow with the vocabulary.  Pairs are never emitted: the commonest two members of a group serve all its members.

*Long words.*  A word's contexts hold the square of its length, which matters for unbroken runs (encoded data, sequences of bases).  A context
longer than ``longest`` characters is therefore named by two digests, of what stands before the edit and of what stands after it; both grow
character by character, and the rows carry the word's place in the order of long words instead of the word, so a run of a million
letters costs two million short rows.  Contexts of different lengths never share a group, so the two kinds of groups add up to the same neighbours.

A character deleted from a run of equal ones leaves the same word wherever it stood: only the first of the run counts, so no neighbour is
counted twice.

*Roots.*  The form of a word is its commonest neighbour, if at least twice as common; chains of forms at least double at each step, so
pointer doubling reaches all roots within log2(log2(occurrences)) rounds, each written to the shared folder.

Defined results: null and empty texts have no words; a null id is written as ``null`` before the colon; rows repeated under one id count
each; very long texts are read whole; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashcurve.llm.common import bound_batches, reliable

RUN = re.compile("[a-zÀ-ÿ]+")
MARK = "$"


def spelled(prefix: int, run: str, every: int) -> str:
    """The run as counted: where ``every`` divides the crc32 of '<id>:<run>', one of its characters is left out.

    ``prefix`` is the crc32 of '<id>:'.
    """
    h = zlib.crc32(run.encode(), prefix)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, least: int = 3, every: int = 97,
                most: int = 200_000, most_letters: int = 16 << 20) -> DataFrame:
    """word, n: words of at least ``shortest`` characters with at least ``least`` occurrences in all documents.

    A task holds at most about ``most`` words of ``most_letters`` letters together at a time, besides those of its current text, and hands on
    their counts when it has more.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def counted() -> Iterator[pa.RecordBatch]:
            items = [(w, n) for w, n in seen.items() if len(w) >= shortest]
            for at in range(0, len(items), 20_000):
                part = items[at:at + 20_000]
                yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in part], pa.string()), "n": pa.array([n for _, n in part], pa.int64())})
            seen.clear()

        letters = 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                prefix = zlib.crc32(f"{name}:".encode())
                # bytes.lower() changes A-Z alone
                for word, n in Counter(RUN.findall(text.encode().lower().decode())).items():
                    word = spelled(prefix, word, every)
                    if word not in seen:
                        letters += len(word)
                    seen[word] += n
                if len(seen) > most or letters > most_letters:
                    yield from counted()
                    letters = 0
        yield from counted()

    slim = docs.filter(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def contexts(words: DataFrame) -> DataFrame:
    """context, skipped (null where the context is a whole rotation), n: the rotations of every marked word."""
    places = F.explode(F.sequence(F.lit(0), F.length("word")))
    w, i = F.col("word"), F.col("i")
    after, before = F.substr(w, i + 1), F.left(w, i)
    rotated = words.select("word", "n", places.alias("i"))
    whole = rotated.select(F.concat(after, F.lit(MARK), before).alias("context"), F.lit(None).cast("string").alias("skipped"), "n")
    cut = rotated.filter(i < F.length(w)).select(F.concat(F.substr(w, i + 2), F.lit(MARK), before).alias("context"),
                                                 F.substr(w, i + 1, F.lit(1)).alias("skipped"), "n")
    return whole.unionByName(cut)


def _word(context: Column, skipped: Column) -> Column:
    """The word whose rotation a context (and the character it skips) is."""
    return F.concat(F.substring_index(context, MARK, -1), F.coalesce(skipped, F.lit("")), F.substring_index(context, MARK, 1))


def scanned(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """``name``, near, best (n_less and name): per row of a context, the near words that its group shows and the commonest of them.

    ``rows``: the columns ``key`` of the context, ``name`` (of the word, in the order of words), skipped, first, n; placed by ``key``.
    ``first`` is true for the first of a run of equal characters: only its deletion leads to the whole rotation.
    """
    group = Window.partitionBy(*key).orderBy("n_less", name).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = F.struct("n_less", name)
    rows = rows.withColumn("n_less", -F.col("n"))
    is_cut, is_first = F.col("skipped").isNotNull(), F.coalesce(F.col("first"), F.lit(False))
    seen = rows.select(
        name, "n_less", "skipped", is_first.alias("first"),
        F.sum(is_cut.cast("long")).over(group).alias("cuts"), F.sum(is_first.cast("long")).over(group).alias("firsts"),
        F.first(F.when(is_cut, one), ignorenulls=True).over(group).alias("best"),
        F.nth_value(F.when(is_cut, one), 2, ignoreNulls=True).over(group).alias("second"),
        F.first(F.when(is_first, one), ignorenulls=True).over(group).alias("best_first"),
        F.first(F.when(~is_cut, one), ignorenulls=True).over(group).alias("whole"))
    other = F.when(F.col(f"best.{name}") == F.col(name), F.col("second")).otherwise(F.col("best"))
    shorter = F.when(F.col("first"), F.col("whole"))
    near = F.when(F.col("skipped").isNull(), F.col("firsts")).otherwise(F.col("cuts") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0))
    best = F.when(F.col("skipped").isNull(), F.col("best_first")).otherwise(F.least(other, shorter))
    return seen.select(name, near.alias("near"), best.alias("best")).filter(F.col("near") > 0)


def digested(words: DataFrame, longest: int) -> DataFrame:
    """before, after, place, skipped, first, n: the contexts longer than ``longest`` of words (place, word, n), by digests.

    ``before`` and ``after`` are digests of the word's characters on either side of the edit.
    """
    bound_batches(words.sparkSession)

    def digests(text: str) -> list[bytes]:
        """Of every prefix, from the empty one."""
        running, out = blake2b(digest_size=16), [blake2b(digest_size=16).digest()]
        for c in text:
            running.update(c.encode("utf-32-le"))
            out.append(running.copy().digest())
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["before", "after", "place", "skipped", "first", "n"]
        kinds = [pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.int64()]
        for batch in batches:
            for place, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size, head, tail = len(word), digests(word), digests(word[::-1])
                # a whole rotation is one longer than the word, a cut one as long as the word
                for cut in (False, True) if size > longest else (False,):
                    for at in range(0, size + (not cut), 10_000):
                        spots = range(at, min(at + 10_000, size + (not cut)))
                        columns = ([head[i] for i in spots], [tail[size - i - cut] for i in spots], [place] * len(spots),
                                   [word[i] if cut else None for i in spots], [cut and (i == 0 or word[i] != word[i - 1]) for i in spots], [n] * len(spots))
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return words.select("place", "word", "n").mapInArrow(run, "before binary, after binary, place long, skipped string, first boolean, n long")


def neighbours(words: DataFrame, longest: int = 64) -> DataFrame:
    """word, n_near, and the commonest near word (ties: smallest) with its n, of the words that have near ones.

    ``words``: distinct words without the mark, and their n.
    """
    rows = contexts(words.filter(F.length("word") <= longest)).filter(F.length("context") <= longest)
    rows = rows.repartitionByRange("context").withColumn("word", _word(F.col("context"), F.col("skipped")))
    rows = rows.withColumn("first", F.col("skipped") != F.right("context", F.lit(1)))
    short = scanned(rows, ["context"], "word")

    # long words by their place in the order of words, stored so that places cannot change
    long = reliable(words.filter(F.length("word") >= longest).select("word", "n").repartitionByRange("word").sortWithinPartitions("word")
                    .withColumn("place", F.monotonically_increasing_id()))
    found = scanned(digested(long, longest), ["before", "after"], "place").groupBy("place").agg(F.sum("near").alias("near"), F.min("best").alias("best"))
    names = long.select(F.col("place").alias("near_place"), F.col("word").alias("near_word"))
    found = found.join(long.select("place", "word"), "place").withColumn("near_place", F.col("best.place")).join(names, "near_place").select(
        "word", "near", F.struct(F.col("best.n_less").alias("n_less"), F.col("near_word").alias("word")).alias("best"))
    return short.unionByName(found).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best")).select(
        "word", "n_near", F.col("best.word").alias("near_word"), (-F.col("best.n_less")).alias("near_n"))


def with_roots(forms: DataFrame) -> DataFrame:
    """word, root: the ends of the chains word -> form, by pointer doubling; ``forms`` is read twice and should be stored."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = reliable(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, least: int = 3, every: int = 97, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word.

    ``ratio``: how many times as common as the word its form is at least.
    """
    words = reliable(word_counts(docs, id_col, text_col, shortest, least, every))
    joined = words.join(neighbours(words), "word", "left")
    takes = F.col("near_n") >= ratio * F.col("n")
    table = reliable(joined.select("word", F.when(takes, F.col("near_word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                   F.when(takes, F.col("near_n")).cast("long").alias("form_n")))
    roots = with_roots(table.filter(F.col("form").isNotNull()))
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
