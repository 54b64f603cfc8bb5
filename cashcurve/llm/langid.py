"""Language identification (operator 3): hyperdimensional letter n-gram profiles.

Every character gets a fixed random vector of +1/-1 (seeded by its code point).  An n-gram vector *binds* its
letters: the letter's vector is permuted (rotated) once per place it stands before the last one, and the rotated vectors
are multiplied.  A text's profile *bundles* (adds) the vectors of all its n-grams; a language prototype bundles
the profiles of all training texts of the language, each normalised so that long texts do not drown short ones.  A text
gets the language whose prototype has the largest cosine with its profile.

Letters are lower-cased alphabetic characters; every run of other characters becomes one separator, so n-grams see
word starts and ends.  The n-gram vectors are computed from the n-grams that a batch contains, so memory is
bounded by the batch, and nothing of the alphabet is fixed.

Defined results: a null text, or one without letters, is ``und`` with score 0; ties go to the smallest language
name; with no training rows everything is ``und``; null languages are never learned; repeated rows count as
often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashcurve.llm.common import bound_batches

UNKNOWN = "und"
DIMENSIONS, ORDER = 1024, 3

_letter_id = np.full(0x110000, -1, dtype=np.int32)      # code point -> 0 separator, 1.. letter; -1 not seen yet
_letters: list[str] = [" "]


def letter_ids(text: str) -> np.ndarray:
    """Ids of the letters of the lower-cased text; runs of other characters are one 0, also at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    ids = _letter_id[codes]
    if (ids < 0).any():
        for code in np.unique(codes[ids < 0]):
            ch = chr(code)
            if ch.isalpha():
                _letter_id[code] = len(_letters)
                _letters.append(ch)
            else:
                _letter_id[code] = 0
        ids = _letter_id[codes]
    keep = np.ones(len(ids), dtype=bool)
    keep[1:] = (ids[1:] != 0) | (ids[:-1] != 0)
    ids = ids[keep]
    pad = np.zeros(1, dtype=np.int32)
    return np.concatenate([pad[:int(len(ids) == 0 or ids[0] != 0)], ids, pad[:int(len(ids) == 0 or ids[-1] != 0)]])


def letter_vector(ch: str, dimensions: int) -> np.ndarray:
    return np.random.default_rng([ord(ch), dimensions]).choice(np.array([-1, 1], dtype=np.int8), dimensions)


class NgramSpace:
    """Bound n-gram vectors, made when first met and kept for up to ``keep`` n-grams."""

    def __init__(self, dimensions: int = DIMENSIONS, order: int = ORDER, keep: int = 40_000):
        self.d, self.order, self.keep = dimensions, order, keep
        self.letter: list[np.ndarray] = []
        self.row: dict[int, int] = {}
        self.table = np.empty((0, dimensions), dtype=np.float32)

    def grams(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-gram codes of a text and their counts (letters packed into 20 bits each)."""
        n = len(ids) - self.order + 1
        if n <= 0:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        code = np.zeros(n, dtype=np.int64)
        for k in range(self.order):
            code = (code << 20) | ids[k:k + n]
        return np.unique(code, return_counts=True)

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        missing = [c for c in codes.tolist() if c not in self.row]
        if missing:
            if len(self.row) + len(missing) > self.keep:
                self.row, self.table = {}, self.table[:0]
                missing = codes.tolist()
            while len(self.letter) < len(_letters):
                self.letter.append(letter_vector(_letters[len(self.letter)], self.d))
            bound = np.ones((len(missing), self.d), dtype=np.int8)
            all_codes = np.array(missing, dtype=np.int64)
            letters = np.stack(self.letter)
            for k in range(self.order):
                which = (all_codes >> (20 * (self.order - 1 - k))) & 0xFFFFF
                bound *= np.roll(letters, self.order - 1 - k, axis=1)[which]
            start = len(self.table)
            self.table = np.concatenate([self.table, bound.astype(np.float32)])
            self.row.update(zip(missing, range(start, start + len(missing)), strict=True))
        return self.table[[self.row[c] for c in codes.tolist()]]

    def profiles(self, texts: list[str | None], group: int = 256, columns: int = 8192) -> list[np.ndarray | None]:
        """Unit profiles; None for a text without letters.

        Texts are taken in small groups that share one lookup of n-gram vectors, in slices of ``columns`` n-grams.
        """
        out: list[np.ndarray | None] = []
        for at in range(0, len(texts), group):
            grams = [self.grams(ids) if (ids := letter_ids(t or "")).any() else None for t in texts[at:at + group]]
            used = [g for g in grams if g is not None and len(g[0])]
            if used:
                codes, place = np.unique(np.concatenate([g[0] for g in used]), return_inverse=True)
                counts = np.concatenate([g[1] for g in used]).astype(np.float32)
                row = np.repeat(np.arange(len(used)), [len(g[0]) for g in used])
                bundle = np.zeros((len(used), self.d))
                for lo in range(0, len(codes), columns):
                    here = (place >= lo) & (place < lo + columns)
                    dense = np.zeros((len(used), min(columns, len(codes) - lo)), dtype=np.float32)
                    dense[row[here], place[here] - lo] = counts[here]
                    bundle += dense @ self.vectors(codes[lo:lo + columns])
                norms = np.linalg.norm(bundle, axis=1)
            k = 0
            for g in grams:
                if g is None or not len(g[0]):
                    out.append(None)
                    continue
                out.append(bundle[k] / norms[k] if norms[k] else None)
                k += 1
        return out


_space: dict[tuple[int, int], NgramSpace] = {}


def space(dimensions: int, order: int) -> NgramSpace:
    """The Python worker's own n-gram space (kept between tasks; it only caches fixed vectors)."""
    return _space.setdefault((dimensions, order), NgramSpace(dimensions, order))


def train_prototypes(docs: DataFrame, text_col: str, lang_col: str, train: Column, dimensions: int = DIMENSIONS,
                     order: int = ORDER) -> dict[str, np.ndarray]:
    """Unit prototypes per language from ALL rows with ``train`` and a language.

    Each task bundles its rows per language (one vector of ``dimensions`` numbers each); the shuffle adds
    these, so what reaches the driver is one vector per language.
    """
    bound_batches(docs.sparkSession)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        sp = space(dimensions, order)
        for batch in batches:
            for lang, p in zip(batch.column(0).to_pylist(), sp.profiles(batch.column(1).to_pylist()), strict=True):
                if p is not None:
                    sums[lang] = sums[lang] + p if lang in sums else p
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "v": [v.tolist() for v in sums.values()]},
                                             pa.schema([("lang", pa.string()), ("v", pa.list_(pa.float64()))]))

    parts = (docs.filter(train & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string"), text_col)
             .mapInArrow(bundle, "lang string, v array<double>"))
    place = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = place.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).collect()
    sums = {r["lang"]: np.array([e["x"] for e in r["v"]]) for r in rows}
    return {k: v / np.linalg.norm(v) for k, v in sorted(sums.items()) if np.linalg.norm(v)}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", dimensions: int = DIMENSIONS,
             order: int = ORDER) -> DataFrame:
    """All columns but the text, plus lang_pred and score (cosine with the winner's prototype, at least 0).

    One map over the scan, no shuffle; the prototypes (one vector per language) are broadcast.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    names = sorted(prototypes)
    shared = spark.sparkContext.broadcast((names, np.stack([prototypes[k] for k in names]) if names else None))
    keep = [c for c in docs.columns if c != text_col]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        sp = space(dimensions, order)
        for batch in batches:
            pred, score = [], []
            for p in sp.profiles(batch.column(batch.num_columns - 1).to_pylist()):
                if p is None or not names:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    continue
                cos = matrix @ p
                best = int(np.argmax(cos))
                pred.append(names[best])
                score.append(float(min(1.0, max(0.0, cos[best]))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                             [*batch.schema.names[:-1], "lang_pred", "score"])

    plain = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*keep, text_col).mapInArrow(label, plain)
