"""Toxicity (operator 9): a linear-chain conditional random field over the words of a text.

The field has two states per word, neutral and toxic.  A word's features are itself, its prefixes of 3 to 6 letters and
its last 4 letters; only features of the learned marker list carry weight, every other word is plain.
Forward-backward gives each word's toxic marginal.  Words of marginal 0.5 or more form the offending spans; the
largest marginal and the expected number of toxic words feed a small logistic calibration that gives the
document's score.

Labelled tokens: labels name documents, not words.  A feature is a *marker* when it separates toxic from clean training
documents beyond chance (likelihood ratio) and is nearly always toxic; near copies among the training documents are left out first, as
every rare word of a toxic text with many copies would look like one.  Markers are found in rounds: toxic
documents that already carry one are set aside, so that the words of rarer languages, too few to stand out at
first, stand out against what is left.  The training tokens labelled toxic are those of toxic documents that carry a
marker.  All tokens of clean documents are labelled neutral, also those with a marker, so that ambiguous markers get
small weights.

Bounds (parameters): ``max_docs`` labelled documents for the marker statistics, ``max_sequences`` of them for fitting
the field, ``max_markers`` features a round; both samples keep the classes' natural shares.  Scoring is one map over the scan, of whole
texts, without a shuffle.

Defined results: null and empty texts have no words and get the calibrated score of "no toxic word"; without toxic
or without clean training rows every score is 0; rows with a null or repeated id are scored one by one; if a
document has several labels the largest counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashcurve.llm.common import bound_batches, fresh, one_per_id, reliable, with_fields

TOKEN = re.compile(r"[^\W\d_]+")
CHUNK = 256


def features(word: str) -> list[str]:
    w = word.lower()
    return [f"w:{w}", f"s:{w[-4:]}", *(f"p:{w[:k]}" for k in range(3, min(6, len(w)) + 1))]


def _chunks(odds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Sequences laid out as columns of CHUNK positions: odds, validity, and the columns [a, b) of each sequence."""
    spans, at = [], 0
    for o in odds:
        n = max(1, -(-len(o) // CHUNK))
        spans.append((at, at + n))
        at += n
    flat, valid = np.ones(at * CHUNK), np.zeros(at * CHUNK, dtype=bool)
    for o, (a, _) in zip(odds, spans, strict=True):
        flat[a * CHUNK:a * CHUNK + len(o)] = o
        valid[a * CHUNK:a * CHUNK + len(o)] = True
    return np.ascontiguousarray(flat.reshape(at, CHUNK).T), np.ascontiguousarray(valid.reshape(at, CHUNK).T), spans


def forward_backward(odds: list[np.ndarray], move: np.ndarray, edges: bool = False):
    """Toxic marginals of each sequence; with ``edges`` also the summed expected transitions (2 x 2) and log Z.

    ``odds[t]`` is the factor of the toxic over the neutral state at t, ``move`` the transition factors; a sequence
    starts after a neutral state.  Long sequences are cut into chunks: first each chunk's 2 x 2 transfer
    matrix, all chunks at once, then the messages between the chunks of a sequence, then the chunks again with
    their messages.  The result is exact.
    """
    b, valid, spans = _chunks(odds)
    steps = int(valid.any(axis=1).sum()) or 1
    c = b.shape[1]
    m = np.zeros((2, 2, c))
    m[0, 0] = m[1, 1] = 1
    for t in range(steps):
        n0 = m[:, 0] * move[0, 0] + m[:, 1] * move[1, 0]
        n1 = (m[:, 0] * move[0, 1] + m[:, 1] * move[1, 1]) * b[t]
        scale = n0.sum(0) + n1.sum(0)
        ok = valid[t]
        m[:, 0] = np.where(ok, n0 / scale, m[:, 0])
        m[:, 1] = np.where(ok, n1 / scale, m[:, 1])
    into, back = np.ones((2, c)), np.ones((2, c))
    into[1] = 0
    for a, z in spans:
        for k in range(a + 1, z):
            v = into[:, k - 1] @ m[:, :, k - 1]
            into[:, k] = v / v.sum()
        for k in range(z - 2, a - 1, -1):
            v = m[:, :, k + 1] @ back[:, k + 1]
            back[:, k] = v / v.sum()
    p = np.empty((steps, c))
    p0, p1 = into[0].copy(), into[1].copy()
    log_z = np.zeros(c)
    for t in range(steps):
        n0 = p0 * move[0, 0] + p1 * move[1, 0]
        n1 = (p0 * move[0, 1] + p1 * move[1, 1]) * b[t]
        s = n0 + n1
        ok = valid[t]
        p0, p1 = np.where(ok, n0 / s, p0), np.where(ok, n1 / s, p1)
        if edges:
            log_z += np.where(ok, np.log(s), 0)
        p[t] = p1
    b0, b1 = back[0].copy(), back[1].copy()
    marg = np.empty((steps, c))
    seen = np.zeros((2, 2))
    for t in range(steps - 1, -1, -1):
        ok = valid[t]
        num = p[t] * b1
        marg[t] = num / (num + (1 - p[t]) * b0)
        before = p[t - 1] if t else into[1]
        if edges:
            joint = np.array([[(1 - before) * move[0, 0] * b0, (1 - before) * move[0, 1] * b[t] * b1],
                              [before * move[1, 0] * b0, before * move[1, 1] * b[t] * b1]])
            seen += np.where(ok, joint / joint.sum((0, 1)), 0).sum(2)
        n0 = move[0, 0] * b0 + move[0, 1] * b[t] * b1
        n1 = move[1, 0] * b0 + move[1, 1] * b[t] * b1
        s = n0 + n1
        b0, b1 = np.where(ok, n0 / s, b0), np.where(ok, n1 / s, b1)
    flat = np.zeros((c, CHUNK))
    flat[:, :steps] = marg.T
    flat = flat.reshape(-1)
    out = [flat[a * CHUNK:a * CHUNK + len(o)] for o, (a, _) in zip(odds, spans, strict=True)]
    return (out, seen, float(log_z.sum())) if edges else out


@dataclass
class ToxicityModel:
    """Weights of the field and of the document calibration; ``cut`` is the score from which a document is toxic."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    move: np.ndarray = field(default_factory=lambda: np.ones((2, 2)))
    calibration: np.ndarray | None = None       # intercept, weight of the top marginal's logit, of the expected count
    cut: float = 0.7

    def odds(self, word: str) -> float:
        return float(np.exp(self.bias + sum(self.weights.get(f, 0.0) for f in features(word))))

    def document_scores(self, marginals: list[np.ndarray]) -> np.ndarray:
        if self.calibration is None:
            return np.zeros(len(marginals))
        z = document_inputs(marginals) @ self.calibration
        return 1 / (1 + np.exp(-z))


def document_inputs(marginals: list[np.ndarray]) -> np.ndarray:
    top = np.array([m.max() if len(m) else 0.0 for m in marginals]).clip(1e-6, 1 - 1e-6)
    total = np.array([m.sum() for m in marginals])
    return np.stack([np.ones(len(marginals)), np.log(top / (1 - top)), np.log1p(total)], axis=1)


def fit_field(sequences: list[list[tuple[int, ...]]], states: list[np.ndarray], n_features: int, rounds: int = 80,
              rate: float = 0.3, decay: float = 1e-3) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and transition factors by gradient ascent (Adam) on the mean log-likelihood of the sequences."""
    tokens = sum(len(s) for s in sequences) or 1
    feat = np.array([f for s in sequences for fs in s for f in fs], dtype=np.int64)
    owner = np.repeat(np.arange(tokens if sequences else 0), [len(fs) for s in sequences for fs in s])
    y = np.concatenate(states).astype(float)
    ends = np.cumsum([len(s) for s in sequences])[:-1]
    observed = np.bincount(feat, weights=y[owner], minlength=n_features)
    pairs = np.zeros((2, 2))
    for s in states:
        np.add.at(pairs, (np.concatenate([[0], s[:-1]]), s), 1)
    theta = np.zeros(n_features + 5)
    theta[n_features] = -4.0
    mom, var = np.zeros_like(theta), np.zeros_like(theta)
    support = np.maximum(np.bincount(feat, minlength=n_features), 1.0)
    for step in range(1, rounds + 1):
        w, bias, move = theta[:n_features], theta[n_features], np.exp(theta[n_features + 1:].reshape(2, 2))
        e = np.full(len(y), bias)
        np.add.at(e, owner, w[feat])
        marg, seen, _ = forward_backward(np.split(np.exp(e.clip(-30, 30)), ends), move, edges=True)
        m = np.concatenate(marg)
        grad = np.concatenate([(observed - np.bincount(feat, weights=m[owner], minlength=n_features)) / support - decay * w,
                               [(y - m).sum() / max(1.0, y.sum())], (pairs - seen).reshape(-1) / max(1.0, y.sum()) - decay * theta[n_features + 1:]])
        mom, var = 0.9 * mom + 0.1 * grad, 0.99 * var + 0.01 * grad * grad
        theta += rate * (mom / (1 - 0.9 ** step)) / (np.sqrt(var / (1 - 0.99 ** step)) + 1e-6)
    return theta[:n_features], float(theta[n_features]), np.exp(theta[n_features + 1:].reshape(2, 2))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        grad = x.T @ (y - p) - ridge * w
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
    return w


def training_sample(labels: DataFrame, id_col: str, label_col: str, allowed: Column, most: int) -> DataFrame:
    """Up to ``most`` (id, y, pick) rows, the ones with the smallest hash of the id."""
    return (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & allowed)
            .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
            .withColumn("pick", F.xxhash64("id")).orderBy("pick", "id").limit(most))


def without_copies(texts: DataFrame) -> DataFrame:
    """The sample without near copies: of documents of a class that share a min-hash of their three-word shingles one stays,
    for two hash functions in turn (two texts share one with the probability of their resemblance)."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: tuple[list[int], list[int]] = ([], [])
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                words = [w.lower() for w in TOKEN.findall(text)]
                shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
                for seed, k in enumerate(keys):
                    k.append(min(xxhash.xxh32_intdigest(s, seed) for s in shingles))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(k, pa.int64()) for k in keys]], [*batch.schema.names, "m1", "m2"])

    marked = texts.mapInArrow(sketch, with_fields(texts.schema, ("m1", T.LongType()), ("m2", T.LongType())))
    for m in ("m1", "m2"):                                            # the smallest id stays, whatever order the rows come in
        rest = [c for c in marked.columns if c not in ("y", m, "id")]
        marked = marked.groupBy("y", m).agg(F.min(F.struct("id", *rest)).alias("_least")).select("y", m, "_least.*")
    return marked.select(*texts.columns)


def marker_counts(texts: DataFrame, known: frozenset[str]) -> DataFrame:
    """Per feature the toxic (``t``) and clean (``c``) documents that have it; toxic ones with a known marker are left
    out.  ``f`` is null in the row that counts the documents themselves."""
    kind = pa.schema([("f", pa.string()), ("t", pa.int64()), ("c", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {f for w in set(TOKEN.findall(text)) for f in features(w)}
                if y and not known.isdisjoint(found):
                    continue
                seen[y].update(found)
                seen[y][None] += 1
        names = list(seen[0].keys() | seen[1].keys())
        for at in range(0, len(names), 50_000):
            part = names[at:at + 50_000]
            yield pa.RecordBatch.from_pydict({"f": part, "t": [seen[1][f] for f in part], "c": [seen[0][f] for f in part]}, kind)

    return (texts.select("y", "text").mapInArrow(count, "f string, t long, c long")
            .groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c")))


def find_markers(texts: DataFrame, significance: float, purity: float, max_markers: int, rounds: int) -> list[str]:
    t, c = F.col("t"), F.col("c")
    xlogx = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(F.lit(0.0))
    markers: list[str] = []
    for _ in range(rounds):
        counts = reliable(marker_counts(texts, frozenset(markers)))
        n = counts.filter("f is null").first()
        if n is None or not n["t"] or not n["c"]:
            break
        share = F.lit(n["t"] / (n["t"] + n["c"]))
        ratio = 2 * (xlogx(t, (t + c) * share) + xlogx(c, (t + c) * (1 - share)))
        found = (counts.filter(F.col("f").isNotNull() & (t / (t + c) > F.greatest(share, F.lit(purity))) & (ratio >= significance))
                 .orderBy(ratio.desc(), "f").limit(max_markers).collect())
        if not found:
            break
        markers += [r["f"] for r in found]
    return markers


def train(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_docs: int = 16_000, max_sequences: int = 2_000, max_markers: int = 2_000,
          significance: float = 30.0, purity: float = 0.9, rounds: int = 4, cut: float = 0.7) -> ToxicityModel:
    """Fit on labelled documents; ``allowed`` is a condition on the labels' id column (the training folds)."""
    spark = docs.sparkSession
    bound_batches(spark)
    schema = "id string, y int, pick long"
    picked = [(str(r["id"]), r["y"], r["pick"]) for r in training_sample(labels, id_col, label_col, allowed, max_docs).collect()]
    if len({y for _, y, _ in picked}) < 2:
        return ToxicityModel(cut=cut)
    keys = spark.createDataFrame(picked, schema)                       # at most max_docs small rows
    texts = (docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
             .join(F.broadcast(keys), "id"))
    texts = reliable(without_copies(one_per_id(texts)))                            # the rounds read the sample, not all documents
    markers = find_markers(texts, significance, purity, max_markers, rounds)
    number = {f: k for k, f in enumerate(markers)}
    shared = spark.sparkContext.broadcast(number)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Positions and marker numbers of the marked words of each text, and its word count."""
        known = shared.value
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                words = TOKEN.findall(text)
                marked = {w: [known[f] for f in features(w) if f in known] for w in set(words)}
                hits = [(i, k) for i, w in enumerate(words) for k in marked[w]]
                found.append({"n": len(words), "at": [i for i, _ in hits], "k": [k for _, k in hits]})
            kind = pa.struct([("n", pa.int64()), ("at", pa.list_(pa.int32())), ("k", pa.list_(pa.int32()))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, kind)], ["y", "id", "s"])

    chosen = spark.createDataFrame(picked[:max_sequences], schema).select("id")
    rows = (texts.join(F.broadcast(chosen), "id", "left_semi").select("y", "text", "id")
            .mapInArrow(encode, "y int, id string, s struct<n:long,at:array<int>,k:array<int>>").collect())
    sequences, states, y = [], [], []
    for r in sorted(rows, key=lambda r: (r["y"], r["id"])):
        seq: list[tuple[int, ...]] = [()] * r["s"]["n"]
        for i, k in zip(r["s"]["at"], r["s"]["k"], strict=True):
            seq[i] += (k,)
        if seq:
            sequences.append(seq)
            states.append(np.array([int(bool(fs) and r["y"] == 1) for fs in seq]))
            y.append(r["y"])
    if not sequences:
        return ToxicityModel(cut=cut)
    w, bias, move = fit_field(sequences, states, len(markers))
    odds = [np.exp(np.array([bias + sum(w[k] for k in fs) for fs in s]).clip(-30, 30)) for s in sequences]
    inputs = document_inputs([*forward_backward(odds, move), np.empty(0)])
    calibration = fit_logistic(inputs, np.array([*y, 0], dtype=float))
    return ToxicityModel(dict(zip(markers, map(float, w), strict=True)), bias, move, calibration, cut)


class _WordOdds(dict):
    """Word -> toxic odds, filled on demand."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        self[word] = value = min(1e13, max(1e-13, self.model.odds(word)))
        return value


def offending_spans(text: str, marginals: np.ndarray) -> list[tuple[int, int]]:
    """Code-point ranges of maximal runs of words with marginal 0.5 or more."""
    hot = marginals >= 0.5
    spans: list[tuple[int, int]] = []
    last = -2
    for i, m in enumerate(TOKEN.finditer(text)):
        if hot[i]:
            spans[-1:] = [(spans[-1][0], m.end())] if last == i - 1 else [*spans[-1:], m.span()]
            last = i
    return spans


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct column, whose name is returned: score, top, expected, spans (offending offsets)."""
    bound_batches(docs.sparkSession)
    out = fresh(docs, "toxicity")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType().add("score", "double").add("top", "double").add("expected", "double").add(
        "spans", T.ArrayType(T.ArrayType(T.IntegerType())))
    arrow = pa.struct([("score", pa.float64()), ("top", pa.float64()), ("expected", pa.float64()), ("spans", pa.list_(pa.list_(pa.int32())))])

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        odds = _WordOdds(model)
        for batch in batches:
            if len(odds) > 200_000:
                odds.clear()
            texts = [x or "" for x in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            marg = forward_backward([np.array(list(map(odds.__getitem__, TOKEN.findall(x))), dtype=float) for x in texts], model.move)
            scores = model.document_scores(marg)
            rows = [{"score": float(s), "top": float(m.max()) if len(m) else 0.0, "expected": float(m.sum()),
                     "spans": offending_spans(x, m) if len(m) and m.max() >= 0.5 else []}
                    for x, m, s in zip(texts, marg, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, arrow)], [*batch.schema.names, out])

    return docs.mapInArrow(tag, with_fields(docs.schema, (out, kind))), out


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, whose score is below the model's cut."""
    df, t = score(docs, model, text_col)
    return df.filter(F.col(t)["score"] < model.cut).drop(t)
