import random

import numpy as np
from pyspark.sql import functions as F

from cashcurve.llm import quality as ql
from cashcurve.llm.queries import op2_random_indexing_quality

from .conftest import ODD_TEXTS, prose


def test_contexts_equal_a_loop_over_neighbours():
    space = ql.Space(buckets=16, dimensions=8, nonzero=2, window=2, block=4)
    where, sign = space.index_vectors()
    rng = np.random.default_rng(1)
    ids = [rng.integers(0, 16, n) for n in (0, 1, 5, 30)]
    table = np.zeros(16 * 8)
    ql.add_contexts(table, ids, space, where, sign)
    want = np.zeros((16, 8))
    for t in ids:
        for i, w in enumerate(t):
            for j in range(max(0, i - 2), min(len(t), i + 3)):
                if j != i:
                    np.add.at(want[w], where[t[j]], sign[t[j]])
    assert np.allclose(table.reshape(16, 8), want)


def test_word_vectors_do_not_depend_on_the_partitions(spark, make_docs):
    rng = random.Random(2)
    df = make_docs([(i, prose(rng, 20), "en") for i in range(60)])
    space = ql.Space(buckets=64, dimensions=8, nonzero=2, block=16)
    assert np.allclose(ql.word_vectors(df.coalesce(1), "text", space), ql.word_vectors(df.repartition(7), "text", space), atol=1e-5)


def test_temperature_undoes_overconfidence():
    rng = np.random.default_rng(3)
    z = rng.normal(0, 1.5, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(float)
    assert 2.4 < ql.fit_temperature(3 * z, y) < 3.7


def _corpus(n=300):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        text = prose(rng, rng.randrange(20, 60))
        rows.append((i, text if good else " ".join(w.upper() + "!!" for w in text.split()), "en"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_query_separates_held_out_documents(spark, make_docs, write_tables):
    rows, labels = _corpus()
    odd = [(9000 + i, t, None) for i, t in enumerate(ODD_TEXTS)] + [(None, "x", None), (0, rows[0][1], "en")]
    sf = write_tables(documents=make_docs(rows + odd), labels=spark.createDataFrame([*labels, (None, 0, 0), (2, None, None)], "doc_id long, quality int, toxic int"))
    got = op2_random_indexing_quality(spark, sf).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {i: q for i, q, _ in labels}
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert min(s for s, q in held if q) > max(s for s, q in held if not q)


def test_without_two_classes_the_share_is_the_score(spark, make_docs, write_tables):
    lab = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    sf = write_tables(documents=make_docs([(1, "a b", "en"), (2, None, None), (3, "", None)]), labels=lab)
    scores = {r.score for r in op2_random_indexing_quality(spark, sf).collect()}
    assert len(scores) == 1 and 0.5 < scores.pop() < 1
    empty = write_tables(documents=make_docs([]), labels=lab.filter(F.lit(False)))
    assert op2_random_indexing_quality(spark, empty).count() == 0


def test_an_id_on_a_third_of_the_rows_does_not_break_the_bound(spark, make_docs, monkeypatch):
    rng = random.Random(5)
    rows = [(5 if i % 3 == 0 else i, prose(rng, 8) + f" {i}", None) for i in range(1500)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = []
    pooled = ql.pooled
    monkeypatch.setattr(ql, "pooled", lambda *a, **k: seen.append(pooled(*a, **k)) or seen[-1])
    first = ql.train(make_docs(rows), labels, F.lit(True), max_docs=30)
    assert seen[0].count() <= 30
    again = ql.train(make_docs(rows[::-1]).repartition(5), labels, F.lit(True), max_docs=30)
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(first.layers, again.layers, strict=True))


def test_scores_equal_a_loop_over_the_texts(spark, make_docs):
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randrange(3, 40)) + (" !!" if i % 2 else ""), None) for i in range(120)] + [(500 + i, t, None) for i, t in enumerate(ODD_TEXTS)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(120)], "doc_id long, quality int")
    docs = make_docs(rows)
    space = ql.Space(buckets=256, dimensions=8, block=64)
    model = ql.train(docs, labels, F.lit(True), space=space)
    where, sign = space.index_vectors()
    table = np.zeros((256, 8))
    ids = {i: [__import__("zlib").crc32(w.encode()) % 256 for w in ql.TOKEN.findall(t or "")] for i, t, _ in rows}
    for words in ids.values():
        for a, w in enumerate(words):
            for b in range(max(0, a - space.window), min(len(words), a + space.window + 1)):
                if a != b:
                    table[w, where[words[b]]] += sign[words[b]]
    table = np.sign(table) * np.sqrt(np.abs(table))
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    table = table / np.where(norm > 0, norm, 1)
    assert np.allclose(table, model.vectors, atol=1e-4)
    w1, b1, w2, b2 = model.layers
    got = {r.doc_id: r for r in ql.score(docs.select("doc_id", "text"), model).collect()}
    for i, words in ids.items():
        v = table[words] if words else np.zeros((1, 8))
        x = np.concatenate([v.mean(0), v.std(0), [np.linalg.norm(v.mean(0)), np.log1p(len(words)) / 10]]) if words else np.zeros(18)
        p = 1 / (1 + np.exp(-(np.tanh((x - model.center) / model.scale @ w1 + b1) @ w2 + b2)[0] / model.temperature))
        assert abs(got[i].score - p) < 2e-3 and got[i].predicted == int(got[i].score >= 0.3)
