import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from cashcurve.llm import toxicity as tx
from cashcurve.llm.queries import op9_crf_toxicity

from .conftest import ODD_TEXTS, prose


def _brute(odds, move):
    """Marginals by summing over all state sequences."""
    total, toxic = 0.0, np.zeros(len(odds))
    for states in itertools.product((0, 1), repeat=len(odds)):
        p, before = 1.0, 0
        for t, s in enumerate(states):
            p *= move[before, s] * (odds[t] if s else 1)
            before = s
        total += p
        toxic += p * np.array(states)
    return toxic / total, np.log(total)


def test_forward_backward_equals_enumeration(monkeypatch):
    rng = np.random.default_rng(0)
    move = rng.uniform(0.2, 2, (2, 2))
    odds = [rng.uniform(0.05, 6, n) for n in (0, 1, 2, 7, 11)]
    for chunk in (256, 3):                                    # one chunk each, and several chunks per sequence
        monkeypatch.setattr(tx, "CHUNK", chunk)
        got, seen, log_z = tx.forward_backward(odds, move, edges=True)
        for o, m in zip(odds, got, strict=True):
            assert np.allclose(m, _brute(o, move)[0] if len(o) else [])
        assert np.isclose(seen.sum(), sum(map(len, odds)))
        if chunk == 256:
            assert np.isclose(log_z, sum(_brute(o, move)[1] for o in odds if len(o)))


def _corpus(n=400):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randrange(3, 60), rng.choice(["en", "de"])).split()
        bad = i % 7 == 0
        if bad:
            for _ in range(1 + len(words) // 20):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["Scum", "trash,", "loserisch", "loserung"]))
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_query_finds_held_out_toxic_documents(spark, make_docs, write_tables):
    rows, labels = _corpus()
    odd = [(9000 + i, t, None) for i, t in enumerate(ODD_TEXTS)] + [(None, "you scum", None), (0, rows[0][1], "en")]
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (77777, 1, 1)], "doc_id long, quality int, toxic int")
    sf = write_tables(documents=make_docs(rows + odd), labels=lab)
    got = op9_crf_toxicity(spark, sf).collect()
    assert len(got) == len(rows) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    truth = {i: t for i, _, t in labels}
    assert all(r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth)
    text = {i: t for i, t, _ in rows}
    for r in got:
        if r.doc_id in text and r.predicted:
            assert {text[r.doc_id][a:b].strip(",").lower() for a, b in r.spans} <= {"scum", "trash", "loserisch", "loserung"} | {
                f"{a}{s}{b}" for a in ("scum", "trash", "loserisch", "loserung") for b in ("scum", "trash", "loserisch", "loserung") for s in (" ", ", ")}
    assert {r.predicted for r in got if (r.doc_id or 0) >= 9000} == {0}


def test_filter_keeps_columns_and_clean_rows(spark, make_docs):
    rows, labels = _corpus(200)
    df = make_docs(rows)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F
    kept = tx.drop_toxic(df, tx.train(df, lab, F.lit(True)))
    assert kept.schema == df.schema
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _, t in labels if not t]


def test_no_training_rows(spark, make_docs, write_tables):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = op9_crf_toxicity(spark, write_tables(documents=make_docs([(1, "a b", "en"), (2, None, None)]), labels=lab)).collect()
    assert [(r.score, r.predicted) for r in got] == [(0.0, 0), (0.0, 0)]
    assert op9_crf_toxicity(spark, write_tables(documents=make_docs([]), labels=lab)).count() == 0


def test_repeated_ids_are_bounded_and_the_order_of_rows_does_not_matter(spark, make_docs):
    rng = random.Random(6)
    rows = [(4 if i % 3 == 0 else i, prose(rng, 12) + (" vilebad awfulbad" if i % 2 and i % 3 else "") + f" {prose(rng, 3)}", None) for i in range(900)]
    labels = spark.createDataFrame([(i, int(i % 2 and i % 3 != 0)) for i in range(400)], "doc_id long, toxic int")
    sample = make_docs(rows).join(labels, "doc_id").select(F.col("doc_id").cast("string").alias("id"), F.col("toxic").alias("y"), "text")
    assert tx.one_per_id(sample).count() == sample.select("id").distinct().count() < 300
    a = tx.train(make_docs(rows), labels, F.lit(True))
    b = tx.train(make_docs(rows[::-1]).repartition(7), labels, F.lit(True))
    assert a.weights.keys() == b.weights.keys() and all(abs(a.weights[k] - b.weights[k]) < 1e-6 for k in a.weights)
