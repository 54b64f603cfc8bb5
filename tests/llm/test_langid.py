import random

import numpy as np
from pyspark.sql import functions as F

from cashcurve.llm import langid
from cashcurve.llm.common import fold_is
from cashcurve.llm.queries import op3_hyperdimensional_langid

from .conftest import ODD_TEXTS, prose


def test_profile_is_the_bundle_of_bound_vectors():
    sp = langid.NgramSpace(256, 3)
    text = "Abba, ab"
    (got,) = sp.profiles([text])
    letters = " abba ab "
    vec = {c: langid.letter_vector(c, 256).astype(float) for c in set(letters)}
    want = sum(np.roll(vec[a], 2) * np.roll(vec[b], 1) * vec[c] for a, b, c in zip(letters, letters[1:], letters[2:], strict=False))
    assert np.allclose(got, want / np.linalg.norm(want))


def test_groups_and_small_caches_change_nothing():
    texts = [prose(random.Random(i), 30, lang) for i, lang in enumerate(["en", "de", "fr"] * 5)] + ["", None]
    big, small = langid.NgramSpace(128, 3), langid.NgramSpace(128, 3, keep=20)
    for a, b in zip(big.profiles(texts), small.profiles(texts, group=2, columns=7), strict=True):
        assert (a is None) == (b is None) and (a is None or np.allclose(a, b))


def test_query_on_held_out_and_odd_rows(spark, make_docs, write_tables):
    rng = random.Random(3)
    rows = [(i, prose(rng, 40, lang), lang) for i, lang in enumerate(["en", "de", "fr"] * 40)]
    odd = [(1000 + i, t, None) for i, t in enumerate(ODD_TEXTS)] + [(None, "the thing", "en"), (5, rows[5][1], "fr")]
    sf = write_tables(documents=make_docs(rows + odd))
    got = op3_hyperdimensional_langid(spark, sf).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    truth = {i: lang for i, _, lang in rows if i != 5}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and all(r.lang_pred == truth[r.doc_id] for r in held)
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(ODD_TEXTS):
        if not any(c.isalpha() for c in t or ""):
            assert by[1000 + i].lang_pred == "und" and by[1000 + i].score == 0
        else:
            assert by[1000 + i].lang_pred in ("en", "de", "fr")
    want = {r.doc_id: r.h for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", fold_is(F.col("doc_id"), 5, 0).alias("h")).collect()}
    assert all(want[r.doc_id] == r.held_out for r in got)


def test_nothing_to_learn(spark, make_docs, write_tables):
    got = op3_hyperdimensional_langid(spark, write_tables(documents=make_docs([(1, "abc", None)]))).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    assert op3_hyperdimensional_langid(spark, write_tables(documents=make_docs([]))).count() == 0
