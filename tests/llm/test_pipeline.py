import random
import re

import corpus_pipeline
from cashcurve.llm import decontaminate as dc
from cashcurve.llm import pieces

from .conftest import ODD_TEXTS, prose
from .test_pii import _base
from .test_simhash import _components, _print

TOXIC = ["scum", "trash", "loser", "moron"]


def _tables(spark, make_docs, write_tables):
    rng = random.Random(9)
    texts = [prose(rng, rng.randrange(40, 90)) for _ in range(600)]
    labels = []
    for i in range(600):
        bad = i % 8 == 0
        if bad:
            texts[i] = texts[i].replace(" ", f" {rng.choice(TOXIC)} ", 2)
        labels.append((i, 1, int(bad)))
    items = [(k, prose(rng, 15)) for k in range(5)]
    for i in range(3, 600, 60):
        texts[i] += f", {items[i % 5][1].upper()}!"
    for i in range(5, 600, 40):
        texts[i] += f" mail me.{i}@x{i}.org or 10.0.0.{i % 256} now"
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(700 + i, texts[10 + i], "en") for i in range(6)]
    rows += [(800 + i, t, None) for i, t in enumerate(ODD_TEXTS)] + [(None, texts[1], None), (1, texts[1], "en")]
    sf = write_tables(documents=make_docs(rows), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
                      benchmark=spark.createDataFrame(items, "item_id long, text string"))
    return rows, items, sf


def test_stages_and_result_equal_a_loop(spark, make_docs, write_tables):
    rows, items, sf = _tables(spark, make_docs, write_tables)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "benchmark decontamination", "pii",
                                                      "sentencepiece encoding and decoding"]
    kept = [(i, t) for i, t, _ in rows if not re.search("|".join(TOXIC), t or "")]
    root = _components({_print(t) for _, t in kept})
    first = {}
    for i, t in kept:
        g = root[_print(t)]
        if g not in first or (i is not None and (first[g][0] is None or i < first[g][0])):
            first[g] = (i, t)
    clean = [(i, t) for i, t in first.values() if not dc.brute_force(t, [(str(k), x) for k, x in items])[1]]

    def redact(t):
        out, at = [], 0
        for a, b, kind in sorted((a, b, k) for k, a, b in _base(t)):
            if a >= at:
                out += [t[at:a], f"[{kind.upper()}]"]
                at = b
        return "".join(out) + t[at:] if out else t

    model = pieces.load_model()
    want = sorted(((i, pieces.TrieEncoder(model).encode([redact(t)])[0]) for i, t in clean), key=str)
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(((r.doc_id, r.ids) for r in got), key=str) == want
    assert all(r.round_trip for r in got)


def test_stages_keep_the_columns_of_documents(spark, make_docs, write_tables):
    rows, _, sf = _tables(spark, make_docs, write_tables)
    docs = make_docs(rows[:60])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]


def test_empty_documents_pass_every_stage(spark, make_docs, write_tables):
    sf = write_tables(documents=make_docs([]), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"),
                      benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, sf).count() == 0
