import random

from cashcurve.llm import decontaminate as dc

from .conftest import ODD_TEXTS, prose


def _case(rng, n=40):
    vocabulary = [prose(rng, 1) for _ in range(6)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    items = [(str(i), text(rng.choice([0, 1, 2, 5, 9, 10, 11, 30]))) for i in range(12)] + [("3", text(14)), ("null", text(3))]
    docs = [text(rng.randrange(60)) for _ in range(n)]
    for k in range(0, n, 3):
        docs[k] += " " + rng.choice(items)[1].upper() + ", " + text(5)
    return docs, items


def test_search_equals_brute_force():
    rng = random.Random(1)
    for _ in range(30):
        docs, items = _case(rng, 12)
        ids, searches = dc.build_searches([(i, t.encode()) for i, t in items], 10)
        for d in docs:
            w = dc.words(d.encode())
            ranges, found = dc.find_hits(w, searches)
            got = (len(w), sum(b - a for a, b in ranges), len({ids[k] for k in found}))
            assert got == dc.brute_force(d, items)[:3]


def test_words_follow_the_contract():
    assert dc.words("Ab-1 ÉÀ_x'Ü y٣".encode()) == ["ab".encode(), b"1", "ÉÀ".encode(), b"x", "Ü y٣".encode()]


def test_report_and_filter_on_spark(spark, make_docs):
    docs, items = _case(random.Random(2))
    rows = [(i, t, "en") for i, t in enumerate(docs)] + [(100 + i, t, None) for i, t in enumerate(ODD_TEXTS)] + [(None, docs[0], None), (0, docs[0], "en")]
    bench = spark.createDataFrame([*items, (None, "only " * 3), ("9", None)], "item_id string, text string")
    known = [*items, ("null", "only " * 3)]
    df = make_docs(rows)
    for group_bytes in (1 << 20, 300):                        # one broadcast group, several passes
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
                     for r in dc.contamination_report(df, bench, group_bytes=group_bytes).collect())
        want = sorted((i if i is not None else -1, *(b := dc.brute_force(t, known)), b[1] > 0) for i, t, _ in rows)
        assert got == want
    kept = dc.drop_contaminated(df, bench)
    assert kept.schema == df.schema                            # a clashing column of the input stays what it was
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t, _ in rows if not dc.brute_force(t, known)[1])


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.contamination_report(make_docs([]), none).count() == 0
    assert [r.contaminated for r in dc.contamination_report(make_docs([(1, "a b", "en")]), none).collect()] == [False]


def test_passes_write_hits_and_no_text_and_repeated_items_count_once(spark, make_docs, monkeypatch):
    docs, items = _case(random.Random(4))
    seen, reliable = [], dc.reliable
    monkeypatch.setattr(dc, "reliable", lambda df: seen.append((df.columns, (out := reliable(df)).count())) or out)
    rows = [(i % 7 if i % 3 else None, t, "en") for i, t in enumerate(docs * 4)]
    bench = spark.createDataFrame(items * 50, "item_id string, text string")
    got = sorted((r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in dc.contamination_report(make_docs(rows), bench, group_bytes=400).collect())
    assert got == sorted(dc.brute_force(t, items) for _, t, _ in rows)
    assert len(seen) > 1 and all(cols == ["k1", "k2", "hit"] for cols, _ in seen)
    assert all(n <= len(set(docs)) for _, n in seen)
    groups = dc.item_groups(bench, "item_id", "text", 1 << 20)
    assert len(groups) == 1 and groups[0].count() == len({(i, t) for i, t in items if t is not None})
