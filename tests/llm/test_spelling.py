import random
import re
import zlib
from collections import Counter

from cashcurve.llm import spelling as sp
from cashcurve.llm.queries import op11_permuterm_variants

from .conftest import ODD_TEXTS, prose


def _counts(rows, every=97):
    """The vocabulary by the contract's words."""
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def _near(a, b):
    """Exactly one inserted, deleted or replaced character."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _brute(n):
    out = {}
    for w in n:
        near = [x for x in n if _near(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = [form, None, n[w], len(near), n[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        row[1] = root
    return out


def _rows(got):
    table = {r.word: [r.form, r.root, r.n, r.n_near, r.form_n] for r in got}
    assert len(table) == len(got)
    return table


def test_query_equals_brute_force(spark, make_docs, write_tables):
    rng = random.Random(5)
    words = ["hollow", "hallow", "hollows", "hollo", "aaaaab", "aaaab", "aaaaaa", "äußere", "aussere", "übeln", "übel×n", "Hollow", "HOLLOW", "follow"]
    rows = [(i, prose(rng, 40) + " " + " ".join(rng.choice(words) for _ in range(12))) for i in range(400)]
    rows += [(9000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "hollow hollow"), (3, rows[3][1]), (3, rows[3][1]), (3, "other hollow")]
    want = _brute(_counts(rows))
    docs = make_docs([(i, t, None) for i, t in rows]).repartition(5)
    got = op11_permuterm_variants(spark, write_tables(documents=docs))
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"),
                                                                         ("n_near", "bigint"), ("form_n", "bigint")]
    assert _rows(got.collect()) == want
    assert any(r[1] != w for w, r in want.items()) and any(r[3] > 3 for r in want.values())


def test_neighbours_of_random_words_equal_brute_force(spark):
    rng = random.Random(7)
    n = {"".join(rng.choice("aabc") for _ in range(rng.randrange(5, 9))): rng.randrange(3, 9) for _ in range(600)}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {r.word: (r.n_near, r.near_word, r.near_n) for r in sp.neighbours(df).collect()}
    for w in n:
        near = [x for x in n if _near(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        assert got.get(w) == ((len(near), best, n[best]) if near else None), w


def test_long_words_have_the_same_neighbours_as_short_ones(spark):
    rng = random.Random(8)
    n = {"".join(rng.choice("aabé") for _ in range(rng.randrange(5, 9))): rng.randrange(3, 9) for _ in range(900)}
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(6)
    want = {(r.word, r.n_near, r.near_word, r.near_n) for r in sp.neighbours(df).collect()}
    assert len(want) > 300
    for longest in (4, 6, 8):                                         # words on either side of the limit, and all of them beyond it
        assert {(r.word, r.n_near, r.near_word, r.near_n) for r in sp.neighbours(df, longest).collect()} == want


def test_runs_of_a_hundred_thousand_letters(spark, make_docs):
    rng = random.Random(9)
    run = "".join(rng.choice("acgt") for _ in range(100_000))
    other, less = run[:50_000] + "x" + run[50_001:], run[:70_000] + run[70_001:]
    texts = [run] * 9 + [other] * 3 + [less] * 3
    # ids whose crc32 leaves the runs as they are
    ids = [[i for i in range(400) if zlib.crc32(f"{i}:{t}".encode()) % 97][k] for k, t in enumerate(texts)]
    got = _rows(sp.variants(make_docs([(i, t, None) for i, t in zip(ids, texts, strict=True)])).collect())
    assert got == {run: [None, run, 9, 2, None], other: [run, run, 3, 1, 9], less: [run, run, 3, 1, 9]}


def test_chains_lead_to_their_ends(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)] + [(f"x{i}", "w5") for i in range(50)], "word string, form string")
    assert {(r.word, r.root) for r in sp.with_roots(forms).collect()} == {(f"w{i}", "w37") for i in range(37)} | {(f"x{i}", "w37") for i in range(50)}
    assert sp.with_roots(forms.limit(0)).count() == 0


def test_one_word_in_all_rows_is_one_row_per_task_and_a_small_memory_changes_nothing(spark, make_docs):
    rows = [(i, f"common common word{'abcdefgh'[i % 8]}x letters" if i % 3 else "common " * 50) for i in range(900)]
    docs = make_docs([(i, t, None) for i, t in rows])
    whole = {r.word: r.n for r in sp.word_counts(docs).collect()}
    assert whole == _counts(rows)
    assert {r.word: r.n for r in sp.word_counts(docs, most=3).collect()} == whole
    assert {r.word: r.n for r in sp.word_counts(docs, most_letters=20).collect()} == whole


def test_contexts_grow_with_the_vocabulary_and_no_table_is_empty_handed(spark, make_docs):
    df = spark.createDataFrame([("hollow", 3), ("aaaaaa", 4)], "word string, n long")
    assert sp.contexts(df).count() == 2 * (2 * 6 + 1)
    assert sp.variants(make_docs([])).count() == 0
    assert sp.variants(make_docs([(1, None, None), (2, "", None), (3, "ab cd", None)])).count() == 0
