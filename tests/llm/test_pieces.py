import random
import tracemalloc

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from cashcurve.llm import pieces as pc

from .conftest import ODD_TEXTS, prose

MODEL = pc.load_model()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pc.MODEL_PATH)


def _encode(text):
    return pc.TrieEncoder(MODEL).encode([text])[0]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encoding_equals_the_library(text):
    assert _encode(text) == LIBRARY.encode(text)
    assert pc.decode_ids(MODEL, _encode(text)) == text.replace("▁", " ")


def test_odd_texts_and_trie_order():
    rng = random.Random(1)
    texts = [t for t in ODD_TEXTS if t is not None] + [prose(rng, 50, x) for x in ("en", "de", "fr")] + ["   a", "a  ", "=" * 300, "ab" * 999]
    together = pc.TrieEncoder(MODEL)
    together.encode(texts)
    tiny = pc.TrieEncoder(MODEL, remember=3)
    for t in texts:
        want = LIBRARY.encode(t)
        assert together.encode([t])[0] == want and tiny.encode([t])[0] == want
    assert tiny.encode([*texts, None]) == [*(LIBRARY.encode(t) for t in texts), None]
    assert pc.TrieEncoder(MODEL).encode([]) == [] and pc.TrieEncoder(MODEL).encode(["", None, "a"]) == [[], None, LIBRARY.encode("a")]


def test_long_unbroken_strings_take_linear_memory():
    rng = random.Random(3)
    texts = ["".join(rng.choices(letters, k=200_000)) for letters in ("abcdefghijklmnopqrstuvwxyz", "ACGT", "abc日本語\x00é\U0001f600")]
    tracemalloc.start()
    try:
        got = [_encode(t) for t in texts]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got == [LIBRARY.encode(t) for t in texts] and peak < 200_000_000
    # the two ways meet at any length, also in words that share prefixes of either kind
    words = [t[:n] for t in texts for n in (1, 2, 5, 47, 48, 49, 50, 100)]
    for short in (0, 1, 48, 1000):
        assert pc.TrieEncoder(MODEL, short=short).encode(words) == [LIBRARY.encode(w) for w in words]


def test_remembered_ids_are_bounded():
    rng = random.Random(4)
    encoder = pc.TrieEncoder(MODEL, remember_ids=1000)
    for _ in range(20):
        text = "".join(rng.choices("abcdefgh", k=2000))
        assert encoder.encode([text])[0] == LIBRARY.encode(text)
    assert len(encoder.pool) < 4000


def test_stable_pairs_equal_replayed_merges():
    rng = random.Random(2)
    names = list(MODEL.ids)
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(5000)]
    text = LIBRARY.encode(prose(rng, 3000), out_type=str)
    pairs += [(a, b) for a, b in zip(text, text[1:], strict=False) if a in MODEL.ids and b in MODEL.ids]
    assert all(MODEL._stable(a, b) == (MODEL.merge(a + b)[0] == [a, b]) for a, b in pairs)


def test_round_trip_on_spark(spark, make_docs):
    rows = [(i, t, None) for i, t in enumerate(ODD_TEXTS)] + [(None, "x y", None), (1, "x y", None), (1, "x y", None)]
    got = pc.round_trip(make_docs(rows)).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    for r, (i, t, _) in zip(sorted(got, key=lambda r: str(r.doc_id)), sorted(rows, key=lambda x: str(x[0])), strict=True):
        if t is None:
            assert r.ids is None and r.n_tokens == 0
        elif i is not None and i != 1:
            assert r.ids == LIBRARY.encode(t) and r.n_tokens == len(r.ids)
    assert pc.round_trip(make_docs([])).count() == 0
    assert pc.decode_ids(MODEL, [-1, 10 ** 9, 1, 2]) == "" and pc.decode_ids(MODEL, None) is None


def test_columns_with_clashing_names_stay(spark, make_docs):
    df = make_docs([(1, "a b", "en")]).withColumnRenamed("part", "ids")
    coded, name = pc.encode_documents(df)
    assert name == "_ids" and coded.first().ids == 7 and coded.first()._ids == LIBRARY.encode("a b")
