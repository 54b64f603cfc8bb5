import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from cashcurve.llm import packing as pk
from cashcurve.llm.queries import op13_least_squares_packing

from .conftest import ODD_TEXTS, prose


def _ids(text):
    tok = _ids.tok = getattr(_ids, "tok", None) or Tokenizer.from_file(pk.MODEL_PATH)
    return [*tok.encode(text or "", add_special_tokens=False).ids, 2]


def _crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def _checked(got, rows, window):
    """Every id of every row in exactly one piece, sequences gapless and not too long; returns the share of padding."""
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    padding = total = 0
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= window
        total += at
        padding += 0 if at & (at - 1) == 0 else window - at
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(_ids(t))
    assert set(texts) == set(by_doc)
    for i, lists in texts.items():
        pieces = by_doc[i]
        assert sum(p[1] for p in pieces) == sum(map(len, lists))
        if len(lists) == 1 or all(x == lists[0] for x in lists):
            ids = lists[0]
            covered = [0] * len(ids)
            for start, length, crc, n in pieces:
                assert n == len(ids) and crc == _crc(ids[start:start + length])
                for k in range(start, start + length):
                    covered[k] += 1
            assert set(covered) == {len(lists)}
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return padding / max(total, 1)


def test_query_packs_every_id_once(spark, make_docs, write_tables):
    rng = random.Random(2)
    rows = [(i, prose(rng, int(rng.expovariate(1 / 300)) + 1)) for i in range(900)]
    rows += [(5000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "x y"), (7, rows[7][1]), (7, rows[7][1])]
    got = op13_least_squares_packing(spark, write_tables(documents=make_docs([(i, t, None) for i, t in rows]).repartition(5)))
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [(n, "bigint") for n in (
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    got = got.collect()
    assert _checked(got, rows, 4096) == 0
    cut = defaultdict(int)
    for r in got:
        cut[r.doc_id] += r.start % 4096 != 0
    assert sum(c > 0 for c in cut.values()) < 0.2 * len(rows)        # most documents stay whole


def test_one_length_in_all_rows_still_packs(spark, make_docs):
    rows = [(i, "ab cd ef " * 30) for i in range(200)] + [(1000 + i, "x") for i in range(9)]
    docs = make_docs([(i, t, None) for i, t in rows])
    assert _checked(pk.pack(docs, window=256, step=8, block=512).collect(), rows, 256) == 0
    short = [(i, "ab") for i in range(300)]
    assert _checked(pk.pack(make_docs([(i, t, None) for i, t in short]), window=64, step=8, block=64).collect(), short, 64) == 0


def test_small_and_empty_tables(spark, make_docs):
    assert pk.pack(make_docs([])).count() == 0
    got = pk.pack(make_docs([(None, None, None)])).collect()
    assert [(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset) for r in got] == [(None, 0, 1, _crc([2]), 1, 0, 0)]
    rows = [(1, "a b c d e")]
    assert _checked(pk.pack(make_docs([(1, "a b c d e", None)])).collect(), rows, 4096) == 0


def test_run_ids_equal_the_library():
    rng = random.Random(9)
    signs = [" ", " ", "ab", "Cd", "ü", ";", "7", "  ", "\n", "\t", "'s", "'", "’", ".", ",", "%%%", "<|", "<|endoftext|>", "|>", "É", "ß", "é", "İ", "Σ", "ς", "ﬁ", "1", "23", "日本", " ", "x", "The", "don't",
             "😀", "́", "_", "-", "×", "÷", "ÀÈ", "\x00", "​", "Å"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 14))) for _ in range(3000)] + [t for t in ODD_TEXTS if t is not None]
    plain = ["Ab", "ÖL", "x_y", "12", " ", "\n", ".", "$$", "<", "|", ">", "-", "~", "[", "^", "z"]
    texts += ["".join(rng.choice(plain) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    enc = pk.RunIds(pk.MODEL_PATH, remember=500)
    for at in range(0, len(texts), 250):
        part = texts[at:at + 250]
        for t, ids in zip(part, enc.encode(pa.array(part)), strict=True):
            assert [*ids.tolist(), 2] == _ids(t), repr(t)[:80]
    assert [x.tolist() for x in enc.encode(pa.array([None, ""], pa.string()))] == [[], []]


def test_least_squares_are_non_negative_and_optimal():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = rng.random((12, 30)), rng.random(12) * 5 - 1
        x = pk.non_negative_least_squares(a, b)
        g = a.T @ (a @ x - b)                                          # conditions of the optimum
        assert x.min() >= 0 and g.min() > -1e-6 and abs(g @ x) < 1e-6
    patterns = pk.combinations(16, 8)
    assert all(sum(p) == 16 for p in patterns) and len(set(patterns)) == len(patterns) and (1, 7, 8) in patterns and (2,) * 8 in patterns
    count = np.array([0, *rng.integers(0, 500, 16)])
    times = pk.repeats(count, patterns, 0.1)
    used = np.zeros(17, dtype=int)
    for p, t in zip(patterns, times, strict=True):
        np.add.at(used, list(p), t)
    assert (used <= count).all() and used.sum() > 0.3 * count.sum()
