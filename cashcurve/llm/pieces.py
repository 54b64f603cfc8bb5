"""SentencePiece encoding and decoding (operator 5): shared-prefix Viterbi over a trie of marked words.

A text is normalised the way the model's files ask for (a leading mark, blanks written as the mark U+2581) and cut
into *marked words*: a run of marks with the characters that follow it.  No piece has a mark after another character, so
words are encoded independently.  The distinct words of a batch that the task has not met yet are sorted; sorted words
in order are a depth-first walk of their trie, so the forward states of the common prefix with the previous word are
kept and only the new suffix is computed.

The forward state.  The public model is a byte-fallback BPE model, whose encoding is not the path of the largest
score sum but the result of merging the best-ranked neighbours first.  Merges never cross a final piece
boundary, so a segmentation is the model's one exactly if every two neighbouring pieces, merged from their own
characters alone, stay as they are.  Each prefix of a word therefore has exactly one segmentation of finite score,
and the recursion keeps its last piece: a piece may extend a prefix if the pair (last piece, piece) is stable.  This is
the Viterbi recursion with scores 0 and minus infinity, exact for this kind of model.

Characters without a piece become byte pieces.  Decoding joins pieces, turns byte pieces into UTF-8 and marks
into blanks, and drops the leading one.

Defined results: a null text encodes to null and decodes to null; an empty one to no pieces; a literal U+2581 is
decoded as a blank (the model cannot tell them apart); ids outside the vocabulary decode to nothing; repeated
rows are encoded one by one; extra columns are kept.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashcurve.llm.common import bound_batches, fresh, with_fields

MARK = "▁"
#: Where the tokenizer files of this installation are; a parameter of every function that loads one.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
WIDE = 1 << 32


@dataclass
class PieceModel:
    """The vocabulary as plain tables; small and of fixed size, so it is broadcast."""

    ids: dict[str, int]                 # pieces that merging can make
    score: dict[str, float]             # the neighbours whose joint piece scores largest are merged first
    byte_ids: list[int]                 # id of each byte piece
    decoded: list[bytes]                # bytes of each id
    order: dict[str, int] = field(default_factory=dict)             # place of a piece in the order of merging
    halves: dict[str, tuple[str, str] | None] = field(default_factory=dict)
    odd: set[str] = field(default_factory=set)                      # pieces that share a score with others
    sizes: dict[str, tuple[int, ...]] = field(default_factory=dict)   # lengths of the pieces with these last two characters
    stable: dict[int, bool] = field(default_factory=dict)           # by last * WIDE + piece
    names: dict[int, str] = field(init=False)
    cut: re.Pattern = field(init=False)                             # where marked words end inside a string
    signs: str = field(init=False)                                  # punctuation before which they end after a letter
    marked_run: re.Pattern = field(default=re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+"))

    def __post_init__(self):
        if any(MARK in piece.lstrip(MARK) for piece in self.ids):
            raise ValueError("a piece has a mark inside: marked words would not be independent")
        self.names = {i: piece for piece, i in self.ids.items()}
        # cuts that no piece spans: before punctuation, after a letter or digit that no piece joins to punctuation, and around controls
        signs = {c for piece in self.ids for c in piece if not c.isalnum() and c != MARK}
        joined = {a for piece in self.ids for a, b in zip(piece, piece[1:], strict=False) if b in signs and a not in signs and a != MARK}
        spell = lambda chars: "".join(map(re.escape, sorted(chars)))
        rule = f"(?<=[^\\W_{spell(joined)}])(?=[{spell(signs)}])"
        if not any(ord(c) < 32 for piece in self.ids for c in piece):
            rule += "|(?=[\\x00-\\x1f])|(?<=[\\x00-\\x1f])"
        self.cut = re.compile(rule)
        self.signs = "".join(signs)

        by_score: dict[float, list[str]] = {}
        for piece in self.ids:
            by_score.setdefault(self.score[piece], []).append(piece)
        for k, value in enumerate(sorted(by_score, reverse=True)):
            self.order.update(dict.fromkeys(by_score[value], k))
            if len(by_score[value]) > 1:
                self.odd.update(by_score[value])
        ends: dict[str, set[int]] = {}
        for piece in self.ids:
            if len(piece) > 1:
                ends.setdefault(piece[-2:], set()).add(len(piece))
        self.sizes = {k: tuple(sorted(v)) for k, v in ends.items()}

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Pieces of a short string by merging the best-scored, then leftmost, neighbours; also the last merge."""
        parts, made = list(text), None
        while len(parts) > 1:
            best = min(((self.order[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.order),
                       default=None)
            if best is None:
                break
            i = best[1]
            made = (parts[i], parts[i + 1])
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts, made

    def half(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge makes the piece last; None if it is one character or never made."""
        if piece not in self.halves:
            parts, made = self.merge(piece) if len(piece) > 1 else ([piece], None)
            self.halves[piece] = made if len(parts) == 1 else None
        return self.halves[piece]

    def joins(self, last: int, piece: int) -> bool:
        """Whether piece number ``piece`` can follow number ``last`` (-1: nothing, or bytes) in an encoding."""
        key = last * WIDE + piece
        known = self.stable.get(key)
        if known is None:
            if len(self.stable) > 2_000_000:
                self.stable.clear()             # the same dict, as callers hold its get
            known = self.stable[key] = self._stable(self.names[last] if last >= 0 else "", self.names[piece])
        return known

    def _stable(self, left: str, right: str) -> bool:
        """Undo the merges next to the boundary, latest first: whatever could have been merged across it must come
        later than the merge that was undone."""
        if any(len(x) > 1 and self.half(x) is None for x in (left, right)):
            return False
        if not left:
            return True
        until, first, second = len(self.order) + 1, left, right
        while True:
            if first in self.odd or second in self.odd:            # merges of equal score: replay them
                return self.merge(left + right)[0] == [left, right]
            across = self.order.get(first + second)
            if across is not None and (across < until or first + second in self.odd):
                return False if across < until else self.merge(left + right)[0] == [left, right]
            made_first = self.order[first] if len(first) > 1 else -1
            made_second = self.order[second] if len(second) > 1 else -1
            if made_first < 0 and made_second < 0:
                return True
            if made_first > made_second:
                until, first = made_first, self.half(first)[1]
            else:
                until, second = made_second + 1, self.half(second)[0]


def load_model(path: str = MODEL_PATH) -> PieceModel:
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
    names = [sp.id_to_piece(i) for i in range(n)]
    ids = {names[i]: i for i in range(n) if not special[i]}
    decoded = [b"" if special[i] else names[i].replace(MARK, " ").encode() for i in range(n)]
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    for b, i in enumerate(byte_ids):
        decoded[i] = bytes([b])
    return PieceModel(ids, {p: sp.get_score(i) for p, i in ids.items()}, byte_ids, decoded)


class TrieEncoder:
    """Ids of texts by way of their marked words; words met before come from a bounded memory.

    ``known`` numbers the strings between two blanks (with the blank's mark); their ids lie in one pool, string k's from
    ``ends[k]`` to ``ends[k + 1]``, so a text's ids are gathered by numpy, not word by word.
    """

    def __init__(self, model: PieceModel, remember: int = 350_000, remember_ids: int = 4_000_000, short: int = 48):
        self.model, self.remember, self.remember_ids, self.short = model, remember, remember_ids, short
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, tuple[int, ...]] = {}              # marked word -> ids
        self.known: dict[str, int] = {}
        self.pool, self.ends = array("i"), array("q", [0])

    def learn(self, strings: set[str]) -> None:
        """Number new strings; their new marked words are encoded in sorted order, depth-first through their trie."""
        new = strings - self.known.keys()
        if new and (len(self.known) + len(new) > self.remember or len(self.pool) > self.remember_ids):
            self.forget()
            new = strings
        cut = [self.marked_words(s) for s in new]
        self.encode_words({w for ws in cut for w in ws} - self.words.keys())
        words = self.words
        parts = [words[ws[0]] if len(ws) == 1 else tuple(chain.from_iterable([words[w] for w in ws])) for ws in cut]
        first = len(self.known)
        self.known.update(zip(new, range(first, first + len(new)), strict=True))
        self.ends.extend(accumulate(map(len, parts), initial=self.ends.pop()))
        self.pool.extend(chain.from_iterable(parts))

    def marked_words(self, string: str) -> list[str]:
        if string[1:].isalpha():
            return [string]
        core = string.rstrip(self.model.signs)
        if core[1:].isalpha():
            return [core, string[len(core):]]
        return [w for w in self.model.cut.split(string) if w]

    def encode_words(self, new: set[str]) -> None:
        """Encode marked words in sorted order, i.e. depth-first through their trie."""
        model, words, short = self.model, self.words, self.short
        number, joins, stable, sizes = model.ids.get, model.joins, model.stable.get, model.sizes.get
        # per character of the current word: length and number of the segmentation's last piece; for the first ``short`` ones all its
        # ids as well (long words are traced back once, so memory grows with their length, not with its square)
        size, last, path = [0], [-1], [()]
        before = ""
        for word in sorted(new):
            keep, most = 0, min(len(before), len(word))
            while keep < most and before[keep] == word[keep]:
                keep += 1
            del size[keep + 1:], last[keep + 1:], path[keep + 1:]
            for i in range(keep + 1, len(word) + 1):
                # exactly one piece fits, so the order of trying is free: the last piece grown by a character, the character
                # alone, the others
                for n in chain((size[i - 1] + 1, 1), sizes(word[i - 2:i], ())):
                    if n <= i and (piece := number(word[i - n:i])) is not None:
                        back = last[i - n]
                        if joins(back, piece) if (s := stable(back * WIDE + piece)) is None else s:
                            size.append(n)
                            last.append(piece)
                            if i <= short:
                                path.append((*path[i - n], piece))
                            break
                else:
                    if number(word[i - 1]) is not None:
                        raise AssertionError(f"no segmentation of {word[:i]!r}")
                    size.append(1)                              # a character without a piece: its bytes
                    last.append(-1)
                    if i <= short:
                        path.append((*path[i - 1], *self.byte_pieces(word[i - 1])))
            before = word
            words[word] = path[-1] if len(word) <= short else self.traced(word, size, last, path)

    def byte_pieces(self, character: str) -> list[int]:
        return [self.model.byte_ids[b] for b in character.encode("utf-8", "surrogatepass")]

    def traced(self, word: str, size: list[int], last: list[int], path: list[tuple[int, ...]]) -> tuple[int, ...]:
        """Ids of a long word, from its last piece back to where the ids are known."""
        i, ids = len(word), []
        while i > self.short:
            ids.extend((last[i],) if last[i] >= 0 else reversed(self.byte_pieces(word[i - 1])))
            i -= size[i]
        return (*path[i], *reversed(ids))

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the numbered strings one after the other, and where each string's ids start (and the last end)."""
        ends = np.frombuffer(self.ends, dtype=np.int64)
        first, size = ends[which], ends[which + 1] - ends[which]
        edge = np.concatenate([[0], np.cumsum(size)])
        ids = np.frombuffer(self.pool, dtype=np.int32)[np.repeat(first - edge[:-1], size) + np.arange(edge[-1])] if edge[-1] else np.empty(0, np.int32)
        return ids, edge

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids start (and the last end).

        Arrow cuts the texts at blanks and numbers the distinct strings; Python sees each of these once.  Texts in which blanks or
        marks follow each other are cut by a pattern that keeps runs of marks together.
        """
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.or_(pc.match_substring(texts, MARK), pc.match_substring(texts, "  ")), pc.or_(pc.starts_with(texts, " "), pc.equal(texts, "")))
        plain = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        names = plain.flatten().dictionary_encode()
        cut = [self.model.marked_run.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts.filter(odd).to_pylist()]
        distinct = [MARK + w for w in names.dictionary.to_pylist()]
        self.learn({*distinct, *chain.from_iterable(cut)})
        known = self.known
        number = np.fromiter(map(known.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        ids, edge = self.gather(number[np.asarray(names.indices)])
        starts = edge[np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(plain), dtype=np.int64))]).astype(np.int64)]
        plain_parts = (ids[a:b] for a, b in zip(starts, starts[1:], strict=False))
        odd_parts = (self.gather(np.array([known[w] for w in ws], dtype=np.int64))[0] for ws in cut)
        parts = [next(odd_parts) if o else next(plain_parts) for o in odd.to_pylist()]
        return np.concatenate([np.empty(0, np.int32), *parts]), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)

    def encode(self, texts: list[str | None]) -> list[list[int] | None]:
        ids, starts = self.encode_flat(pa.array(texts, pa.string()))
        return [None if t is None else ids[a:b].tolist() for t, a, b in zip(texts, starts, starts[1:], strict=False)]


def decode_ids(model: PieceModel, ids) -> str | None:
    """The text of a sequence of ids."""
    if ids is None:
        return None
    try:
        text = b"".join(map(model.decoded.__getitem__, ids))
        known = min(ids, default=0) >= 0
    except IndexError:
        known = False
    if not known:
        text = b"".join([model.decoded[i] for i in ids if 0 <= i < len(model.decoded)])
    text = text.decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def _shared(spark: SparkSession, path: str):
    bound_batches(spark)
    return spark.sparkContext.broadcast(load_model(path))


def _id_lists(ids: np.ndarray, starts: np.ndarray, texts: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids, pa.int32()), mask=pc.is_null(texts))


def encode_documents(docs: DataFrame, text_col: str = "text", path: str = MODEL_PATH, out: str = "ids") -> tuple[DataFrame, str]:
    """``docs`` with an array<int> column of piece ids, whose name (``out``, made unique) is returned.

    One map over the scan, no shuffle.  A task's memory is bounded by the batch and the remembered words.
    """
    shared = _shared(docs.sparkSession, path)
    out = fresh(docs, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TrieEncoder(shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            yield pa.RecordBatch.from_arrays([*batch.columns, _id_lists(*encoder.encode_flat(texts), texts)], [*batch.schema.names, out])

    return docs.mapInArrow(run, with_fields(docs.schema, (out, T.ArrayType(T.IntegerType())))), out


def decode_documents(docs: DataFrame, ids_col: str = "ids", path: str = MODEL_PATH, out: str = "decoded") -> tuple[DataFrame, str]:
    """``docs`` with a string column of decoded text, whose name (``out``, made unique) is returned."""
    shared = _shared(docs.sparkSession, path)
    out = fresh(docs, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(shared.value, x) for x in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    return docs.mapInArrow(run, with_fields(docs.schema, (out, T.StringType()))), out


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL_PATH) -> DataFrame:
    """Per document: doc_id, n_tokens, ids, and whether decoding the ids gives the text back (marks as blanks).

    Encoding and decoding share one pass, so the ids do not travel between two Python processes.
    """
    shared = _shared(docs.sparkSession, path)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "n_tokens", "ids", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        encoder = TrieEncoder(model)
        for batch in batches:
            texts = batch.column(1)
            ids, starts = encoder.encode_flat(texts)
            same = [t is None or decode_ids(model, ids[a:b].tolist()) == t.replace(MARK, " ")
                    for t, a, b in zip(texts.to_pylist(), starts, starts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(starts)),
                                              _id_lists(ids, starts, texts), pa.array(same, pa.bool_())], names)

    schema = with_fields(slim.select("doc_id").schema, ("n_tokens", T.LongType()), ("ids", T.ArrayType(T.IntegerType())),
                         ("round_trip", T.BooleanType()))
    return slim.mapInArrow(run, schema)
