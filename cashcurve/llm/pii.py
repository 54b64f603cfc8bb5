"""Personal data (operator 8): candidate generators, boosted trees, calibrated thresholds.  DataFrame functions only.

*Base spans* follow fixed rules (e-mail, IP address, payment card with Luhn check, phone with +) and always stay.
*Generators* propose more, overlapping spans with high recall: every dotted quad and every long digit run also when the
check fails, numbers in phone grouping without + (also the part of a number after its country code), and addresses written with "at" and
"dot".
*Boosted trees* score every proposal by format (digits, longest run, separators, brackets) and context (neighbouring
characters, a keyword before it); checks that define the base spans are no features, so the trees learn what such data
look like rather than the rules.  They are fitted, by gradient boosting on the log loss, to the proposals of
three quarters of all documents, where a proposal counts as personal if it overlaps a
base span of its kind; what reaches the driver is one count per distinct feature row.
*Calibrated thresholds*: on the quarter of the documents that the trees have not seen, scores are calibrated (isotonic), and each kind gets
the lowest score at which at least ``precision`` of the proposals are personal.  Proposals above it that overlap no base span are read from left
to right: of two that overlap the better stays, and one that gave way comes back if the one it gave way to gives way in turn.

Everything runs in place on the scan, without a shuffle; offsets are code points.  The regular expressions are possessive and start
only at the beginning of a run, so very long runs of digits or letters take linear time.  So do texts with very many matches: positions are
running sums and overlaps running maxima over sorted spans, both made in chunks, so that no list is copied at every match.

Defined results: a null text counts as empty; texts without data give zero counts and empty strings; without enough
proposals to calibrate a kind nothing is added for it; repeated rows and null ids are handled row by row; extra columns are ignored
(``find``) or kept (``redact``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashcurve.llm.common import fresh

#: Kinds in the order of the output (fixed by contract).
KINDS = ("email", "ip", "card", "phone")

_LOCAL = "[A-Za-z0-9._%+-]"
# The contract's patterns, written so that a failing run is tried once: a match starts where a run starts, or where the last ended.
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_AT, _DOT = r"(?i:@| ?\[at\] ?| ?\(at\) ?| at )", r"(?i:\.| ?\[dot\] ?| ?\(dot\) ?| dot )"
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9A-Za-z])\(?[0-9](?:[ ().-]{0,2}[0-9])++(?![A-Za-z])",
    "local": r"(?<![0-9A-Za-z])\(?[0-9]{2,5}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])",
}
#: Implied by the patterns, and cheaper: a text without a match of these has no proposal of the kind.
MAYBE = {"email": r"(?i)@|[\[( ]at[\]) ]", "phone": "[0-9][ ().-]{0,2}[0-9]", "local": "[0-9][ .-][0-9]{3}"}
_KEYWORD = r"(?i)(?:call|phone|tel|fax|mobile|contact|mail|write|reach|address|host|server|card|visa|account|payment)[^A-Za-z]*$"
#: Feature -> largest value (smaller ones are kept as they are).
FEATURES = {"kind": 3, "digits": 20, "longest": 20, "letters": 12, "dots": 6, "spaces": 6, "hyphens": 6, "brackets": 4, "before": 4,
            "after": 4, "keyword": 1}


#: Elements of an array that are folded at a time; longer arrays are folded chunk by chunk.
CHUNK = 128


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _chunks(values: Column) -> Column:
    """The array cut into arrays of CHUNK elements; ``values`` is a lambda's variable."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(CHUNK)), lambda i: i <= F.size(values))
    return F.transform(starts, lambda i: F.slice(values, i, F.lit(CHUNK)))


def _running(values: Column, join) -> Column:
    """For every element what ``join`` (a sum or a maximum) makes of the elements before it, beginning with 0."""
    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))

    def before(chunk: Column) -> Column:
        return F.aggregate(chunk, nothing, lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def joined(parts: Column) -> Column:
        firsts = before(F.transform(parts, lambda c: c["at"]))["out"]
        return F.flatten(F.transform(F.arrays_zip(parts.alias("p"), firsts.alias("f")), lambda z: F.transform(z["p"]["out"], lambda v: join(z["f"], v))))

    return _let(values, lambda v: _let(F.transform(_chunks(v), before), joined))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _matches(text: Column, pattern: str, maybe: Column) -> Column:
    """start, end (0-based code points, end exclusive), match, 24 characters before and 1 after, of the leftmost matches; and the places in bytes."""
    empty = F.array().cast("array<struct<s:int,e:int,m:string,l:string,r:string,bs:int,be:int>>")

    def placed(rows: Column) -> Column:
        length = lambda of: F.transform(rows, lambda x: (of(x["g"]) + of(x["m"])).cast("long"))
        at = F.arrays_zip(rows.alias("x"), _running(length(F.length), _sum).alias("c"), _running(length(F.octet_length), _sum).alias("b"))

        def span(z: Column) -> Column:
            x, s, b = z["x"], (z["c"] + F.length(z["x"]["g"])).cast("int"), (z["b"] + F.octet_length(z["x"]["g"])).cast("int")
            return F.struct(s.alias("s"), (s + F.length(x["m"])).alias("e"), x["m"].alias("m"), F.right(x["g"], F.lit(24)).alias("l"),
                            F.left(x["n"], F.lit(1)).alias("r"), b.alias("bs"), (b + F.octet_length(x["m"])).alias("be"))
        return F.transform(at, span)

    def zipped(gaps: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        rows = F.arrays_zip(found.alias("m"), gaps.alias("g"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("n"))
        return F.filter(rows, lambda x: x["m"].isNotNull())

    return F.when(maybe, _let(_let(F.split(text, pattern, -1), zipped), placed)).otherwise(empty)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    places = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(places, value), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    """The base rule's check of a match."""
    n = F.length(_digits(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(
            F.split(m, r"\."), lambda p: F.coalesce(F.right(p, F.lit(4)).try_cast("int"), F.lit(0)) <= 255)
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _class(c: Column) -> Column:
    return (F.when(c == "", 0).when(c.rlike(r"^\p{L}"), 1).when(c.rlike("^[0-9]"), 2).when(c.rlike(r"^\s"), 3).otherwise(4))


def _count(m: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(m, f"[^{keep}]", ""))


def _proposal(kind: str, x: Column, base: Column) -> Column:
    """A span with its kind, whether it is a base span, and its features."""
    m, left = x["m"], F.coalesce(x["l"], F.lit(""))
    values = {"kind": F.lit(KINDS.index(kind)), "digits": _count(m, "0-9"),
              "longest": F.array_max(F.transform(F.split(m, "[^0-9]+"), lambda p: F.length(p))), "letters": _count(m, "A-Za-z"),
              "dots": _count(m, "."), "spaces": _count(m, " "), "hyphens": _count(m, r"\-"), "brackets": _count(m, r"()\[\]"),
              "before": _class(F.right(left, F.lit(1))), "after": _class(F.coalesce(x["r"], F.lit(""))),
              "keyword": left.rlike(_KEYWORD).cast("int")}
    return F.struct(F.lit(KINDS.index(kind)).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["bs"].alias("bs"), x["be"].alias("be"), base.alias("base"),
                    *[F.least(values[f], F.lit(top)).cast("int").alias(f) for f, top in FEATURES.items()])


def _checked(kind: str):
    return lambda x: _proposal(kind, x, _valid(kind, x["m"]))


def _of_kind(k: int):
    return lambda x: x["k"] == k


def _beside(base: Column, spans: Column) -> Column:
    """(x, hit) of every span: whether a base span overlaps it.

    Sorted by where a base span starts and a span ends, those base spans that start before x ends come before x: x is hit if the
    largest of their ends lies behind its start.
    """
    starts = F.transform(base, lambda b: F.struct(b["s"].alias("at"), F.lit(1).alias("kind"), b["e"].alias("reach"), b.alias("x")))
    ends = F.transform(spans, lambda x: F.struct(x["e"].alias("at"), F.lit(0).alias("kind"), F.lit(0).alias("reach"), x.alias("x")))

    def swept(events: Column) -> Column:
        reach = _running(F.transform(events, lambda v: v["reach"].cast("long")), F.greatest)
        asked = F.filter(F.arrays_zip(events.alias("v"), reach.alias("reach")), lambda z: z["v"]["kind"] == 0)
        return F.transform(asked, lambda z: F.struct(z["v"]["x"].alias("x"), (z["reach"] > z["v"]["x"]["s"]).alias("hit")))

    return _let(F.sort_array(F.concat(starts, ends)), swept)


def with_proposals(docs: DataFrame, text_col: str) -> tuple[DataFrame, str, str]:
    """``docs`` with a column of base spans and a column of the other proposals; returns both names."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    has = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][ -]?[0-9]"), "phone": text.rlike(r"\+[0-9]")}
    matched, base, other = fresh(docs, "pii_matched"), fresh(docs, "pii_base"), fresh(docs, "pii_other")
    raw = docs.withColumn(matched, F.struct(
        *[_matches(text, BASE[k], has[k]).alias(k) for k in KINDS],
        _matches(text, LOOSE["email"], text.rlike(MAYBE["email"])).alias("loose_email"),
        _matches(text, LOOSE["phone"], text.rlike(MAYBE["phone"])).alias("loose_phone"),
        _matches(text, LOOSE["local"], text.rlike(MAYBE["local"])).alias("local_phone")))
    got = F.col(matched)
    checked = F.concat(*[F.transform(got[k], _checked(k)) for k in KINDS])
    plausible = F.filter(F.concat(got["loose_phone"], got["local_phone"]), lambda x: F.length(_digits(x["m"])).between(7, 15))
    loose = F.concat(F.transform(got["loose_email"], lambda x: _proposal("email", x, F.lit(False))),
                     F.transform(plausible, lambda x: _proposal("phone", x, F.lit(False))))
    both = fresh(docs, "pii_all")
    df = raw.withColumn(both, F.concat(checked, loose)).drop(matched)
    return (df.withColumn(base, F.filter(F.col(both), lambda x: x["base"]))
            .withColumn(other, F.filter(F.col(both), lambda x: ~x["base"] & (x["digits"] + x["letters"] >= 6))).drop(both), base, other)


class BoostedTrees:
    """Depth-two trees on small integer features, fitted to weighted counts of distinct feature rows."""

    def __init__(self, rounds: int = 30, rate: float = 0.3, ridge: float = 1.0):
        self.rounds, self.rate, self.ridge = rounds, rate, ridge
        self.bias, self.trees = 0.0, []

    def fit(self, rows: list[tuple[int, ...]], positive: list[float], total: list[float]) -> BoostedTrees:
        share = (sum(positive) + 0.5) / (sum(total) + 1)
        self.bias = math.log(share / (1 - share))
        score = [self.bias] * len(rows)
        for _ in range(self.rounds if rows else 0):
            p = [1 / (1 + math.exp(-max(-30.0, min(30.0, s)))) for s in score]
            g = [y - n * q for y, n, q in zip(positive, total, p, strict=True)]
            h = [n * q * (1 - q) for n, q in zip(total, p, strict=True)]
            tree = self._grow(rows, g, h, list(range(len(rows))), 2)
            self.trees.append(tree)
            score = [s + self._value(tree, r) for s, r in zip(score, rows, strict=True)]
        return self

    def _grow(self, rows, g, h, at, depth):
        leaf = self.rate * sum(g[i] for i in at) / (sum(h[i] for i in at) + self.ridge)
        best = None
        gain = lambda a, b: a * a / (b + self.ridge)
        if depth:
            all_g, all_h = sum(g[i] for i in at), sum(h[i] for i in at)
            for f in range(len(FEATURES)):
                bins: dict[int, list[float]] = {}
                for i in at:
                    b = bins.setdefault(rows[i][f], [0.0, 0.0])
                    b[0] += g[i]
                    b[1] += h[i]
                left_g = left_h = 0.0
                for v in sorted(bins)[:-1]:
                    left_g, left_h = left_g + bins[v][0], left_h + bins[v][1]
                    worth = gain(left_g, left_h) + gain(all_g - left_g, all_h - left_h) - gain(all_g, all_h)
                    if worth > 1e-6 and (best is None or worth > best[0] + 1e-9):
                        best = (worth, f, v)
        if best is None:
            return leaf
        _, f, v = best
        return (f, v, self._grow(rows, g, h, [i for i in at if rows[i][f] <= v], depth - 1),
                self._grow(rows, g, h, [i for i in at if rows[i][f] > v], depth - 1))

    def _value(self, tree, row) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    def score(self, row: tuple[int, ...]) -> float:
        return self.bias + sum(self._value(t, row) for t in self.trees)

    def expression(self, x: Column) -> Column:
        """The same score of a proposal struct, as nested conditions."""
        names = list(FEATURES)

        def node(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            return F.when(x[names[tree[0]]] <= tree[1], node(tree[2])).otherwise(node(tree[3]))

        out = F.lit(float(self.bias))
        for tree in self.trees:
            out = out + node(tree)
        return out


class PiiModel:
    """Trees and, per kind, the score from which a proposal is added (None: never)."""

    def __init__(self, trees: BoostedTrees | None = None, cuts: dict[int, float] | None = None):
        self.trees, self.cuts = trees or BoostedTrees(0), cuts or {}

    def chosen(self, base: Column, other: Column) -> Column:
        """Added spans: above the kind's cut, apart from base spans, better than any proposal they overlap."""
        if not self.cuts:
            return F.array().cast("array<struct<k:int,s:int,e:int,bs:int,be:int>>")
        cut = F.create_map(*[c for k, v in self.cuts.items() for c in (F.lit(k), F.lit(v))])
        free = F.filter(_beside(base, F.filter(other, lambda x: x["k"].isin(list(self.cuts)))), lambda z: ~z["hit"])
        scored = F.transform(free, lambda z: F.struct(z["x"]["s"].alias("s"), z["x"]["k"].alias("k"), z["x"]["e"].alias("e"), z["x"]["bs"].alias("bs"),
                                                      z["x"]["be"].alias("be"), self.trees.expression(z["x"]).alias("v")))
        over = F.filter(scored, lambda x: x["v"] >= cut[x["k"]])
        return F.transform(_best_apart(over), lambda x: F.struct(x["k"], x["s"], x["e"], x["bs"], x["be"]))


_SCORED = "struct<s:int,k:int,e:int,bs:int,be:int,v:double>"


def _best_apart(spans: Column) -> Column:
    """Spans read from left to right, of two overlapping ones the better (ties: the first).

    ``now`` is the last one standing, ``gave`` the one that it replaced.
    """
    none = F.lit(None).cast(_SCORED)

    def step(acc: Column, x: Column) -> Column:
        now, gave = acc["now"], acc["gave"]
        apart = now.isNull() | (x["s"] >= now["e"])
        wins = ~apart & (x["v"] > now["v"])
        back = wins & gave.isNotNull() & (gave["e"] <= x["s"])
        kept = F.when(apart & now.isNotNull(), F.array(now)).when(back, F.array(gave)).otherwise(F.array().cast(f"array<{_SCORED}>"))
        return F.struct(F.when(apart | wins, x).otherwise(now).alias("now"),
                        F.when(apart | back, none).when(wins, now).otherwise(gave).alias("gave"), F.concat(acc["out"], kept).alias("out"))

    def through(chunk: Column, now: Column, gave: Column) -> Column:
        return F.aggregate(chunk, F.struct(now.alias("now"), gave.alias("gave"), F.array().cast(f"array<{_SCORED}>").alias("out")), step)

    start = F.struct(none.alias("now"), none.alias("gave"), F.array().cast(f"array<array<{_SCORED}>>").alias("out"))

    def chunked(ordered: Column) -> Column:
        def on(acc: Column, chunk: Column) -> Column:
            return _let(through(chunk, acc["now"], acc["gave"]),
                        lambda r: F.struct(r["now"].alias("now"), r["gave"].alias("gave"), F.concat(acc["out"], F.array(r["out"])).alias("out")))
        return F.aggregate(_chunks(ordered), start, on, lambda acc: F.concat(
            F.flatten(acc["out"]), F.when(acc["now"].isNotNull(), F.array(acc["now"])).otherwise(F.array().cast(f"array<{_SCORED}>"))))

    return _let(F.sort_array(spans), chunked)


def calibrated_cut(scored: list[tuple[float, int, int]], precision: float, least: int) -> float | None:
    """The lowest score whose calibrated probability is at least ``precision``; None if there is none, or too few rows.

    ``scored``: (score, proposals, personal ones).  Calibration is isotonic: from the highest score down, neighbouring levels are
    pooled until the personal share never rises, so a good average above cannot carry a bad level below.
    """
    blocks: list[list[float]] = []                                   # proposals, personal, lowest score
    for value, n, y in sorted(scored, key=lambda t: -t[0]):
        blocks.append([n, y, value])
        while len(blocks) > 1 and (blocks[-1][2] == blocks[-2][2] or blocks[-1][1] * blocks[-2][0] > blocks[-2][1] * blocks[-1][0]):
            n, y, value = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n, blocks[-1][1] + y, min(value, blocks[-1][2])]
    good = [b for b in blocks if b[1] >= precision * b[0]]
    return good[-1][2] if good and sum(b[0] for b in good) >= least else None


def _at_most(cells: DataFrame, rows: int, names: list[str]) -> DataFrame:
    """Counts of feature rows, in at most ``rows`` rows (at least one per kind and fold): while there are more, every feature but the kind is
    rounded down to steps twice as wide and equal rows are added up, so that no count is lost."""
    step = 1
    while cells.count() > rows and step <= max(FEATURES.values()):
        step *= 2
        wide = [F.col(f) if f == "kind" else (F.floor(F.col(f) / step) * step).cast("int").alias(f) for f in names]
        cells = cells.groupBy("tune", *wide).agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    return cells


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int | None = None, precision: float = 0.9,
          least: int = 50, feature_rows: int = 100_000) -> PiiModel:
    """Trees and thresholds from the proposals of all documents; ``sample_docs``, for a quick look only, takes about so many instead.

    ``least``: proposals that a kind needs for a threshold.  More than ``feature_rows`` distinct feature rows are made coarser (``_at_most``).
    """
    if sample_docs is not None and (total := docs.count()) > sample_docs:
        docs = docs.filter(F.xxhash64(id_col, text_col) < F.lit(-(1 << 63) + int((1 << 64) * sample_docs / total)).cast("long"))
    df, base, other = with_proposals(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text")
    every = F.concat(F.col(base), F.col(other))
    of = lambda spans, k: F.filter(spans, _of_kind(k))
    labelled = F.concat(*[_beside(of(F.col(base), k), of(every, k)) for k in range(len(KINDS))])
    names = list(FEATURES)
    counted = (df.select((F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id"), F.col("text")), F.lit(4)) == 0).alias("tune"), F.explode(labelled).alias("c"))
               .groupBy("tune", *[F.col(f"c.x.{f}").alias(f) for f in names])
               .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c.hit").cast("long")).alias("y")))
    # one pass over the texts: the counts are kept while they are counted, made coarser and fetched
    counted = counted.persist()
    cells = _at_most(counted, feature_rows, names).orderBy(F.desc("n"), *names, "tune").collect()
    counted.unpersist()
    fit, tune = [r for r in cells if not r["tune"]], [r for r in cells if r["tune"]]
    row = lambda r: tuple(r[f] for f in names)
    trees = BoostedTrees().fit([row(r) for r in fit], [float(r["y"]) for r in fit], [float(r["n"]) for r in fit])
    cuts: dict[int, float] = {}
    for kind in range(len(KINDS)):
        cut = calibrated_cut([(trees.score(row(r)), r["n"], r["y"]) for r in tune if r["kind"] == kind], precision, least)
        if cut is not None:
            cuts[kind] = cut
    return PiiModel(trees, cuts)


def _listed(spans: Column) -> Column:
    order = F.sort_array(F.transform(spans, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))))
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(order, lambda x: F.concat_ws(":", kinds[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame, model: PiiModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, base_spans, n_added."""
    df, base, other = with_proposals(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text")
    b = F.col(base)
    plain = F.transform(b, lambda x: F.struct(x["k"], x["s"], x["e"], x["bs"], x["be"]))
    df = df.withColumn("added", model.chosen(b, F.col(other))).withColumn("base_spans", _listed(b))
    counts = [F.size(F.filter(b, _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return df.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"),
                     F.when(F.size("added") > 0, _listed(F.concat(plain, "added"))).otherwise(F.col("base_spans")).alias("spans"),
                     "base_spans", F.size("added").cast("long").alias("n_added"))


def redact(docs: DataFrame, model: PiiModel, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents with every span, base or added, replaced by its kind in square brackets.

    ``length_col``, if the documents have it, becomes the new length in code points of the texts that changed.
    """
    cols = docs.columns
    df, base, other = with_proposals(docs, text_col)
    b = F.col(base)
    plain = F.transform(b, lambda x: F.struct(x["k"], x["s"], x["e"], x["bs"], x["be"]))
    spans = F.sort_array(F.transform(F.concat(plain, model.chosen(b, F.col(other))), lambda x: F.struct(x["bs"].alias("s"), x["be"].alias("e"), x["k"].alias("k"))))
    text, kinds = F.col(text_col), F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    found, bytes_ = fresh(df, "pii_spans"), fresh(df, "pii_bytes")
    df = df.withColumn(found, spans).withColumn(bytes_, F.encode(text, "UTF-8"))
    spans = F.col(found)

    def cut(at: Column, to: Column) -> Column:
        """Bytes from ``at`` to ``to`` of the text: a slice of bytes does not count characters from the start."""
        return F.decode(F.substring(F.col(bytes_), (at + 1).cast("int"), (to - at).cast("int")), "UTF-8")

    def pieces(ends: Column) -> Column:
        # a span that begins inside an earlier one has no mark of its own
        return F.transform(F.arrays_zip(spans.alias("x"), ends.alias("end")), lambda z: F.when(z["x"]["s"] >= z["end"], F.concat(
            cut(z["end"], z["x"]["s"]), kinds[z["x"]["k"]])).otherwise(F.lit("")))

    reach = _running(F.transform(spans, lambda x: x["e"].cast("long")), F.greatest)
    whole = F.concat(F.array_join(_let(reach, pieces), ""), cut(F.array_max(F.transform(spans, lambda x: x["e"])), F.octet_length(text)))
    touched = F.size(spans) > 0
    out = df.select(*[F.when(touched, whole).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in cols], touched.alias(base))
    if length_col in cols:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(F.col(base), F.length(text_col).cast(kind)).otherwise(F.col(length_col)))
    return out.select(*[f"`{c}`" for c in cols])
