"""HTML main text (operator 10): site template removal by element subtrees that recur on a host.

1. Every page is parsed in place; each block element gets a hash of its subtree (tags and text, not attributes).
2. Spark counts, per host and subtree hash, the different main texts that it stands beside (a page's text without its sure boilerplate), so
   that copies of one page do not make its article a template.  A subtree is a *template* if it stands on pages with at least
   ``min_pages`` of them; a passage (a paragraph, heading, list item or quotation, or what holds a block of 25 words) if with ``many_pages`` or, on smaller
   hosts, ``min_share`` of the host's, as passages that a few articles share are content.
3. Pages are parsed again; the text under template subtrees, and under elements that are boilerplate by their very
   tag, role or class (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments), goes.

A class or id word, a role, or a form or fieldset around it is a weak mark.  Beside an article with text, a marked element that neither
lies in nor holds one goes whatever its size (beside a main, if there is no article); elsewhere it goes only if it holds at most half of
the page's text that is left after templates and sure boilerplate (articles and mains so marked are weighed together), and
never all that is left.

What stays: every block that is neither, wherever it stands; ``article`` and ``main`` choose nothing.  They only shield
passages: inside them container elements can be templates, never paragraphs, headings, list items or quotations.
Outside, any block can be a template, also a run of text between the children of an element.

Time and memory are linear in the page, also for markup that is never closed: blocks name their element, elements their parent.

Templates are few (they recur).  Their number is measured: up to ``broadcast_rows`` they are broadcast; beyond that each
page's template hashes are found by a shuffle join and joined to the pages by content hashes.

Defined results: null or empty html gives an empty text; a page cut off anywhere keeps the text before the
cut (an unfinished tag goes, an unfinished character reference stays as it is); null urls share one nameless host;
rows with null or repeated ids are processed one by one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as references
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashcurve.llm.common import bound_batches, reliable

# Element names of the HTML standard, grouped by what they mean for text.
RAW = frozenset("script style title textarea noscript iframe noembed noframes template xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search
section summary table tbody td tfoot th thead tr ul""".split())
BOILERPLATE = frozenset("""nav footer aside menu dialog head button select option optgroup svg canvas object audio
video map math search""".split())
WEAK = frozenset("form fieldset".split())            # boilerplate unless they hold most of the text
WHOLE = frozenset("html body article main".split())
PASSAGE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th tr tbody thead figcaption caption summary".split())
CLOSES = {"li": frozenset({"li"}), "dd": frozenset({"dd", "dt"}), "dt": frozenset({"dd", "dt"}), "tr": frozenset({"tr", "td", "th"}),
          "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}
SCOPE = frozenset("ul ol dl table body article main section div nav footer aside header form select".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
# Words that sites use in class and id names of boilerplate.
NAMES = frozenset("""ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies
consent gdpr notice notices notification alert sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead
header comment comments disqus replies reply share sharing social related recommended newsletter subscribe subscription
signup login popup modal overlay pagination pager widget toolbar skip legal copyright""".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertising adsense".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_OPEN = re.compile(r"</?[a-zA-Z]|<[!?]")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


HIDDEN, ADVERT, NAMED = 3, 2, 1
PASSAGE_WORDS = 25


def boilerplate_attributes(attributes: str) -> int:
    """HIDDEN if an element is not shown, ADVERT if all its class and id words are, NAMED if its class, id or role is one of
    boilerplate, else 0."""
    out, words = 0, []
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            words += [w.lower() for w in _NAME.findall(value)]
        elif name == "role":
            if value.lower() in ROLES:
                out = NAMED
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return HIDDEN
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return HIDDEN
    if words and ADVERTS.issuperset(words):
        return ADVERT
    return out if NAMES.isdisjoint(words) else NAMED


@dataclass(eq=False)
class Element:
    tag: str
    gone: bool                      # surely boilerplate, or inside it
    area: int                       # 2 inside an article, 1 inside main, 0 elsewhere
    weak: int = 0                   # marked as boilerplate by a word or a form: NAMED or ADVERT
    parent: Element | None = None
    parts: list[str] = field(default_factory=list)
    digest: int = 0
    words: int = 0                  # of the subtree
    longest: int = 0                # words of its longest block
    below: int = 0                  # while a text is chosen: what is left under it
    inside: int = 0                 # the largest area of text left under it
    drop: bool = False

    @property
    def removable(self) -> bool:
        return self.tag not in WHOLE and not (self.area and self.tag in PASSAGE)


@dataclass
class Page:
    """Blocks as (text, element, hash of the text outside articles, text with weakly marked inline elements), and every
    block element, parents first."""

    blocks: list[tuple[str, Element, int | None, str]] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)
    removed: dict[str, int] = field(default_factory=dict)       # characters of the last text's blocks that went, by what removed them

    def hashes(self) -> dict[int, bool]:
        """Hashes of all that could be a template (elements, and runs of text beside other children of their element), and whether they
        hold a passage."""
        out = {e.digest: e.tag in PASSAGE or e.longest >= PASSAGE_WORDS for e in self.elements if e.words and e.removable}
        return out | {h: len(full.split()) >= PASSAGE_WORDS for _, e, h, full in self.blocks if h is not None and len(e.parts) > 1}

    def main(self) -> int:
        """Hash of the text without sure boilerplate and named elements."""
        return _hash([self.text(frozenset())])

    def text(self, templates: set[int] | frozenset[int]) -> str:
        for e in self.elements:                                      # parents first
            e.drop = (e.parent is not None and e.parent.drop) or (e.digest in templates and e.removable)
            e.below = e.inside = 0
        left, gone = [], {"tag": 0, "template": 0, "name": 0}
        for b in self.blocks:
            by = "tag" if b[1].gone else "template" if b[1].drop or b[2] in templates else None
            if by:
                gone[by] += len(b[3])
            else:
                left.append(b)
                b[1].below += len(b[3])
                b[1].inside = max(b[1].inside, b[1].area)
        for e in reversed(self.elements):
            if e.parent is not None:
                e.parent.below += e.below
                e.parent.inside = max(e.parent.inside, e.inside)
        total = self.elements[0].below if self.elements else 0
        # text of the best area that stands in no marked element of a lower one
        best = whole = 0
        marked: dict[int, int] = {}                                  # smallest area of the marked elements around, by element
        in_whole: set[int] = set()                                   # elements in a marked article or main
        for e in self.elements:
            over = marked.get(id(e.parent), 3)
            marked[id(e)] = min(over, e.area) if e.weak else over
            if id(e.parent) in in_whole or (e.weak and e.tag in WHOLE):
                in_whole.add(id(e))
        for _, e, _, full in left:
            if e.area and marked[id(e)] >= e.area:
                best = max(best, e.area)
            if id(e) in in_whole:
                whole += len(full)
        for e in self.elements:
            if e.weak:
                small = 2 * (whole if e.tag in WHOLE else e.below) <= total
                e.drop = small or (e.area < best and e.inside < best)
            else:
                e.drop = False
            e.drop = e.drop or (e.parent is not None and e.parent.drop)
        kept = [full if 2 * (len(full) - len(text)) > total else text for text, e, _, full in left if not e.drop]
        out = "\n".join(filter(None, kept)) or "\n".join(b[3] for b in left)
        gone["name"] = max(0, sum(len(b[3]) for b in left) - len(out))
        self.removed = gone
        return out


def _hash(parts: list[str]) -> int:
    raw = hashlib.blake2b("\x1f".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(raw, "little", signed=True)


def parse(source: str | None) -> Page:
    """One pass over the markup with a stack of open elements; closes what the standard closes implicitly."""
    page = Page()
    top = Element("html", False, 0)
    page.elements.append(top)
    stack, words = [top], []
    opened: Counter[str] = Counter()                      # open elements by tag, the top not counted
    muted, weak = [], []      # open inline boilerplate: tag, where its words start, whether surely; the weak ones' words, from and to

    def flush() -> None:
        if muted:
            unmute(0)
        text = full = " ".join("".join(words).split())
        if weak:
            for start, end in weak:
                words[start:end] = [""] * (end - start)
            text = " ".join("".join(words).split())
            weak.clear()
        words.clear()
        if full:
            here, n = stack[-1], full.count(" ") + 1
            page.blocks.append((text, here, None if here.area or here.gone else _hash(["", text or full]), full))
            here.parts.append(text or full)
            here.words += n
            here.longest = max(here.longest, n)

    def unmute(k: int) -> None:
        """Close the open inline boilerplate from the k-th on."""
        sure = next((start for _, start, surely in muted[k:] if surely), None)
        if sure is not None:
            del words[sure:]
            weak[:] = [(start, min(end, sure)) for start, end in weak if start < sure]
        if not muted[k][2]:
            weak.append((muted[k][1], len(words)))
        del muted[k:]

    def close() -> None:
        e = stack.pop()
        opened[e.tag] -= 1
        if e.tag in BLOCK:
            e.digest = _hash([e.tag, *e.parts])
            if e.words and stack:
                stack[-1].parts.append(str(e.digest))
                stack[-1].words += e.words
                stack[-1].longest = max(stack[-1].longest, e.longest)

    source = source or ""
    at, n = 0, len(source)
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            words.append(references.unescape(source[at:]))
            break
        if lt > at:
            words.append(references.unescape(source[at:lt]))
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 2)
            at = n if end < 0 else end + 3
            continue
        m = _TAG.match(source, lt) or _LOOSE.match(source, lt)
        if m is None:
            if not _OPEN.match(source, lt):
                words.append("<")
                at = lt + 1
                continue
            end = source.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        at = m.end()
        closing, tag, attributes = m.group(1), m.group(2).lower(), m.group(3)
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(f"</{tag}\\s*>?", re.I).search(source, at)
                at = n if end is None else end.end()
            continue
        if tag not in BLOCK:
            if tag == "br":
                words.append(" ")
            elif closing:
                last = next((k for k in range(len(muted) - 1, -1, -1) if muted[k][0] == tag), None)
                if last is not None:
                    unmute(last)
            elif tag in BOILERPLATE:
                muted.append((tag, len(words), True))
            elif tag not in VOID and attributes and (mark := boilerplate_attributes(attributes)):
                muted.append((tag, len(words), mark == HIDDEN))
            continue
        flush()
        if closing:
            if tag not in ("html", "body") and opened[tag] > 0:
                while stack[-1].tag != tag:
                    close()
                close()
            continue
        if tag == "hr" or tag == "html":
            continue
        ends = CLOSES.get(tag, frozenset())
        while len(stack) > 1 and (stack[-1].tag == "p" or stack[-1].tag in ends):
            close()
        if any(opened[x] > 0 for x in ends):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    while len(stack) > k:
                        close()
                    break
                if stack[k].tag in SCOPE:
                    break
        if tag == "body" and stack[-1].tag == "head":
            close()
        here = stack[-1]
        area = 2 if tag == "article" or here.area == 2 else 1 if tag == "main" or here.area == 1 else 0
        mark = boilerplate_attributes(attributes) if attributes and tag not in ("body", "head") else 0
        gone = here.gone or tag in BOILERPLATE or (tag == "header" and area < 2) or mark == HIDDEN
        stack.append(Element(tag, gone, area, mark or int(tag in WEAK), here))
        page.elements.append(stack[-1])
        opened[tag] += 1
    flush()
    while stack:
        close()
    return page


def host(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m.group(1).lower() if m else ""


def subtree_hashes(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """Per page: host, hash of its main text, and the subtrees that could be templates: those without and those with a passage."""
    kind = pa.schema([("host", pa.string()), ("main", pa.int64()), ("short", pa.list_(pa.int64())), ("long", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = parse(source)
                found = page.hashes()
                rows.append({"host": host(url), "main": page.main(), "short": [h for h, p in found.items() if not p], "long": [h for h, p in found.items() if p]})
            yield pa.RecordBatch.from_pylist(rows, kind)

    return pages.select(url_col, html_col).mapInArrow(run, "host string, main long, short array<long>, long array<long>")


def site_templates(hashes: DataFrame, min_pages: int, min_share: float, many_pages: int) -> DataFrame:
    """(host, h) of the subtrees that recur beside many different main texts of the host.

    Everything is grouped by a hash within the host, with partial counts, so a host with a third of all pages is spread
    over all tasks.  The host's own number of main texts is the count of a subtree without a hash, so the pages are read once; what passes
    ``min_pages`` is stored and meets these numbers.
    """
    said = F.explode(F.concat(F.transform("short", lambda h: F.struct(h.alias("h"), F.lit(False).alias("passage"))),
                              F.transform("long", lambda h: F.struct(h.alias("h"), F.lit(True).alias("passage"))),
                              F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(False).alias("passage")))))
    each = hashes.select("host", "main", said.alias("s")).select("host", "main", "s.h", "s.passage").distinct()
    counts = reliable(each.groupBy("host", "h", "passage").agg(F.count(F.lit(1)).alias("n")).filter(F.col("h").isNull() | (F.col("n") >= min_pages)))
    total = counts.filter(F.col("h").isNull()).select("host", F.col("n").alias("pages"))
    enough = F.when(F.col("passage"), F.least(F.col("pages") * min_share, F.lit(many_pages))).otherwise(F.least(F.col("pages") * min_share, F.lit(min_pages)))
    return counts.filter(F.col("h").isNotNull()).join(total, "host").filter(F.col("n") >= enough).select("host", "h").distinct()


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 4,
              min_share: float = 0.5, broadcast_rows: int = 500_000, many_pages: int = 10) -> DataFrame:
    """Per page: page_id, url, text, n_chars, and the characters that tags, templates and names removed."""
    spark = pages.sparkSession
    bound_batches(spark)
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    hashes = subtree_hashes(slim, "url", "html")
    templates = site_templates(hashes, min_pages, min_share, many_pages)
    known = templates.limit(broadcast_rows + 1).collect()
    if len(known) <= broadcast_rows:
        by_host: dict[str, set[int]] = {}
        for r in known:
            by_host.setdefault(r["host"], set()).add(r["h"])
        shared = spark.sparkContext.broadcast(by_host)
        source = slim
    else:
        shared = spark.sparkContext.broadcast(None)
        source = _with_page_templates(slim, templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, sources = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            if shared.value is None:
                drop = [frozenset(x or ()) for x in batch.column(3).to_pylist()]
            else:
                drop = [shared.value.get(host(u), frozenset()) for u in urls]
            parsed = [parse(s) for s in sources]
            texts = [p.text(d) for p, d in zip(parsed, drop, strict=True)]
            by = [pa.array([p.removed[k] for p in parsed], pa.int64()) for k in ("tag", "template", "name")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), *by],
                                             ["page_id", "url", "text", "n_chars", "by_tags", "by_templates", "by_names"])

    schema = slim.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return source.mapInArrow(run, schema.add("by_tags", "long").add("by_templates", "long").add("by_names", "long"))


def _with_page_templates(slim: DataFrame, templates: DataFrame) -> DataFrame:
    """The pages with the array of their own template hashes, by shuffle joins on the subtree and on the page's content."""
    keyed = slim.withColumn("k1", F.xxhash64("url", "html")).withColumn("k2", F.xxhash64("html", F.lit(1), "url"))
    kind = "k1 long, k2 long, host string, h long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"k1": a, "k2": b, "host": host(u), "h": h} for u, s, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                    for h in parse(s).hashes()]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("host", pa.string()), ("h", pa.int64())]))

    found = (keyed.select("url", "html", "k1", "k2").mapInArrow(run, kind).join(templates, ["host", "h"])
             .groupBy("k1", "k2").agg(F.collect_set("h").alias("drop")))          # bounded by one page's subtrees
    return keyed.join(found, ["k1", "k2"], "left").select("page_id", "url", "html", "drop")
