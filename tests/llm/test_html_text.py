import pytest

from cashcurve.llm import html_text as ht
from cashcurve.llm.queries import op10_site_template_text

from .conftest import ODD_TEXTS


def _text(source, templates=frozenset()):
    return ht.parse(source).text(templates)


@pytest.mark.parametrize(("source", "want"), [
    ("<article><h1>T &amp; U</h1><p>a\n b<b>c</b>&nbsp;d<p>e<br>f</article><footer>&copy;</footer>", "T & U\na bc d\ne f"),
    ("<body><nav><ul><li>n</ul></nav><main><p>m</main><aside>s</aside>", "m"),
    ("<div class='site-notice'>n</div><div id=content><p>x</p></div><form>f<p>g</form>tail", "x\ntail"),
    ("<article><p>x<section class='reader-comments'><p>c</section><p>y</article>", "x\ny"),
    ("<article><header><h1>T</h1></header><p>x</article><header>site</header>", "T\nx"),
    ("<article>a <span class=ad>buy</span> b <button>press</button> c</article>", "a b c"),
    ("<script>var t='</p><article>';</script><style>p{}</style><p>x<!-- <p>no</p> --> y", "x y"),
    ("<p>1 < 2 &am", "1 < 2 &am"), ("<p>cut &amp", "cut &"), ("<p>cut <a href='x", "cut"), ("<p>x</artic", "x"), ("<p>x<", "x<"),
    ("<ul><li>1<li>2<ul><li>3</ul><li>4</ul><table><tr><td>a<td>b<tr><td>c</table>", "1\n2\n3\n4\na\nb\nc"),
    ("<p class=\"a>b\" title='<x>'>ok</p>", "ok"), ("<div hidden>h</div><div style='display: none'>s</div><div aria-hidden=true>t</div>v", "v"),
    ("<article><p>a</article><article class='comment'><p>b</article>", "a"), ("", ""), (None, ""), ("</p></div>x", "x"),
    ("<title>t</title><textarea>no</textarea>yes", "yes")])
def test_parsing(source, want):
    assert _text(source) == want


def _page(host, i, body):
    return (i, f"https://{host}/p/{i}?q=1", f"<html><body><div><div>Read {host} daily</div><p>links</p></div>{body}</body></html>")


def _pages():
    rows = [_page("a.example", i, f"<article><p>story {i}</p><p>shared passage</p><div><p>sign up</p></div></article>") for i in range(12)]
    rows += [_page("b.example", 100 + i, f"<p>words {i} and more</p>") for i in range(12)]
    rows += [_page("c.example", 200 + i, "<p>copied text</p>") for i in range(12)]            # copies of one page
    return rows + [_page("d.example", 300 + i, f"<p>w{i}</p>") for i in range(3)]             # too few pages


def test_templates_go_and_shared_passages_stay(spark):
    rows = _pages() + [(900 + i, f"https://a.example/{i}", t) for i, t in enumerate(ODD_TEXTS)] + [(901, None, "<p>x"), (None, "https://b.example/x", None)]
    df = spark.createDataFrame([(i, u, h, "t", 3) for i, u, h in rows], "page_id long, url string, html string, text string, n_chars int").repartition(5)
    broadcast = ht.main_text(df).collect()
    joined = ht.main_text(df, broadcast_rows=0).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, broadcast)) == sorted(map(key, joined)) and len(broadcast) == len(rows)
    got = {r.page_id: r for r in broadcast if r.page_id is not None}
    for i in range(12):
        assert got[i].text == f"story {i}\nshared passage"       # the recurring container goes, the recurring paragraph stays
        assert got[100 + i].text == f"words {i} and more"
        assert got[200 + i].text == "Read c.example daily\nlinks\ncopied text"
    assert got[300].text == "Read d.example daily\nlinks\nw0"
    assert all(r.n_chars == len(r.text) for r in broadcast)


@pytest.mark.parametrize(("source", "want"), [
    ("<main class='no-sidebar'><p>x</main>", "x"), ("<article class='post has-comments'><h1>T</h1><p>x</article>", "T\nx"),
    ("<div id='page-with-sidebar'><p>long text</p><div class=sidebar>s</div></div>", "long text"),
    ("<div class='legal-news'><p>x</div>", "x"), ("<form action=default.aspx><nav>n</nav><div><p>x y z</div><fieldset>f</fieldset></form>", "x y z"),
    ("<article class='post has-comments'><p>a</article>" * 3 + "<div class=ad>b</div>", "a\na\na"),
    ("<div class=promo>a</div><div class=legal>b</div>", "a\nb"), ("<span class=legal-text>all of it<br>here</span> ok", "all of it here ok"),
    ("<p>some words <span class=ad>buy <button>b</button> now</span> stay</p>", "some words stay"),
    ("<p>some words <span hidden>h <b class=ad>x</b></span> stay <i class=ad>cut", "some words stay"),
    ("<body><div class=ad>buy</div><p>some words</p>", "some words"), ("<div class=ad>a long advert</div><article><p>x</article>", "x"),
    ("<div class=ad>the offer itself</div><p>x</p>", "the offer itself\nx"), ("<div id=ads><article>the offer</article></div><article>x</article>", "the offer\nx")])
def test_words_and_forms_remove_only_the_smaller_part(source, want):
    assert _text(source) == want


def test_a_large_marked_block_goes_if_it_recurs(spark):
    rows = [(i, f"https://g.example/{i}", f"<body><div class=notice><p>{'long notice ' * 20}</p></div><p>w{i}</p></body>") for i in range(8)]
    got = ht.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.text for r in got) == [f"w{i}" for i in range(8)]


def test_a_block_on_a_third_of_a_hosts_pages_is_a_template(spark):
    menu, few = "<div>Section menu<p>More</p></div>", "<p>on nine pages</p>"
    rows = [(i, f"https://h.example/{i}", f"<body>{menu if i % 10 < 3 else ''}<p>w{i}</p>{few if i < 9 else ''}</body>") for i in range(100)]
    for r in ht.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text == f"w{r.page_id}" + ("\non nine pages" if r.page_id < 9 else "")


def test_blocks_outside_articles_stay_unless_they_recur(spark):
    card = "<article><h3>Teaser {}</h3><p>more {}</p></article>"
    bodies = {"e.example": "<main><p>long story {}</p>" + card + "</main>", "f.example": "<div><p>long story {}</p></div><div>" + card + "</div>"}
    rows = [(i, f"https://{h}/{i}", f"<body>Slogan<div>Menu</div>{b.format(i, i, i)}<div>About us</div></body>") for h, b in bodies.items() for i in range(8)]
    for r in ht.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text == f"long story {r.page_id}\nTeaser {r.page_id}\nmore {r.page_id}"
    assert _text("<main><p>m</p></main><div>own note</div><article>card</article>") == "m\nown note\ncard"


def test_hosts():
    assert [ht.host(u) for u in ("http://WWW.x.org:80/a", "https://u:p@y.com?q", "//z.net#f", "no url", "", None)] == ["www.x.org", "y.com", "z.net", "", "", ""]


def test_query_on_an_empty_table(spark, write_tables):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert op10_site_template_text(spark, write_tables(pages=df)).count() == 0


@pytest.mark.parametrize(("source", "want"), [
    ("<div class=cookie-notice><p>" + "we use cookies " * 30 + "</p></div><article><p>short story</p></article>", "short story"),
    ("<article><p>short story</p></article><ul id=sidebar>" + "<li>other story" * 40 + "</ul>", "short story"),
    ("<main><article><p>short story</p></article><ol id=comments>" + "<li>what a story" * 40 + "</ol></main>", "short story"),
    ("<main><p>short story</p></main><section class=comments>" + "<p>what a story" * 40 + "</section>", "short story"),
    ("<form action=x><article><p>short story</p></article><p>" + "the rest " * 30 + "</p></form>", "short story\n" + ("the rest " * 30).strip())])
def test_marked_blocks_beside_an_article_go_whatever_their_size(source, want):
    assert _text(source) == want


def test_markup_that_is_never_closed_takes_linear_time():
    import time
    seconds = []
    for n in (4_000, 40_000):
        source = "".join(f"<div class=c><span>word {i}" for i in range(n)) + "</section>" * n + "<li>x" * n
        began = time.time()
        page = ht.parse(source)
        text = page.text(page.hashes().keys() - {0} if n < 0 else frozenset())
        seconds.append(time.time() - began)
        assert text.startswith("word 0\nword 1\n") and len(text.split("\n")) == 2 * n
    assert seconds[1] < max(30 * seconds[0], 5)


def test_templates_equal_a_count_over_all_pages(spark):
    import random
    rng = random.Random(3)
    blocks = [f"<div><b>menu {k}</b><p>item</div>" for k in range(6)] + [f"<p>passage {k}" for k in range(4)] + [f"<div><p>{'long words ' * 15}{k}</div>" for k in range(3)]
    rows = [(i, f"https://{rng.choice(['a.x', 'b.x', 'c.x'])}/{i}", "<body>" + "".join(rng.sample(blocks, 4)) + f"<p>w{rng.randrange(25)}</p>") for i in range(90)]
    rows += rows[:20]
    beside, mains = {}, {}
    for _, url, source in rows:
        page = ht.parse(source)
        mains.setdefault(ht.host(url), set()).add(page.main())
        for h, passage in page.hashes().items():
            beside.setdefault((ht.host(url), h, passage), set()).add(page.main())
    want = {(a, h) for (a, h, passage), texts in beside.items() if len(texts) >= 4 and len(texts) >= min(0.5 * len(mains[a]), 10 if passage else 4)}
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = ht.site_templates(ht.subtree_hashes(df, "url", "html"), 4, 0.5, 10).collect()
    assert {(r["host"], r.h) for r in got} == want and len(got) == len(want) > 5
    out = {r.page_id: r for r in ht.main_text(df).collect()}
    assert sum(r.by_templates for r in out.values()) > 0 and all(r.by_tags == 0 for r in out.values())
