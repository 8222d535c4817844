import html
import random
import re
import time

from hypothesis import given
from hypothesis import strategies as st

from folio.llm import page_text


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


@given(st.lists(st.integers(0, 5), max_size=25), st.lists(st.integers(0, 5), max_size=25))
def test_common_lines_are_a_longest_common_subsequence(a, b):
    got = page_text.common_lines(a, b)
    assert got == sorted(set(got)) and len(got) == lcs(a, b)
    it = iter(b)
    assert all(a[i] in it for i in got)


def test_pages_of_many_equal_lines():
    rng = random.Random(4)
    page_text_lines = lambda n, k: [rng.randrange(k) for _ in range(n)]
    for n, k in ((300, 2), (400, 3), (250, 60)):
        a, b = page_text_lines(n, k), page_text_lines(n + 50, k)
        got = page_text.common_lines(a, b)
        it = iter(b)
        assert len(got) == lcs(a, b) and all(a[i] in it for i in got)
    began = time.process_time()
    a, b = [1, *[0] * 50_000, 2, *[0] * 50_000], [2, *[0] * 60_000, 1, *[0] * 40_000]
    assert len(page_text.common_lines(a, b)) == 100_000
    a, b = page_text_lines(20_000, 2), page_text_lines(20_000, 2)
    assert len(page_text.common_lines(a, b)) > 15_000
    assert time.process_time() - began < 60


def test_parse_leaves_out_what_isnt_text():
    page = page_text.parse("""<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="has-sidebar-x"><nav><ul><li>Menu</ul></nav>
    <!-- <article>no</article> --><div class="cookie-notice">We use cookies</div><article><h1>Head &amp; tail</h1><p>One<b>two</b> &eacute; <br>three<p>four <a href="x>y">link</a><aside>side</aside><form>f</form>
    <section id="comments"><p>nice!</p></section></article><footer>&copy; x</footer>""")
    assert page.marked and page.text == ["Head & tail", "Onetwo é", "three", "four link"]


def test_names_of_chrome_within_articles():
    page = page_text.parse("""<div class="ad-slot">out</div><article class="post search-result" id="related-1"><h2 id="related-work">Related work</h2><h2 id="social">Social</h2>
    <section id="search-and-rescue" data-id="menu"><p class="notice-board">text</p></section><div class="comments">c</div><p class="big ad">a</p><p id="comments">b<p>last</p></article>""")
    assert page.marked and page.text == ["Related work", "Social", "text", "last"]
    assert page_text.parse('<main class="has-sidebar">in</main>out').text == ["in"]
    assert page_text.parse('<h2 id="social">head</h2><div id="social-effects">x</div>').text == ["head", "x"]
    assert page_text.parse('<article hidden>x</article><article role="main" aria-hidden=true>y</article><p>z').text == ["z"]


def test_names_of_chrome_as_a_whole():
    for source in ('<div class="post has-comments">text', '<div id="page-with-sidebar">text', '<section class="news-related-to-you">text', "<article><p hidden-note>text", "<article><p title=hidden>text", '<p data-x="hidden">text', '<div class="content-area main">text', '<div class="sidebar"><div class="menu">text</div></div>', '<p style="display:inline">text'):
        assert page_text.parse(source).text == ["text"], source
    for name in ("cookie-notice", "ad-slot", "adSlot", "site-footer", "x sidebar_left", "main-nav", "comments", "AD", "related2", "share-bar top"):
        assert page_text.parse(f'<p>main text of the page</p><div class="{name}">chrome</div>').text == ["main text of the page"], name
        assert page_text.parse(f"<article>inside<p class='{name}'>chrome</p></article>").text == ["inside"], name
    assert page_text.parse("<article>a<div class=comments>longer than the article</div></article>").text == ["a"]
    for attrs in ("hidden", 'style="display:none"', "style='color:red; DISPLAY : none'", "aria-hidden=true", 'aria-hidden="true"', "hidden=hidden", "style=visibility:hidden"):
        assert page_text.parse(f"<p>a<p {attrs}>b<p>c").text == ["a", "c"], attrs


def test_broken_pages():
    for source, want in (("", []), ("plain", ["plain"]), ("<p>a<p>b", ["a", "b"]), ("<div>a</div><scrip", ["a"]), ("a<script>b", ["a"]), ("1 < 2 & 3 > 2", ["1 < 2 & 3 > 2"]), ("<a href=\"q", []), ("</div></article>x", ["x"]), ("<p class=ad>x<p>y", ["y"]), ("&amp &#x41;&bogus; &am", ["& A&bogus; &am"])):
        page = page_text.parse(source)
        assert page.text == want, source
    page_text.parse("<div>" * 100_000 + "x")
    page_text.parse("<a b='" * 20_000)


def test_differencing_of_pages_without_an_article(spark):
    page = lambda text: f"<div>Site name</div><div>Home</div><p>{text}</p><div>All rights reserved</div>"
    rows = [(1, "http://h.org/a/1", page("first text")), (2, "http://h.org/a/2", page("second text")), (3, "http://h.org/b/9", page("third")), (4, "http://alone.org/x", page("fourth")), (5, None, page("fifth")), (6, "http://h.org/a/2", None), (7, "::bad", page("x")), (8, "http://h.org/c", f"<article>{page('kept')}</article>"), (9, "http://twin.org/1", page("t")), (10, "http://twin.org/1", page("t"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'q' AS host", "1 AS part")
    for parts in (None, 1, 5):
        got = {r.page_id: r.text for r in page_text.page_text(df, parts=parts).collect()}
        assert len(got) == 10 and got[6] == ""
        assert got[4] == "Site name Home fourth All rights reserved" == got[5].replace("fifth", "fourth")
        assert got[8] == "Site name Home kept All rights reserved" and got[9] == got[10] == "Site name Home t All rights reserved"
        assert got[1] == "first text" and got[3] == "third" and got[2] == "second text"
    assert page_text.page_text(df.where("false")).count() == 0


def test_ranges_of_a_host_give_the_same_text(spark):
    def page(k):
        return f"<div>Site</div><div>Part {k // 10}</div>" + (f"<p>text {k}" if k % 7 else "") + f"<div>Foot {k // 25}</div>"

    rows = [(k, f"http://h.org/{k // 10}/{k // 2}" if k < 60 else f"http://h.org/view?id={k}", page(k)) for k in range(120)]
    rows += [(None, "http://h.org/view?id=1", page(1)), (None, "http://h.org/3/16", page(2)), (70, "http://h.org/view", page(70)), (200, "http://i.org/a", page(3)), (201, None, page(4))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [sorted(map(str, page_text.page_text(df, parts=n).collect())) for n in (1, 2, 7, 60)]
    assert len(got[0]) == len(rows) and got[0] == got[1] == got[2] == got[3]


def test_partners_against_a_plain_walk(spark):
    """Every page's partner, copy rule and deleted lines by sorting all pages of a host on one list."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(40)]

    def page(k):
        own = [" ".join(rng.choices(words, k=4)) for _ in range(rng.randrange(4))]
        return "".join(f"<div>{x}</div>" for x in ["Site", f"Part {k % 3}", *own, *(["shared"] if k % 4 else []), "Foot"])

    rows = [(k, f"http://h{k % 3}.org/{'ab'[k % 2]}/{rng.randrange(30)}", page(k)) for k in range(90)]
    rows += [(200 + k, rows[k][1], rows[k][2]) for k in range(0, 40, 7)]
    want = {}
    for host in range(3):
        mine = sorted((url.split(".org")[1], i, page_text.parse(h).text) for i, url, h in rows if f"h{host}." in url)
        for at, (path, i, lines) in enumerate(mine):
            near = [mine[k] for k in (at - 1, at + 1) if 0 <= k < len(mine)]
            near.sort(key=lambda x: -next((n for n, (p, q) in enumerate(zip(path, x[0], strict=False)) if p != q), min(len(path), len(x[0]))))

            def shared_with(other, lines=lines):
                return set(page_text.common_lines([*map(hash, lines)], [*map(hash, other)]))

            gone, other = shared_with(near[0][2]), near[0][2]
            if len(near) > 1 and len(gone - shared_with(near[1][2])) > len(lines) - len(gone):
                gone, other = shared_with(near[1][2]), near[1][2]
            if len(gone) == len(lines) == len(other):
                gone = set()
            want[i] = " ".join(x for k, x in enumerate(lines) if k not in gone)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in page_text.page_text(df, parts=6).collect()}
    assert got == want and len({*want.values()}) > 40


def test_copies_are_told_by_the_other_neighbour():
    template, text, strange = list(range(10)), list(range(20, 40)), list(range(50, 60))
    kept = lambda own, *sides: page_text.difference(own, own, *sides)
    assert kept([*template, 91], [*template, 92], [*template, 93]) == [91]
    assert kept([*template, 91], [*template, 92]) == [91]
    assert kept([*template, *text, 91], [*template, *text, 92], template + strange) == [*text, 91]
    assert kept(template + text, template + text, template + strange) == text
    assert kept(template + text, template + strange, template + text) == text
    assert kept(template, template) == kept(template, template, template) == template
    assert kept(template, template + text) == [] and kept(template, None) == template


def test_whole_table_against_its_articles(spark):
    d = "/root/testdata/sf0.001"
    got = {r.page_id: r for r in page_text.op1(spark, d).collect()}
    pages = spark.read.parquet(f"{d}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)>", " ", article).replace("<b>", "").replace("</b>", "")).split())
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)
