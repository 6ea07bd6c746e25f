import html
import re
from collections import defaultdict

import pytest

from driftline.llm import pages, queries

SCHEMA = "page_id long, url string, html string"


def text_of(page):
    return pages.read_page(page).without(())[0]


CASES = [
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>a<b>b</b>c<br>d&nbsp;\n e<p>f", "abc d e f"),
    ("<nav>x</nav><header>y</header><article><h1>T</h1><p>One<p><b>Two<p>Three</article><footer>z</footer>", "T One Two Three"),
    ("<body class='has-sidebar'><div class='page'><div id=sidebar>s</div><p>text</p></div>", "text"),
    ("<article><p>a</p><div class='ad'>buy</div><aside>note</aside><form>name <input></form><p>b</p></article><section class=comments><article>me too</article></section>", "a b"),
    ("<main><div class='cookie-notice'>ok?</div><h2>H</h2><ul><li>1<li>2</ul><table><tr><td>x<td>y</table></main><div>more</div>", "H 1 2 x y"),
    ("<article><header><h1>Title</h1><p>by someone</p></header><p>body</p><footer>f</footer></article>", "Title body"),
    ("<script>if (a < b) '<p>no</p>'</script><style>p{}</style><!-- <p>no --><title>no</title><p title='a > b'>yes", "yes"),
    ("<div class='layout sidebar'><article><p>still here</p></article></div>", "still here"),
    ("<p>1 < 2 and <3 &lt;b&gt; &am &#233; &eacute; &copy", "1 < 2 and <3 <b> &am é é ©"),
    ("<p>a <span class='share-bar'>tweet</span>b</p></b></div>c", "a b c"),
    ("<p>cut off &quo", "cut off &quo"),
    ("<noscript>on</noscript><textarea>t</textarea><p>q<!-- unclosed", "q"),
    ("<div role='navigation'>m</div><div role=main>m2</div>", "m2"),
    ("<p><b>bold<p>next</b> on</p>", "bold next on"),
    ('<div class="post search-result"><p>found</p></div>', "found"),
    ('<div class="social-history"><p>of a town</p></div>', "of a town"),
    ('<p class="notice-period">three months</p>', "three months"),
    ("<div class=notice><p>The notice itself is what this page is about, at length.</p></div><p>see it</p>", "The notice itself is what this page is about, at length. see it"),
    ("<div id=content><p>The story of the page stands here and is far longer than the teaser.</p></div><article>Read on</article>", "The story of the page stands here and is far longer than the teaser. Read on"),
    ("<div>" * 300 + "deep" + "</div>" * 300, "deep"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_structure(page, want):
    assert text_of(page) == want


def test_hostile_pages_take_linear_time():
    for page in ("<div>" * 30_000 + "x", "<b>" + "<div>" * 20_000 + "</b>" * 20_000, "<" * 100_000, "<a '" * 30_000 + ">", "<a '" * 30_000, "<!--" * 30_000, "<b>" * 20_000 + "</b>" * 20_000, "<p" * 50_000, "&" * 100_000, "<script>" * 20_000):
        pages.read_page(page)


def site():
    rows, n = [], 0
    for i in range(30):
        box = "<div class=x9><p>Join our list today</p><ul><li>one<li>two</ul></div>"
        own = f"<p>Story number {i} is told here at some length, as no other page of the site tells it.</p>"
        shared = "<p>A passage that some stories quote.</p>" if i % 5 == 0 else ""
        rows.append((n, f"https://User@Site.example:80/p{i}", f"<body>{box}<div id=d{i}>{own}{shared}</div><div>All rights kept</div>"))
        n += 1
    for i in range(40):  # copies of an article are no template
        rows.append((n, f"http://copies.example/{i}", "<div><p>The same article at many addresses.</p></div>"))
        n += 1
    for i in range(12):
        inner = f"<p>Text {i} of the article, longer than what surrounds it on its page.</p>" + ("<p>Quoted by half.</p>" if i % 2 else "")
        rows.append((n, f"http://art.example/{i}", f"<div>menu words</div><article>{inner}<div>Follow us</div></article>"))
        n += 1
    return rows


def slow_texts(rows, min_contents=4, min_share=0.3, min_share_article=0.6, many=1000):
    parsed = [(re.sub(r"^\w+://(?:[^/]*@)?([^/:]+).*", r"\1", u).lower(), pages.read_page(h)) for _, u, h in rows]
    contents, seen = defaultdict(set), defaultdict(set)
    for host, page in parsed:
        if page.nodes:
            contents[host].add(page.content)
        for key, kind, *_ in page.nodes:
            seen[host, key, kind].add(page.content)
    out = []
    for host, page in parsed:
        gone = set()
        for i in range(len(page.texts)):
            for key, kind, start, stop in page.nodes:
                n, strict = len(seen[host, key, kind]), kind in (pages.EXACT_IN_ARTICLE, pages.BLIND_LINKS)
                share = (min_share_article if strict else min_share) * len(contents[host])
                if start <= i < stop and n >= min_contents and (n >= share or not strict and n >= many):
                    gone.add(i)
        out.append((" ".join(t for i, (t, x) in enumerate(zip(page.texts, page.taken)) if x and i not in gone), len(gone)))
    return out


def test_templates_go_and_articles_stay(spark):
    rows = site()
    frame = spark.createDataFrame(rows, SCHEMA)
    found = {r.page_id: (r.text, r.n_removed) for r in pages.main_text(frame).collect()}
    assert [found[k] for k, *_ in rows] == slow_texts(rows)
    assert {r.page_id: (r.text, r.n_removed) for r in pages.main_text(frame, broadcast_templates=0).collect()} == found
    got = {k: t for k, (t, _) in found.items()}
    assert got[1] == "Story number 1 is told here at some length, as no other page of the site tells it."
    assert got[0].endswith("A passage that some stories quote.") and got[35] == "The same article at many addresses."
    assert got[71] == "Text 1 of the article, longer than what surrounds it on its page. Quoted by half."


def test_recurrence_decides(spark):
    """Boxes whose words change, site texts longer than the articles, a section's sidebar."""
    legal = "<div><p>" + "All that is said here is said without any warranty of any kind. " * 6 + "</p></div>"
    link = lambda i, j: f"<li><a href=/{i}/{j}>word{i * 7 + j}</a></li>"
    rows = []
    for i in range(40):
        menu = "<div class=top><ul>" + "".join(link(i, j) for j in range(3 + i % 4)) + "</ul></div>"
        side = "<div class=col><p>Only this section has the box.</p></div>" if i % 8 == 0 else ""
        rows.append((i, "http://long.example/x", f"<body>{menu}<div class=body><p>Short story {i}.</p><p>It ends {i}.</p></div>{side}{legal}"))
    for i in range(40, 52):
        box = f"<div class=offer><b>Offer {i}</b> of today</div>"
        refs = "<ul>" + "".join(link(i, j) for j in range(4)) + "</ul>"
        rows.append((i, "http://art.example/y", f"{box}<article><p>Article {i} says this.</p>{refs}</article>"))
    got = {r.page_id: r for r in pages.main_text(spark.createDataFrame(rows, SCHEMA), many=5).collect()}
    assert [(got[k].text, got[k].n_removed) for k, *_ in rows] == slow_texts(rows, many=5)
    for i in range(40):
        assert got[i].text == f"Short story {i}. It ends {i}." and got[i].n_removed >= 4
    for i in range(40, 52):
        assert got[i].text == f"Article {i} says this. " + " ".join(f"word{i * 7 + j}" for j in range(4)) and got[i].n_removed == 1


def test_menus_and_boxes_of_the_table_go_by_recurrence(spark):
    found = pages.main_text(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"), keep=["page_id"])
    removed = [r.n_removed for r in found.select("n_removed").collect()]
    assert sum(n > 0 for n in removed) > 0.5 * len(removed)


def test_edge_cases(spark):
    rows = [(1, None, None, "a"), (1, None, None, "a"), (None, "x", "", "b"), (3, "http://h/", "<p>é</p>", "c"), (4, "", "<p>" + "w " * 300_000, "d")]
    frame = spark.createDataFrame(rows, SCHEMA + ", text string")
    got = pages.main_text(frame)
    assert got.columns == ["page_id", "url", "html", "host", "text", "n_removed"]
    assert sorted((r.page_id or 0, len(r.text)) for r in got.collect()) == [(0, 0), (1, 0), (1, 0), (3, 1), (4, 599_999)]
    assert pages.main_text(frame.limit(0)).count() == 0


def test_query_returns_the_marked_articles(spark):
    d = "/root/testdata/sf0.01"
    source = {r.page_id: r for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    rows = queries.op8_html_template(spark, d).collect()
    assert len(rows) == len(source)
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|$)", source[r.page_id].html, re.S)[1]
        blocks = re.sub(r"</?(?:p|h1|br)>", " ", inner)
        want = " ".join(html.unescape(re.sub(r"</?b>", "", blocks)).split())
        assert r.text == want and r.n_chars == len(want) and r.url == source[r.page_id].url
