from __future__ import annotations

import html
import re

import duckdb
from vigilake.llm import html_extract

LONG = "This is the first part of the text, and it goes on for a while so that it is long enough to be one of the blocks that speak for themselves."


def text_of(page: str) -> str:
    return " ".join(t for t, _, keep in html_extract.judged(page, html_extract.Rules()) if keep)


def test_whole_table_against_article_elements(spark):
    """The table's pages hold their text in one article element without anything else in it."""
    root = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in html_extract.op13_html_extract(spark, root).collect()}
    rows = duckdb.connect().execute(f"SELECT page_id, url, html FROM '{root}/pages.parquet'").fetchall()
    assert len(got) == len(rows)
    for page_id, url, page in rows:
        inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.DOTALL)[1]
        inner = re.sub(r"<[^>]+>", "", re.sub(r"<br>|</?p>|</?h1>", " ", inner))
        want = " ".join(html.unescape(inner).split())
        assert (got[page_id].url, got[page_id].text, got[page_id].n_chars) == (url, want, len(want))


def test_regions_and_inheritance():
    page = f"""<html><head><title>t</title><style>p{{}}</style></head><body class="blog-header">
      <header><h1>The site of the day</h1><p>{LONG}</p></header><div id="cookie-notice">{LONG}</div><nav><ul><li><a href=/>in</a></ul></nav>
      <main><article><header><h2>Title &amp; &#8220;more&#x201D;</h2></header><p>{LONG}<br>Next&nbsp;<b>bo</b>ld<p>Short.</p><script>if (a<b) "</p>"</script>
      <ul><li>one<li>two <a href=x>li</a> words that are not linked</ul><!-- no --><aside>{LONG}</aside><form><p>{LONG}</p><input></form>
      <p><a href=y>only linked words that lead somewhere else</a></p><p hidden>{LONG}</p><div class="share-buttons">tell it</div>
      <section id="comments"><article class="comment"><p>{LONG}</p></article></section><p>End.</article></main><aside>{LONG}</aside><footer>&copy; {LONG}"""
    assert text_of(page) == f"Title & “more” {LONG} Next bold Short. one two li words that are not linked End."


def test_without_article_element_stop_words_decide():
    spam = "buy cheap | pills online | casino bonus | best price | free shipping | order today | great offers | win prizes | click more"
    page = f"<body><div>{spam}</div><div>Menu</div><h1>Heading</h1><p>{LONG}</p><p>So.</p><p>{LONG}</p><div>x</div><div>y</div><p><a href=/>{LONG}</a></p></body>"
    assert text_of(page).startswith(f"Heading {LONG} So. {LONG}") and spam not in text_of(page) and not text_of(page).endswith(LONG + " " + LONG)


def test_open_blocks_take_the_nearest_label():
    two = html_extract.second_pass
    assert two([None, True, None, None, False, None], [False] * 6) == [True, True, True, False, False, False]
    assert two([True, None, False], [True] * 3)[1] and not two([True, None, False], [False] * 3)[1]
    assert two([None, None], [True, False]) == [True, False]
    assert two([False, None, True], [False, True, True]) == [False, True, True]


def test_odd_pages(spark):
    """Null, empty, without tags, unclosed, very long and repeated pages, null ids and urls, a clashing extra column."""
    many = "<article>" + "".join(f"<p>Part {i}.</p>" for i in range(20_000)) + "<b>" * 5000
    pages = [(1, None, None), (2, "u", ""), (3, "u", "just words"), (4, "u", "<article><p>a < b &lt;c&gt; <3 <p attr='>'>d"), (5, "u", many), (None, "u", "<main>x"), (1, None, None), (6, "u", "<script>never closed"), (7, "u", "<article><p class=\"a>broken")]
    frame = spark.createDataFrame([(*p, 5) for p in pages], "page_id long, url string, html string, text long")
    got = sorted(((r.page_id or 0, r.url, r.text) for r in html_extract.extract(frame).collect()), key=str)
    whole = " ".join(f"Part {i}." for i in range(20_000))
    assert got == sorted([(1, None, ""), (2, "u", ""), (3, "u", ""), (4, "u", "a < b <c> <3 d"), (5, "u", whole), (0, "u", "x"), (1, None, ""), (6, "u", ""), (7, "u", "broken")], key=str)
    assert html_extract.labelled(frame).filter("page_id = 5 and main").count() == 20_000
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
