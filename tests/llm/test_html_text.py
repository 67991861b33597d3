"""Main text of pages against what the pages were made of."""

import html
import re
import tracemalloc

import duckdb
import pytest

from revloom.llm import html_text

SCHEMA = "page_id bigint, url string, html string, text string, n_chars int"


def inner(source):
    """Text of the article element of the given pages, whose markup is simple."""
    body = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]+>", "\n", re.sub(r"</?b>", "", body))).split())


def test_pages(spark):
    rows = duckdb.sql("select page_id, html from '/root/testdata/sf0.01/pages.parquet'").fetchall()
    want = {i: inner(h) for i, h in rows}
    got = html_text.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_pages_without_an_article_element():
    """Paths alone find the same text."""
    for i, h in duckdb.sql("select page_id, html from '/root/testdata/sf0.01/pages.parquet'").fetchall():
        plain = h.replace("<article>", '<div class="entry">').replace("</article>", "</div>")
        assert html_text.main_text(plain) == inner(h), i


LONG = "A sentence of the article, with commas, and a full stop. " * 4


@pytest.mark.parametrize(
    "source,want",
    [
        (None, ""),
        ("", ""),
        ("plain words", "plain words"),
        ("<p>One&nbsp;two <i>th</i>ree.<p>Fo&#117;r &amp; &lt;b&gt;.", "One two three. Four & <b>."),
        ("<body><nav>Home</nav><main><h1>T</h1><p>x</p></main><footer>f</footer>", "T x"),
        ("<article><header><h1>Title</h1></header><p>Text.</p><form>Mail <input></form><div class='comments'><p>Nice!</p></div></article>", "Title Text."),
        (f"<div id=menu><a href=/>a</a></div><div class=post><h2>Head</h2><p>{LONG}</p><ul><li>one<li>two</ul></div><div class='sidebar-right'>{LONG}</div>", f"Head {LONG.strip()} one two"),
        ("<article>a<!-- <p>no</p> -->b<script>if (a<b) x('</p>')</script><style>p{}</style> c</article>", "ab c"),
        ("<article><p>1 < 2 and a<b</article>", "1 < 2 and a"),
        ("<article><p>cut", "cut"),
        ("<article><p title='a > b'>x</p><p hidden>no</p><p style='display: none'>no</p></article>", "x"),
        ("<div class=cookie-notice>We use cookies.</div>", ""),
    ],
)
def test_small_pages(source, want):
    assert html_text.main_text(source) == want


CARD = "<article class=card><h3>Other</h3><p>See it.</p></article>"
LINKS = "<ul><li><a href=/1>First page, of many.</a><li><a href=/2>Second page, of many.</a></ul>"


@pytest.mark.parametrize(
    "source,want",
    [
        # A card beside the text takes nothing from it.
        (f"<div class=story><h1>Head</h1><p>{LONG}</p><p>Short.</p></div>{CARD}", f"Head {LONG.strip()} Short."),
        # Lists of links are no content in an article either; links in sentences are.
        (f"<main><h1>Head</h1><p>{LONG}<a href=/>a link</a> on.</p>{LINKS}</main>", f"Head {LONG}a link on."),
        # The threshold decides within a container, too.
        (f"<div class=all><div class=text><p>{LONG}</p></div><div class=line>12 views</div><div class=text><p>{LONG}</p></div></div>", f"{LONG}{LONG.strip()}"),
        (f"<main><div class=text><p>{LONG}</p></div><div class=line>12 views</div></main>", LONG.strip()),
        # Headings with a container of their own, and cells, bridge.
        (f"<div><div class=top><h1>Head</h1></div><div class=text><p>{LONG}</p><table><tr><td>1<td>2</table></div></div>", f"Head {LONG}1 2"),
        (f"<table><tr><td>12 views<td><p>{LONG}</p><h2>More</h2><p>{LONG}</p></table>", f"{LONG}More {LONG.strip()}"),
    ],
)
def test_ratios_decide_on_every_page(source, want):
    assert html_text.main_text(source) == want


SIDE = "<div class=sidebar><p>Other words, not the article.</p></div>"
TEXT = LONG.strip()


@pytest.mark.parametrize(
    "source,want",
    [
        (f'<div class="layout has-sidebar"><article><h1>T</h1><p>{LONG}</p></article>{SIDE}</div>', f"T {TEXT}"),
        (f'<div class="col side-by-side"><article><p>{LONG}</p></article></div>', TEXT),
        ('<div id="page" class="no-comments"><article><p>Short.</p></article></div>', "Short."),
        (f'<div class="cookies-recipe"><h2>Dough</h2><p>{LONG}</p></div><footer>f</footer>', f"Dough {TEXT}"),
        (f'<div class="post tag-ads"><p>{LONG}</p></div><div class=ad>Buy it, now.</div>', TEXT),
        (f'<body><form id="aspnetForm"><nav><a href=/>Home</a></nav><div><p>{LONG}</p></div></form></body>', TEXT),
        # A sidebar that is never closed, and a name in a name.
        (f"<div class=sidebar><div class=side-by-side><div class=text><p>{LONG}</p></div><div class=ads>Buy.</div></div>", TEXT),
        # What does not hold most of the score goes, also where it is longer than the article.
        (f"<article><p>{LONG}</p></article><div id=comments><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>", TEXT),
        (f'<div class=has-sidebar><div class=text><p>{LONG}</p></div><div class="sidebar">{LONG}</div></div>', TEXT),
        # Short notices and lists of links are no article, whatever else there is.
        ("<div class=notice>Closed today.</div><nav><a href=/>" + LONG + "</a></nav>", ""),
        (f"<div hidden><p>{LONG}</p></div>", ""),
    ],
)
def test_names_lower_a_score_and_drop_no_article(source, want):
    assert html_text.main_text(source) == want


LINE = "<div class=%s>%s</div>"


@pytest.mark.parametrize("inner", ["12 views", "May 5", "<a href=/>Next</a>", "<a href=/>One</a> <a href=/>Two</a>", "Photo", "1 min"])
@pytest.mark.parametrize("where", ["before", "between", "after"])
def test_only_ratios_tell_the_article(inner, where):
    """Neither names nor tags say what is content: all is in divs."""
    text, line = f"<div class=b><p>{LONG}</p><p>{LONG}</p></div>", LINE % ("c", inner)
    parts = {"before": [line, text, text], "between": [text, line, text], "after": [text, text, line]}[where]
    assert html_text.main_text(f"<div class=a>{''.join(parts)}</div>") == (LONG * 4).strip()


def test_depth_costs_no_square():
    """Paths are numbers; what is nested 100,000 deep takes neither long nor much memory."""
    tracemalloc.start()
    assert html_text.main_text("<div>" * 100_000 + "deep") == "deep"
    assert html_text.main_text("<p>a" + "<span>w " * 16_000).split() == ["aw"] + ["w"] * 15_999
    assert html_text.main_text("<blockquote>a " * 50_000).split() == ["a"] * 50_000
    html_text.main_text("<div class=ad>a " * 30_000 + "</i>" * 30_000)
    assert tracemalloc.get_traced_memory()[1] < 300_000_000
    tracemalloc.stop()


def test_long_and_broken_pages():
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert html_text.main_text(deep) == "deep"
    assert html_text.main_text("<article>" + "<p>word</p>" * 20_000).count("word") == 20_000
    assert html_text.main_text("<" * 50_000 + "a") is not None
    assert html_text.main_text("<p a=\"" * 3000) is not None


def test_rows(spark):
    rows = [(1, "u", "<p>a</p>", "x", 1), (1, "u", "<p>a</p>", "x", 1), (None, None, None, "x", 1)]
    got = html_text.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    want = [(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert html_text.extract(spark.createDataFrame([], SCHEMA)).columns == ["page_id", "url", "text", "n_chars"]
    assert html_text.extract(spark.createDataFrame([], SCHEMA)).count() == 0
