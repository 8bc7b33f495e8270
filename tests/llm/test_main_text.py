"""Operator 11: planted pages of many layouts, the given pages, broken markup, hostile input, odd rows."""

import html
import re
import time

import pytest

from haulframe.llm import main_text, page_blocks
from tests.conftest import MEDIUM

S1 = "The harbour opened in spring, and the first ships, loaded with grain, came in before noon."
S2 = "Two weeks later, the council met; it asked for a second crane, a wider road, and more time."
S3 = "Nobody knew, at first, how the freight would reach the valley, but carts were found, and horses."
MENU = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "News", "Sport", "Weather", "Contact", "About us"))
LONG_COMMENT = "I read this twice, and I still think the crane is too small, but the road, yes, the road was needed."

LAYOUTS = {
    "article": (f"<nav><ul>{MENU}</ul></nav><article><h1>Port</h1><p>{S1}</p><p>Of.</p><p>{S2}</p></article><footer>&copy; us, all rights reserved.</footer>",
                ["Port", S1, "Of.", S2]),
    "article header and comments": (
        f"<header><h1>The Daily</h1></header><article class='post hentry'><header><h1>Port</h1><nav>x</nav></header><p>{S1}</p>"
        f"<ul><li>grain</li><li>salt</li></ul><div class='share'><a href='/s'>Share</a></div><p>{S2}</p></article>"
        f"<section id='comments'><article class='comment'><p>{LONG_COMMENT}</p></article></section>", ["Port", S1, "grain", "salt", S2]),
    "main": (f"<div class='site-header'>The Daily, since 1901.</div><main><h2>Port</h2><p>{S1}<br>{S2}</p><aside>{S3}</aside></main>", ["Port", f"{S1} {S2}"]),
    "divs": (f"<div id='top-menu'><ul>{MENU}</ul></div><div id='content'><h1>Port</h1><div class='body'><p>{S1}</p><p>{S2}</p><p>Yes.</p>"
             f"<ul><li>grain</li><li>salt</li></ul><p>{S3}</p></div></div><div class='sidebar'><p>{S3}</p></div><div class='footer'>{S2}</div>",
             ["Port", S1, S2, "Yes.", "grain", "salt", S3]),
    "unnamed divs": (f"<div><ul>{MENU}</ul></div><div><div><p>{S1} {S2}</p><p>{S2} {S3}</p><p>{S3}</p></div></div><div>All rights reserved</div>",
                     [f"{S1} {S2}", f"{S2} {S3}", S3]),
    "table layout": (f"<table><tr><td><ul>{MENU}</ul></td><td><p>{S1} {S2}</p><p>{S3}</p></td></tr></table>", [f"{S1} {S2}", S3]),
    "cookie notice": (f"<div class='cookie-notice'><p>{S3}</p></div><article><p>{S1}</p><form><p>{S2}</p></form></article>", [S1]),
    "form around all": (f"<form id='aspnetForm'><article><p>{S1}</p></article></form>", [S1]),
    "wide class names": (f"<div class='layout has-sidebar'><div class='sidebar'>{S3}</div><article class='post tag-social'><p>{S1}</p></article></div>", [S1]),
    "open paragraphs": (f"<article><h1>A &amp; B</h1><p><b>{S1}<br><p>{S2}<p>{S3}</article><footer>x, y.", ["A & B", S1, S2, S3]),
    "advert inside": (f"<article><p>{S1}<span class='ad'>Buy now!</span></p><div class='advert'><p>{S2}</p></div><p hidden>{S3}</p></article>", [S1]),
    "article body by property": (f"<div><p>{S3}</p></div><div itemprop='articleBody'><p>{S1}</p>tail</div>", [S1, "tail"]),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    body, want = LAYOUTS[name]
    page = f"<!DOCTYPE html><html><head><title>Port - The Daily</title><style>p{{}}</style></head><body class='has-comments'>{body}</body></html>"
    assert [t for _, t in main_text.main_blocks(page)] == want


def article_of(source):
    """The given pages hold one article, of headings and paragraphs."""
    inside = re.search("<article>(.*?)</article>", source, re.S)[1]
    parts = (html.unescape(re.sub("<[^>]*>", " ", part)) for part in re.split("</?(?:p|h1)>", inside))
    return "\n".join(t for t in (" ".join(p.split()) for p in parts) if t)


def test_given_pages(spark):
    pages = spark.read.parquet(f"{MEDIUM}/pages.parquet")
    source = {r.page_id: (r.url, r.html) for r in pages.collect()}
    out = main_text.main_text(pages.repartition(3)).collect()
    assert len(out) == len(source)
    for r in out:
        url, page = source[r.page_id]
        assert (r.url, r.text) == (url, article_of(page)) and r.n_chars == len(r.text)
        assert any(p.endswith("/article/p") for p in r.content_paths)


def test_broken_markup():
    def texts(page):
        return ["".join(t for _, t in pieces) for _, pieces in page_blocks.read(page).blocks]

    assert texts("a<!-- <p>b --><p>c") == ["a", "c"]
    assert texts('<script>var t="</p>";</script>x') == ["x"]
    assert texts("1 < 2 and 3 <4 <p>x") == ["1 < 2 and 3 <4 ", "x"]
    assert texts("<p>a</b></div></p>b") == ["a", "b"]
    assert texts("<ul><li>a<ul><li>b</ul><li>c</ul>") == ["a", "b", "c"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>d") == ["a", "b", "c", "d"]
    assert texts("<a title='x > y'>l</a><p") == ["l"]
    assert texts('<a href="x>broken</a><p>y</p>') == ["broken", "y"]
    assert texts("&#65;&eacute;&nbsp;&copy &unknown; &#xD800;") == ["Aé\xa0© &unknown; �"]
    assert texts("") == [] and texts("<!---->") == [] and texts("<!-- never closed") == []


@pytest.mark.parametrize("page", [
    "<div>" * 200_000 + "x", "<a \"'>" * 200_000, "<p><b>" * 200_000, "</i>" * 300_000, "<" * 500_000, "<i>" * 100_000 + "</b>" * 100_000,
    "<!--" * 200_000, "<script>" * 100_000, "".join(f"<div class=c{i}>x</div>" for i in range(60_000)), "<article><p>" + "word, " * 500_000,
])
def test_hostile_pages_take_linear_time(page):
    began = time.time()
    main_text.main_blocks(page)
    assert time.time() - began < 20


def test_odd_rows(spark):
    rows = [(1, None, "u", "own"), (1, None, "u", "own"), (None, "", None, None), (2, f"<p>{S1}</p>" * 2000, "v", ""), (3, "<nav>x</nav>", "w", "z"),
            (4, "no markup at all, just text.", "", "t"), (2, f"<p>{S1}</p>" * 2000, "v", "")]
    df = spark.createDataFrame(rows, "page_id bigint, html string, url string, text string").repartition(2)
    out = sorted(main_text.main_text(df).select("page_id", "text", "n_chars").collect(), key=str)
    long = "\n".join([S1] * 2000)
    assert sorted(map(tuple, out), key=str) == sorted([(1, "", 0), (1, "", 0), (None, "", 0), (2, long, len(long)), (2, long, len(long)), (3, "", 0),
                                                       (4, "no markup at all, just text.", 28)], key=str)
    assert main_text.main_text(df.limit(0)).collect() == []
