"""Main text of pages: what stays, what goes, and odd markup."""

from __future__ import annotations

import pytest

from thalweg.llm import html_text

FIRST = "The first paragraph of the article says a good deal about rivers &amp; the land they drain."
SECOND = "The second one goes on for a while, and mentions <a href='/x'>a link</a> on the way to its end."
PAGE = f"""<!DOCTYPE html><html><head><title>Not this</title><style>p{{x:y}}</style><script>var a = "</p><p>no</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href="/b">Menu</a></li></ul></nav><!-- <p>hidden remark</p> -->
<div class="ad">Buy one of these fine things today, while there are still some of them left to buy.</div>
<div class="cookie-notice">We keep cookies here, a great many of them, as you may have come to expect by now.</div>
<article><h1>Title</h1><p>{FIRST}</p><p>{SECOND}</p><ul><li>one&nbsp;item</li><li>&#233;&#x4e2d;</li></ul></article>
<section id="comments"><p>A reader says that none of this is right, and goes on about it for a long while.</p></section>
<aside><p>Something else that you may like to read, with a long description so that it seems text.</p></aside>
<footer>&copy; all of us</footer></body></html>"""
WANTED = [
    "Title",
    "The first paragraph of the article says a good deal about rivers & the land they drain.",
    "The second one goes on for a while, and mentions a link on the way to its end.",
    "one item",
    "é中",
]


def test_article_stays_and_the_rest_goes():
    assert html_text.main_text(PAGE).split("\n\n") == WANTED


def test_without_an_article_element_the_text_surges():
    page = PAGE.replace("<article>", "<div>").replace("</article>", "</div>")
    found = html_text.main_text(page).split("\n\n")
    assert found[:3] == WANTED[:3] and not any("reader" in x or "Home" in x or "Buy" in x or "else" in x for x in found)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<nav><a href='/'>Home</a></nav>", ""),
        ("<p>a < b and  c\n\td</p>", "a < b and c d"),
        ("<p>left open<p>and again", "left open\n\nand again"),
        ("<article><p>one<br>two</p></article>", "one two"),
        ("<article>" + "<p>same</p>" * 3 + "</article>", "same\n\nsame\n\nsame"),
        ("<script>only</script>", ""),
    ],
)
def test_odd_pages(page, text):
    assert html_text.main_text(page) == text


def test_long_pages_are_whole():
    page = "<article>" + "".join(f"<p>paragraph {k} of a long page</p>" for k in range(20_000)) + "</article>"
    assert html_text.main_text(page).count("\n\n") == 19_999


def test_windows_keep_the_densest_stretch():
    line, gap = html_text.Line, [html_text.GAP_LINE] * 3
    lines = [line("menu")] * 2 + gap + [line("text " * 30, 150)] * 3 + gap + [line("a short remark", 14)] + gap + [line("links and links")]
    assert html_text.main_lines(lines) == ["text " * 30] * 3 + ["a short remark"]


LONG = "The river runs over stones and down the long hill, past the old mill and on. " * 3


def wrapped(body: str, article: bool) -> str:
    return f"<html><body><nav><a href='/'>Home</a> <a href='/b'>More</a></nav>{'<article>' if article else '<div>'}{body}{'</article>' if article else '</div>'}<footer>of the site</footer></body></html>"


@pytest.mark.parametrize("article", [True, False])
@pytest.mark.parametrize(
    ("body", "kept"),
    [
        (f"<div class='content with-sidebar'><h1>T</h1><p>{LONG}</p></div>", ["T", LONG]),
        (f"<div class='post has-comments sidebar'><h1>T</h1><p>{LONG}</p></div>", ["T", LONG]),
        (f"<h1>T</h1><p>{LONG}</p><table class='share-prices'><tr><td>one</td><td>12.5</td></tr></table>", ["T", LONG, "one", "12.5"]),
        (f"<div><h1>T</h1><p>{LONG}</p></div><section><p>A short closing remark.</p></section>", ["T", LONG, "A short closing remark."]),
        (f"<section><h1>Headline</h1></section><div><p>{LONG}</p></div>", ["Headline", LONG]),
        (f"<h1>T</h1><p>{LONG}</p><div class='cookieNotice'><p>We keep cookies.</p></div><form><p>Your name</p></form>", ["T", LONG]),
        (f"<h1>T</h1><p>{LONG}</p><section class='comments-area'><p>A reader: {LONG[:70]}</p></section>", ["T", LONG]),
        (f"<h1>T</h1><p>{LONG}</p><div hidden><p>not seen</p></div><ul class='share-links'><li><a href='/x'>Send</a></li></ul>", ["T", LONG]),
    ],
)
def test_shapes_of_articles(body, kept, article):
    assert html_text.main_text(wrapped(body, article)).split("\n\n") == [k.strip() for k in kept]


def test_headings_of_an_articles_header_stay():
    page = f"<header><h1>The site</h1></header><article class='post'><header><h1>Title</h1><p>By someone</p></header><p>{LONG}</p></article>"
    assert html_text.main_text(page).split("\n\n") == ["Title", LONG.strip()]


def test_adverts_and_notes_of_copyright_without_names():
    page = f"<div class='x1'>{'Buy one of these fine things while there are some left. ' * 2}</div><div class='x2'><h1>T</h1><p>{LONG}</p></div><div class='x3'>Copyright 2020 Someone and others. All rights reserved in all lands and seas of this world.</div>"
    assert html_text.main_text(page).split("\n\n") == ["T", LONG.strip()]


def test_the_drivers_pages_without_their_names(spark, sf_dir):
    """With neutral class names and no article element, the text is the same."""
    for (page,) in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect():
        if page:
            bare = page.replace('class="ad"', 'class="q7"').replace("<article>", "<div>").replace("</article>", "</div>")
            assert html_text.main_text(bare) == html_text.main_text(page)


def test_extract(spark):
    rows = [(1, "u", PAGE, 5), (2, None, None, 6), (2, None, None, 6), (None, "v", "<p>ok</p>", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    assert html_text.extract(pages).count() == 4
    assert found[1]["text"] == "\n\n".join(WANTED) and found[1]["n_chars"] == len(found[1]["text"]) and found[2]["text"] == "" and found[None]["text"] == "ok"
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("extra", "rest"),
    [
        ('<p class="advert">Buy now</p><p>A tail.</p>', ["A tail."]),
        ('<p class="advert">Buy now<p>A tail.', ["A tail."]),
        ('<p class="advert">Buy now<div>A tail.</div>', ["A tail."]),
        ('<p style="display:none">secret</p>', []),
        ('<ul><li>one<li class="comment">nice article thanks<li>two</ul>', ["one", "two"]),
        ('<ul><li class="comment"><ul><li>inner</li></ul> rest</li><li>two</li></ul>', ["two"]),
        ('<ol><li class="comment"><p>nice</p><p>thanks</p></li></ol><p>A tail.</p>', ["A tail."]),
        ('<table><tr><td class="ad">x<td>cell<tr hidden><td>y<tr><td>z</table>', ["cell", "z"]),
        ('<dl><dt class="sponsored">a<dd>b</dl>', ["b"]),
        ('<h2 class="share">Share it</h2><p>A tail.</p>', ["A tail."]),
        ('<section id="discussion"><h2>Discussion</h2><p>What it means.</p></section>', ["Discussion", "What it means."]),
        ('<div class="alert">Mind the step.</div><div class="search">Where to look.</div>', ["Mind the step.", "Where to look."]),
        ('<div class="search-form">Search here</div>', []),
    ],
)
@pytest.mark.parametrize("around", ["article", "div"])
def test_labels_hold_for_every_element(extra, rest, around):
    page = f"<html><body><{around}><h1>Title</h1><p>{FIRST}</p><p>{SECOND}</p>{extra}</{around}></body></html>"
    assert html_text.main_text(page).split("\n\n") == WANTED[:3] + rest
