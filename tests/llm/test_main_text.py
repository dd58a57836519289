"""HTML extraction on pages of many makes."""

import pytest

from geotrends.llm.main_text import extract_pages, main_text

LONG = "The river runs along the old town and the hills, and a letter arrived in the evening from the other side of it."
MORE = "Nobody had seen the boat since the spring, when the water stood high and the bridge was closed for several weeks."

PAGES = {
    "marked": (
        '<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var t="</p><article>x</article>";</script></head><body>'
        '<nav><ul><li><a href="/a">a</a></li></ul></nav><!-- ad <article> --><div class="ad">Buy <b>now</b>.</div>'
        "<article><h1>Title &amp; more&amp</h1><p><b>One\n two&nbsp; three.<br><p>Be.</p><p>a&lt;b &am &#233;<p>last</article>"
        "<footer>&copy; x</footer></body></html>",
        ["Title & more&", "One two three.", "Be.", "a<b &am é", "last"],
    ),
    "never closed": (f"<body><nav>menu</nav><article><p>One<p>{LONG}", ["One", LONG]),
    "empty article": ('<body><div class="ad">Buy now. Buy now.</div><article><h1></h1><p> </p></article><footer>x</footer>', []),
    "comments": (
        f'<main><header><h1>Head</h1></header><article><header><h2>Sub</h2></header><p>{LONG}</p><div class="share-bar">Share</div>'
        f'<p>Short.</p><section id="comments"><h3>Comments</h3><p>{MORE}</p></section><article><p>{MORE}</p></article></article>'
        f'<article class="teaser">{MORE}</article><aside><p>{MORE}</p></aside></main>',
        ["Sub", LONG, "Short."],
    ),
    "main": (
        f'<header><h1>Site</h1></header><main><div><p>One.</p><div class="cookie-notice"><div>{MORE}</div></div><p>{LONG}</p></div>'
        f"<form><label>Name</label>{MORE}</form></main><footer><p>{MORE}</p></footer>",
        ["One.", LONG],
    ),
    "by names": (
        f'<div class="siteHeader">Site</div><div id="topMenu"><p>{MORE}</p></div><div class="content no-sidebar"><h1>Head</h1><div>{LONG}</div>'
        f'<div>{MORE}</div><div class="AdBox">{MORE}</div><div>{LONG}</div></div><div class="sidebar">{MORE}</div>'
        f'<div role="contentinfo">{MORE}</div><div hidden>{MORE}</div>',
        ["Head", LONG, MORE, LONG],
    ),
    "unmarked": (
        "<ul>" + "".join(f'<li><a href="/{i}">A long entry of the menu of this site {i}</a></li>' for i in range(8)) + "</ul>"
        f"<h2>Head</h2><p>{LONG}</p><p>Short one here.</p><p>{MORE} <a href=x>linked</a></p><p>{LONG}</p>"
        + "".join(f'<div><a href="/{i}">Another link of the site {i}</a></div>' for i in range(8)) + "<div>Imprint</div>",
        ["Head", LONG, "Short one here.", MORE + " linked", LONG],
    ),
    "plain": (LONG, [LONG]),
    "word": ("Be.", ["Be."]),
    "cells": (f"<article><table><tr><td>a</td><td>b</td></tr><tr><td>c<td>d</table><ul><li>x<li>y</ul><p>{LONG}</article>", ["a b", "c d", "x", "y", LONG]),
    "inline": ('<article><p>w<i>or</i>d <span class="ad">Buy</span>next <a title="a>b" href=\'it"s\'>li<b>n</b>k</a></p></article>', ["word next link"]),
    "broken tags": (f'<article><p>a < b <3 <a title="open>x</a></p><p>{LONG}</p><!-- never closed <p>x', ["a < b <3 x", LONG]),
    "names mislead": (f'<div class="page-with-sidebar"><p>{LONG}</p><p>{MORE}</p><p>{LONG}</p></div>', [LONG, MORE, LONG]),
    "only a notice": (f'<div class="cookie-notice"><p>{LONG}</p></div>', []),
    "script never closed": (f"<article><p>{LONG}</p><script>x = 1; <p>{MORE}</p>", [LONG]),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    html, expected = PAGES[name]
    assert main_text(html).split("\n") == (expected or [""])


def test_very_long_and_deep_pages():
    assert main_text("<article>" + "<p>word word</p>" * 50_000 + "</article>").count("\n") == 49_999
    assert main_text("<div>" * 20_000 + LONG + "</div>" * 20_000) == LONG
    assert main_text("<span class=x>" * 20_000 + LONG + "</i>" * 20_000) == LONG
    assert main_text('<a title="' * 3000 + LONG) is not None


def test_extract_pages(spark):
    html = PAGES["marked"][0]
    rows = [(1, "u", html, "x", 1), (1, "u", html, "x", 1), (2, None, None, "x", 2), (None, "n", "", "x", 3), (3, "l", "<p>" + "é" * 200_000, "y", 4)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int").repartition(3)
    text = "\n".join(PAGES["marked"][1])
    expected = [(1, "u", text, len(text))] * 2 + [(2, None, "", 0), (None, "n", "", 0), (3, "l", "é" * 200_000, 200_000)]
    assert sorted(map(str, map(tuple, extract_pages(frame).collect()))) == sorted(map(str, expected))
    assert extract_pages(frame.limit(0)).count() == 0
