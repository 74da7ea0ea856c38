"""Extraction from markup as it is found, and from pages written apart from the labelled ones."""

import time

import pytest

from loomwright.llm import html_extract


def blocks(source):
    return [t for _, t in sorted(x for n in html_extract.parse(source) for x in n.texts)]


@pytest.mark.parametrize(
    "source, want",
    [
        ("<p title=it's>one</p><p>two</p>", ["one", "two"]),
        ('<p data-x=5">one</p><p>two</p>', ["one", "two"]),
        ('<p title="a > b">one</p>', ["one"]),
        ('<p title="never closed>one</p><p>two', ["one", "two"]),
        ('<a href=/a?x="b>L</a><p>two', ["L", "two"]),
        ("<p = = = x>one<p>two", ["one", "two"]),
        ("<p x = 'a>b' y>one</p>", ["one"]),
        ("<svg><text>no</text></svg><p>one<svg><p>two", ["one", "two"]),
        ("<p>a <math><mi>x</mi><mo>=</mo></math> b</p>", ["a x= b"]),
        ("<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table>", ["one", "two", "a", "b", "c"]),
        ("<SCRIPT>if (a < b) </p></SCRIPT><p>one", ["one"]),
        ("<p>one</p><script>never closed <p>two", ["one"]),
    ],
)
def test_markup(source, want):
    assert blocks(source) == want


def test_hostile_pages_take_linear_time():
    def seconds(n):
        page = "<div>" * n + "x" + "</ul></p>" * n + "</div>" * n + "<svg>" * n + "<p = " * n + '<i x="' * n
        began = time.perf_counter()
        html_extract.main_text(page, html_extract.trained())
        return time.perf_counter() - began

    seconds(100)
    assert seconds(20_000) < 60 * max(seconds(2_000), 0.01)


ARTICLE = "<h1>Rain over the harbour</h1><p>Ferries ran late on Monday after a night of heavy rain, the harbour office said.</p>"


@pytest.mark.parametrize("depth", range(8))
@pytest.mark.parametrize("wrapper", ["<div>", '<div class="x">', '<div class="row">', '<section id="q1">'])
def test_short_article_in_wrappers(depth, wrapper):
    page = f"<html><body>{wrapper * depth}{ARTICLE}{('</' + wrapper[1:].split()[0].rstrip('>') + '>') * depth}</body></html>"
    assert html_extract.main_text(page, html_extract.trained()).startswith("Rain over the harbour\n\nFerries ran late")


PAGES = [
    (
        """<!doctype html><html><head><title>Harbour news</title></head><body class="home"><div id="top"><div class="logo"><a href="/">The Harbour Paper</a></div>
        <ul class="main-menu"><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li></ul></div><div class="page"><div class="post"><h1>Rain over the harbour</h1>
        <p>Ferries ran late on Monday after a night of heavy rain, the harbour office said in a short note to travellers.</p><h2>Two boats held</h2>
        <p>Two boats were held at the pier until noon. Nobody was hurt.</p><ul><li>Line 4 runs every hour.</li><li>Line 7 does not run today.</li></ul></div>
        <div class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Old bridge closes</a></li><li><a href="/2">Fish prices up</a></li></ul></div></div>
        <div class="comment-list"><div class="comment"><p>I waited two hours for the ferry, what a day!</p></div></div>
        <div class="footer">Copyright The Harbour Paper. All rights reserved.</div></body></html>""",
        ["Rain over the harbour", "Ferries ran late on Monday after a night of heavy rain, the harbour office said in a short note to travellers.", "Two boats held", "Two boats were held at the pier until noon. Nobody was hurt.", "Line 4 runs every hour.", "Line 7 does not run today."],
    ),
    (
        """<body><div class="cookie-banner">We use cookies. <button>OK</button></div><header><nav><a href="/">Home</a> <a href="/about">About</a></nav></header>
        <main><article><h1>How to sharpen a chisel</h1><p>Start with the flat side on a coarse stone, and keep it flat.</p><aside class="ad">Buy new chisels now!</aside>
        <p>Then turn it over and raise the handle until the bevel lies on the stone.</p><blockquote><p>A dull tool is the dangerous one.</p></blockquote></article>
        <section class="related"><h3>Related</h3><a href="/a">How to plane a board</a></section><form action="/s"><label>Sign up</label><input name=e></form></main><footer><p>Imprint</p></footer></body>""",
        ["How to sharpen a chisel", "Start with the flat side on a coarse stone, and keep it flat.", "Then turn it over and raise the handle until the bevel lies on the stone.", "A dull tool is the dangerous one."],
    ),
    (
        """<table><tr><td><div><div><h2>Notes on tides</h2><p>The tide turns about every six hours and a quarter, as the moon goes round.</p>
        <p>Spring tides come with the new and the full moon; neap tides with the quarters between them.</p></div></div></td></tr></table>""",
        ["Notes on tides", "The tide turns about every six hours and a quarter, as the moon goes round.", "Spring tides come with the new and the full moon; neap tides with the quarters between them."],
    ),
]


@pytest.mark.parametrize("source, want", PAGES)
def test_pages_written_apart(source, want):
    assert html_extract.main_text(source, html_extract.trained()).split("\n\n") == want
