"""Heads without an end tag and self-closed svg and math hide nothing behind them."""

import pytest

from meander.llm.htmltree import parse


def texts(html):
    page = parse(html)
    return [t for t in page.text if t]


@pytest.mark.parametrize("html, want", [
    ("<html><head><meta charset=utf-8><title>x</title><body><p>text", ["text"]),
    ("<head><title>x</title><style>a{}</style><p>text</p>", ["text"]),
    ("<!doctype html>\n<html>\n<head>\n<link rel=x>\n<script>1</script>\n text <b>bold</b>", ["text bold"]),
    ("<head><noscript><img src=x>gone</noscript><meta name=x><div>text</div>", ["text"]),
    ("<head><noscript>gone<body><p>text", ["text"]),
    ("<head><template><p>gone</p></template><p>text", ["text"]),
    ("<head><textarea>gone</textarea>text", ["text"]),
    ("<head><head><title>x</title></head><body>text", ["text"]),
    ("<html><head><title>x</title></head><body><p>one<head>two", ["onetwo"]),
    ("<title>x</title><head><meta name=x><p>text", ["text"]),
    ("<html><head><title>x</title></head><body><p>text</body></html>", ["text"]),
    ("<div><svg width='10' /><p>text</div>", ["text"]),
    ("<p>one <svg/> two <math/> three", ["one two three"]),
    ("<p>one <svg><title/><path d=x /><style/>gone</svg> two", ["one two"]),
    ("<p>one <svg width=10/>gone</svg> two", ["one two"]),
    ("<p>one <svg><title>gone</title></svg> two", ["one two"]),
])
def test_head_and_svg(html, want):
    assert texts(html) == want
