"""Blocks put into or behind the article leave the main text as it is."""

import re
import time

import duckdb
import pytest

from meander.llm import htmlmodel
from meander.llm.htmltree import parse

WORDS = "<p>I liked this text very much, thank you for writing it down, it was good.</p>"
BLOCKS = {
    "section.comments": f"<section class=comments>{WORDS}</section>",
    "article.comment": f"<article class=comment>{WORDS}</article>",
    "ul.comments": "<ul class=comments><li>First reader was here, and liked it.</li><li>Second one too.</li></ul>",
    "div#comments": f"<div id=comments><div class=comment>{WORDS}</div></div>",
    "div.comment-thread": f"<div class='comment-thread'>{WORDS}{WORDS}</div>",
    "div.ad": f"<div class=ad>{WORDS}</div>",
    "aside": f"<aside>{WORDS}</aside>",
    "footer": f"<footer>{WORDS}</footer>",
    "form": f"<form>{WORDS}</form>",
    "notice": f"<div class=cookie-notice>{WORDS}</div>",
    "related": f"<div class=related>{WORDS}</div>",
    "nav": "<nav><ul><li><a>One</a><li><a>Two</a></ul></nav>",
}


@pytest.fixture(scope="module")
def learned():
    pages = [r[0] for r in duckdb.sql(
        "SELECT html FROM '/root/testdata/sf0.01/pages.parquet' WHERE html IS NOT NULL").fetchall()]
    model = htmlmodel.train(htmlmodel.taught(pages[:150]))
    return model, pages, [htmlmodel.main_text(model, p) for p in pages]


@pytest.mark.parametrize("kind", BLOCKS)
def test_blocks_stay_out(learned, kind):
    model, pages, texts = learned
    for form in (lambda m: BLOCKS[kind] + m[0], lambda m: m[0] + BLOCKS[kind]):
        changed = [re.sub(r"(?i)</article>", form, p, count=1) for p in pages]
        right = sum(htmlmodel.main_text(model, c) == t for c, t in zip(changed, texts, strict=True))
        assert right >= 0.96 * len(pages)


def test_stray_end_tags_cost_little():
    start = time.time()
    page = parse("<p>" + "<span>" * 20_000 + "</i>" * 20_000 + "words</p>")
    assert "words" in page.text and time.time() - start < 1.5


def test_fit_is_bounded_and_stable(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    odd = spark.createDataFrame([(None,), ("",), ("<article>" + "x " * 40_000,)], "html string")
    a = htmlmodel.fit(df.select("html").unionByName(odd), max_train=40)
    b = htmlmodel.fit(df.select("html").unionByName(odd).repartition(5), max_train=40)
    assert (a.weights == b.weights).all() and a.tables == b.tables
