"""Main text of pages whose names, quotes or end tags mislead."""

import time

import pytest

from fleetpulse.llm import html_tree
from tests.llm.test_page_elements import PAGE
from tests.llm.test_pages_vectors import PAGE as FULL


@pytest.mark.parametrize(
    "page",
    [
        '<body class="single has-sidebar"><div><p>one two.</p><p>three.</p></div>',
        '<html class="no-js with-menu"><body id=page><main><p>one two.</p><p>three.</p></main>',
        '<article class="post social-share-enabled"><p>one two.</p><p>three.</p></article>',
        '<main><div class="text search-enabled"><p>one two.</p><p>three.</p></div></main>',
        "<article><p>one two.</p><p title=\"x>three.</article>",
        "<article><p>one two.</p></section></nav><p>three.</p></article>",
    ],
)
def test_text_stays(page):
    assert html_tree.fit([PAGE]).text(page) == "one two.\n\nthree."


def test_an_article_that_is_a_comment_goes():
    page = '<main><p>one two.</p><article class="comment odd"><p>I like it.</p></article></main>'
    assert html_tree.parse(page)[4].hint == "away"
    assert html_tree.fit([PAGE, FULL]).text(page) == "one two."


def test_end_tags_without_a_start_take_linear_time():
    start = time.perf_counter()
    html_tree.parse("<div>" * 60_000 + "</section>" * 60_000 + "text")
    assert time.perf_counter() - start < 10


def test_list_items_end_within_their_list():
    page = "<article><ul><li>a<ul><li>b<li>c</ul><li>d<div>e<li>f</ul><p>g</article>"
    nodes = html_tree.parse(page)
    depth = {}
    for i, node in enumerate(nodes):
        depth[i] = depth.get(node.parent, -1) + 1
    leaves = {n.text: depth[i] for i, n in enumerate(nodes) if n.text}
    assert leaves["a"] == leaves["d"] == leaves["f"] == leaves["g"] + 1
    assert leaves["b"] == leaves["c"] == leaves["a"] + 2
