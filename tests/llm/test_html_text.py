"""Main text of hand-made and of the tables' pages."""

import html
import re

import pytest

from corpusspark.llm import html_text as op

TREE = op.train(op.labelled())
LONG = "word " * 40
PAGE = f"""<!doctype html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies. {LONG}</div>
<main><article><header><h1>The &lt;Head&gt;&nbsp;line</h1></header><p>One.<p>{LONG} &amp; <b>b</b>old<br>next</p><div class="ad">Buy {LONG}</div><p>A <a href="#">link</a> here.</p>
<form><p>Your mail {LONG}</p></form></article><section id="comments"><article class="comment"><p>First! {LONG}</p></article></section></main><aside>{LONG}</aside><footer>&copy; me</footer></body></html>"""


def test_article_alone():
    assert op.main_text(PAGE, TREE) == " ".join(f"The <Head> line One. {LONG} & bold next A link here.".split())


def test_page_without_article():
    page = f"<body><div id=nav><a href=1>a</a> <a href=2>b</a></div><div id=content><h2>Title here</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div class=sidebar>{LONG}</div>"
    assert op.main_text(page, TREE) == " ".join(f"Title here {LONG} Short. {LONG}".split())


#: Pages that the tree was not trained on; blocks with ``keep`` belong to the article.
HELD_OUT = [
    """<html><body><div class="topbar"><a>[1-]</a><a>[2-]</a></div><nav class="main-menu"><ul><li><a>[1-]</a><li><a>[3-]</a></ul></nav><div class="layout"><article class="post"><h1 keep>[9-]</h1><p keep>[33]</p><p keep>[71]</p>
    <figure><img><figcaption keep>[9]</figcaption></figure><p keep>[140]</p><blockquote><p keep>[26]</p></blockquote><p keep>[2]</p><div class="social-buttons"><a>[1-]</a><a>[1-]</a></div><aside class="sidebar"><p>[44]</p></aside><p keep>[52]</p></article>
    <aside><h3>[2-]</h3><ul><li><a>[6-]</a><li><a>[7-]</a></ul></aside></div><section class="comments"><p>[31]</p><p>[12]</p></section><footer><p>[14]</p></footer></body></html>""",
    """<body><div id="masthead"><h2>[3-]</h2></div><div id="nav"><a>[1-]</a> <a>[1-]</a> <a>[1-]</a></div><div id="story"><h1 keep>[5-]</h1><p keep>[47]</p><p keep>[63]</p><p keep>[8]</p><p keep>[39]</p><p keep>[77]</p></div><div id="sponsored-links"><p>[20]</p></div><div id="sidebar"><p>[25]</p></div><div id="footer">[9]</div></body>""",
    """<body><div><a>[2-]</a> | <a>[2-]</a> | <a>[1-]</a> | <a>[2-]</a></div><div><h1 keep>[6-]</h1><div keep>[88]</div><div keep>[5]</div><div keep>[64]</div><div keep>[31] <a>[2-]</a></div></div><div><a>[3-]</a></div><div><a>[4-]</a></div><div>[3-]</div></body>""",
    """<main role="main"><h1 keep>[4-]</h1><div class="info-notice"><p keep>[13]</p></div><h2 keep>[1-]</h2><p keep>[6]</p><pre keep>[30-]</pre><h2 keep>[2-]</h2><table><tr><td keep>[1-]</td><td keep>[5-]</td></tr></table><p keep>[18]</p><div class="search-results"><p keep>[9]</p></div></main><div class="feedback"><p>[7]</p></div>""",
    """<body><center><a>[1-]</a> <a>[1-]</a></center><p keep>[120]</p><p keep>[95]</p><p keep>[4]</p><p keep>[60]</p><center>[4-]</center></body>""",
    """<body><header class="site-header"><p>[8]</p><form><label>[1-]</label></form></header><article><h1 keep>[7-]</h1><p keep>[22]</p><ol><li keep>[15]<li keep>[4-]<li keep>[21]</ol><p keep>[11]</p><p class="advertisement">[6]</p><p keep>[35]</p><footer><p>[10-]</p></footer></article><div class="newsletter"><p>[16]</p></div></body>""",
]


def test_held_out_blocks():
    table = op.labelled(HELD_OUT)
    right = sum(op.classify(TREE, row[:-1]) == row[-1] for row in table)
    print("held-out accuracy", right, "of", len(table))
    assert right >= 0.95 * len(table)


#: Pages without article or main whose short blocks are text; blocks with ``keep`` belong to it.
UNMARKED = [
    """<body><div><a>[1-]</a> <a>[1-]</a></div><h1 keep>[4-]</h1><p keep>[44]</p><ul><li keep>[2-]<li keep>[5-]<li keep>[3-]<li keep>[4-]</ul><p keep>[52]</p><div><a>[2-]</a></div></body>""",
    """<body><p><a>[1-]</a></p><p keep>[80]</p><p keep>[3]</p><p keep>[5]</p><p keep>[2]</p><p keep>[4]</p><p keep>[66]</p><p><a>[3-]</a></p></body>""",
    """<body><div><a>[2-]</a></div><p keep>[50]</p><table><tr><td keep>[1-]<td keep>[1-]<td keep>[2-]<tr><td keep>[1-]<td keep>[2-]<td keep>[1-]</table><p keep>[39]</p><div><a>[2-]</a></div></body>""",
    """<p keep>[40]</p><ul><li keep>[2-]<li keep>[5-]<li keep>[3-]<li keep>[4-]</ul><p keep>[52]</p>""", """<p keep>[40]</p><p keep>[2-]</p><p keep>[2-]</p><p keep>[2-]</p><p keep>[30]</p>""",
    """<h1 keep>[1-]</h1><p keep>[2]</p>""", """<body><p keep>[5-]</p><p keep>[6-]</p><p keep>[5-]</p><p keep>[7]</p></body>""", """<div keep>[5-]<br>[6-]<br>[5-]<br>[7]</div>""",
]


@pytest.mark.parametrize("page", UNMARKED)
def test_unmarked_pages_come_out_whole(page):
    """Against a loop that knows the labels: what isn't a link stays."""
    found = op.blocks(op.written_out(page))
    want = [b["text"] for b in found if b["links"] < 1]
    assert op.main_text(op.written_out(page), TREE) == " ".join(want)
    assert all(b["keep"] for b in found if b["links"] < 1) or "<br>" in page


def _used(tree):
    return {tree[0]} | _used(tree[2]) | _used(tree[3]) if isinstance(tree, tuple) else set()


def test_words_and_neighbours_decide():
    assert {"words", "links", "links_before", "words_after"} & {op.FEATURES[k] for k in _used(TREE)} >= {"links", "words_after"}
    without = [(*[0 if op.FEATURES[k].startswith(("words_", "links_", "long_")) else x for k, x in enumerate(row[:-1])], row[-1]) for row in op.labelled()]
    blind = op.train(without)
    assert sum(op.classify(blind, row[:-1]) != row[-1] for row in without) > 3  # neighbours are needed


@pytest.mark.parametrize("part", [
    "<p>Let <math><mi>x</mi> <mo>=</mo> <mn>2</mn></math> be a number.</p>", '<p class="legal">The court held that it was void.</p>', '<div class="share-price"><p>The price fell to 12.</p></div>',
    '<section class="related-work"><p>Others have tried this before.</p></section>', '<div class="alert"><p>Mind the gap.</p></div>', '<div id="search"><p>We searched for years.</p></div>',
])
def test_article_parts_stay(part):
    text = " ".join(re.sub(r"<[^>]*>", "", part).split())
    page = f"<body><nav><a>Home</a></nav><article><h1>On this</h1><p>{LONG}.</p>{part}<p>{LONG}.</p></article></body>"
    assert op.main_text(page, TREE) == " ".join(f"On this {LONG}. {text} {LONG}.".replace(" .", ".").split()).replace("word.", "word .")


def test_deep_nesting_that_is_not_closed():
    import time

    began = time.time()
    page = "<article>" + "<div>" * 50_000 + "<p>deep down here.</p>" + "</section>" * 50_000 + "</span></li>" * 50_000
    assert op.main_text(page, TREE) == "deep down here." and time.time() - began < 10


@pytest.mark.parametrize("page", ["", "<", "<p", "<!-- open", "<script>open", "<article><p>a &am", "</div></p>", "<a href='x>y", "text alone"])
def test_broken_pages(page):
    assert isinstance(op.main_text(page, TREE), str)


def test_cut_off_page():
    assert op.main_text("<body><article><p>one two<p>three &am", TREE) == "one two three &am"


def test_tables_pages(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        m = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)
        assert op.main_text(r.html, TREE) == " ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", " ", m[1])).split())


def test_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "", "x"), (3, "u", "<article>" + "<p>word</p>" * 20_000, "x")]
    got = op.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [r.page_id for r in got] == [1, 1, 2, None, 3]
    assert got[0] == got[1] and got[2].text == got[3].text == ""
    assert len(got[4].text.split()) == 20_000
    assert op.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
