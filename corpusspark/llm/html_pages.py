"""Small pages written by hand, whose blocks are the labelled table of ``html_text``.

``[n]`` stands for n words that end a sentence, ``[n-]`` for n words without a stop. A block whose element has the
attribute ``keep`` belongs to the article."""

from __future__ import annotations

import re

# Fixed training data.
PAGES = [
    # news article with all that usually stands around it
    """<body><header><a href=/>[2-]</a><p>[5-]</p></header><nav><ul><li><a>[1-]</a><li><a>[1-]</a><li><a>[2-]</a></ul></nav><article><h1 keep>[8-]</h1><p keep>[60]</p>
    <p keep>[1-]</p><h2 keep>[3-]</h2><p keep>[4]</p><p keep>[120] <a>[3-]</a></p><ul><li keep>[6-]<li keep>[1-]<li keep>[14]</ul><p keep>[300]</p><p keep>[9]</p></article>
    <aside><h3>[3-]</h3><p>[30]</p><p>[5]</p></aside><footer><p>[12]</p><p>&copy; [3-]</p><a>[1-]</a> <a>[2-]</a></footer></body>""",
    # an advert, a share bar, a form, a list of further stories and comments within the article
    """<body><nav><a>[1-]</a> <a>[1-]</a></nav><article><header><h1 keep>[7-]</h1><p keep>[4-]</p></header><p keep>[45]</p><div class="ad"><p>[20]</p></div><p keep>[70]</p><div class="share"><a>[1-]</a><a>[1-]</a></div>
    <div class="ad-box">[60]</div><p keep>[25]</p><form><p>[14]</p><label>[2-]</label></form><div class="newsletter-signup"><p>[18]</p></div><p keep>[90]</p><div class="related"><p>[3-]</p><ul><li><a>[6-]</a><li><a>[7-]</a><li><a>[5-]</a></ul></div>
    <section id="comments"><h2>[2-]</h2><div class="comment"><p>[50]</p></div><div class="comment"><p>[3]</p></div></section></article><footer>[20]</footer></body>""",
    # a list of links that follow each other in an article is a menu; a linked title or one linked line between texts is not
    """<main><h1 keep><a>[6-]</a></h1><p keep>[50]</p><p keep><a>[5-]</a></p><p keep>[80]</p><ul><li><a>[4-]</a><li><a>[5-]</a><li><a>[3-]</a><li><a>[6-]</a></ul><h2 keep><a>[3-]</a></h2><p keep>[12] <a>[9-]</a></p><p keep>[33]</p></main><footer>[9]</footer>""",
    """<article><h1 keep>[5-]</h1><p keep>[20] <a>[12-]</a></p><p keep><a>[8-]</a></p><p keep>[15]</p><p><a>[2-]</a> | <a>[1-]</a></p><p><a>[2-]</a></p><p><a>[1-]</a></p></article>""",
    # a manual: code, definitions, tables, warnings and terms within the main part
    """<body class="has-sidebar"><div class="sidebar"><ul><li><a>[2-]</a><li><a>[3-]</a></ul><p>[15]</p></div><main><h1 keep>[3-]</h1><pre keep>[9-]</pre><dl><dt keep>[1-]<dd keep>[12]<dt keep>[2-]<dd keep>[1-]</dl>
    <table><tr><th keep>[1-]<th keep>[2-]<tr><td keep>[1-]<td keep>[4-]</table><div class="alert alert-warning"><p keep>[16]</p></div><p class="legal" keep>[22]</p><div class="share-price"><p keep>[11]</p></div><p class="notice" keep>[8]</p>
    <section class="related-work"><h2 keep>[2-]</h2><p keep>[40]</p></section><div id="search"><p keep>[10]</p></div><figure><figcaption keep>[7]</figcaption></figure><blockquote keep>[19]</blockquote><p keep>[2-]</p></main></body>""",
    # beside the article of a page that marks it, texts are not part of it
    """<body><p>[6-]</p><div><p>[40]</p></div><div class="cookie-notice"><p>[35]</p></div><div role="main"><h2 keep>[4-]</h2><p keep>[30]</p><p keep>[1]</p></div><div><h3>[3-]</h3><p>[55]</p><p>[4-]</p></div><div class="legal">[30]</div></body>""",
    """<body><div><h4>[2-]</h4><p>[100]</p></div><article><p keep>[18]</p></article><div><p>[25]</p><p><a>[4-]</a></p></div><section id="comments"><article class="comment"><p>[80]</p></article></section></body>""",
    # a page of plain div elements with telling names
    """<body><div id="header"><h1>[3-]</h1><p>[6-]</p></div><div class="menu"><a>[1-]</a><br><a>[2-]</a></div><div id="content"><h2 keep>[6-]</h2><p keep>[70]</p><p keep>[4]</p><p keep>[90]</p><h3 keep>[2-]</h3><p keep>[35]</p><ul><li keep>[8]<li keep>[12]</ul><p keep>[50]</p></div>
    <div class="comments"><p>[45]</p><p>[7]</p></div><div class="sidebar"><h4>[2-]</h4><p>[28]</p></div><div id="footer"><p>[10]</p><p>[25]</p></div></body>""",
    # the same without names: words, links and neighbours decide
    """<body><div><a>[1-]</a></div><div><a>[2-]</a></div><div><a>[1-]</a></div><div><h1 keep>[7-]</h1><p keep>[65]</p><p keep>[6]</p><p keep>[85]</p><p keep>[22]</p><p keep>[1]</p><p keep>[48]</p></div><div><p>[3-]</p><p><a>[4-]</a></p><p><a>[5-]</a></p></div><div><p>[4-]</p></div></body>""",
    """<body><p><a>[1-]</a> | <a>[2-]</a> | <a>[1-]</a></p><h2 keep>[5-]</h2><p keep>[30]</p><p keep>[44] <a>[4-]</a></p><p keep>[3]</p><p keep>[27]</p><h3 keep>[3-]</h3><p keep>[60]</p><p><a>[3-]</a></p><p><a>[2-]</a></p><p>[2-]</p></body>""",
    """<body><div>[2-]</div><div>[3-]</div><div><a>[3-]</a> <a>[3-]</a> <a>[4-]</a></div><div keep>[150]</div><div keep>[8]</div><div keep>[110]</div><div>[3-] <a>[6-]</a></div><div>[4-]</div></body>""",
    """<body><div>[5]</div><div><a>[1-]</a> <a>[2-]</a></div><div><h1 keep>[4-]</h1><p keep>[32]</p><p keep>[7]</p><p keep>[46]</p></div><div><a>[2-]</a> <a>[2-]</a></div><div>[8]</div></body>""",
    """<body><p>[4]</p><p><a>[2-]</a></p><p><a>[1-]</a></p><p keep>[75]</p><p keep>[2]</p><p keep>[18]</p><p keep>[95]</p><p><a>[3-]</a></p><p>[7]</p><p><a>[2-]</a></p><p>[11]</p></body>""",
    """<body><div><a>[1-]</a></div><div>[9]</div><div><a>[4-]</a></div><h2 keep>[5-]</h2><div keep>[28]</div><div keep>[14]</div><div keep>[55]</div><div keep>[12]</div><div><a>[3-]</a> <a>[2-]</a></div><div>[5]</div></body>""",
    # linked lines before texts, in what is not the article
    """<body><nav><a>[7-]</a></nav><article><p keep>[60]</p><h2 keep>[2-]</h2><p keep>[25]</p></article><aside><h3><a>[3-]</a></h3><p>[20]</p><p><a>[6-]</a></p><p>[31]</p></aside><section class="comments"><h4><a>[2-]</a></h4><p><a>[8-]</a></p><p>[40]</p></section><div><h3><a>[4-]</a></h3><p><a>[7-]</a></p><p>[35]</p></div></body>""",
    """<body><div><a>[6-]</a></div><p keep>[80]</p><p keep>[40]</p><div class="sidebar"><h3><a>[4-]</a></h3><p><a>[5-]</a></p><p>[33]</p></div><div class="related"><p><a>[8-]</a></p><p>[22]</p></div></body>""",
    # an old page in a table
    """<table><tr><td><a>[1-]</a><br><a>[2-]</a><br><a>[1-]</a><br><a>[2-]</a></td><td><h1 keep>[4-]</h1><p keep>[38]</p><p keep>[52]</p><p keep>[10]</p><p keep>[41]</p></td><td><a>[6-]</a><br><a>[5-]</a></td></tr><tr><td>[5-]</td></tr></table>""",
    # a short page
    """<body><div><a>[1-]</a> <a>[1-]</a></div><h1 keep>[3-]</h1><p keep>[24]</p><p keep>[13]</p></body>""", """<body><p keep>[30]</p></body>""", """<p keep>[12]</p><p keep>[25]</p><p keep>[18]</p>""", """<body><p keep>[3-]</p></body>""",
    # lists, talk, tables and verse between long texts of pages without marks
    """<body><div><a>[1-]</a> <a>[2-]</a></div><h1 keep>[5-]</h1><p keep>[55]</p><ul><li keep>[3-]<li keep>[2-]<li keep>[6-]<li keep>[4-]<li keep>[1-]</ul><p keep>[48]</p><div><a>[3-]</a></div><div>[4-]</div></body>""",
    """<body><p><a>[2-]</a> <a>[1-]</a></p><p>[3-]</p><p keep>[62]</p><p keep>[4]</p><p keep>[3]</p><p keep>[6]</p><p keep>[2]</p><p keep>[1]</p><p keep>[5]</p><p keep>[70]</p><p><a>[2-]</a></p><p>[3-]</p></body>""",
    """<body><div><a>[3-]</a></div><h2 keep>[4-]</h2><p keep>[35]</p><table><tr><td keep>[1-]<td keep>[2-]<tr><td keep>[1-]<td keep>[3-]<tr><td keep>[2-]<td keep>[1-]</table><p keep>[41]</p><p><a>[4-]</a></p><p><a>[1-]</a></p></body>""",
    """<body><div><a>[1-]</a> | <a>[1-]</a></div><p keep>[28]</p><p keep>[6-]</p><p keep>[5-]</p><p keep>[7-]</p><p keep>[6]</p><h3 keep>[2-]</h3><dl><dt keep>[1-]<dd keep>[8]<dt keep>[1-]<dd keep>[5-]</dl><p keep>[33]</p><p>[2-] <a>[5-]</a></p></body>""",
    # verse and short pages with a menu, whole
    """<body><div><a>[1-]</a> <a>[1-]</a></div><h1 keep>[2-]</h1><p keep>[6-]</p><p keep>[7-]</p><p keep>[5-]</p><p keep>[6]</p><div><a>[2-]</a></div></body>""",
    """<body><p><a>[2-]</a></p><p><a>[1-]</a></p><h2 keep>[1-]</h2><p keep>[5]</p><p keep>[3]</p><p><a>[1-]</a></p></body>""",
    # link lists and teasers only
    """<body><ul><li><a>[5-]</a><li><a>[6-]</a><li><a>[4-]</a><li><a>[7-]</a></ul><p>[3-]</p><p><a>[8-]</a></p><div><a>[9-]</a> [2-]</div><p><a>[3-]</a></p></body>""",
    # notices, banners and dialogs around a text without marks
    """<body><div class="cookie-consent"><p>[40]</p><button>[1-]</button></div><div class="banner">[22]</div><div><h1 keep>[6-]</h1><p keep>[58]</p><div class="advert"><p>[16]</p></div><p keep>[62]</p><p keep>[5]</p><p keep>[39]</p></div><div class="related-posts"><a>[4-]</a><p>[14]</p></div><dialog><p>[12]</p></dialog><div class="footer-links">[11]</div></body>""",
]


def written_out(page: str) -> str:
    """A page with words for its counts."""

    def words(m: re.Match) -> str:
        return " ".join("word" for _ in range(int(m[1]))) + ("" if m[2] else ".")

    return re.sub(r"\[(\d+)(-?)\]", words, page)
