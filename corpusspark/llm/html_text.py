"""Main-text extraction from HTML pages.

A page is cut into flat text blocks. A block's features are its own words and link density, those of the blocks
before and after it, whether long blocks stand before and after it (so that a list, a table's cells, talk or verse are
judged by what they stand between, however many short blocks there are), whether it ends a sentence or is a heading,
what it stands in (an element for the article, one for something else, or one whose class, id or role names something
else, surely or perhaps), and whether the page has a long block. A decision tree keeps or drops it; it is trained when the operator starts, on the blocks of
the labelled pages in ``html_pages``. On a page without links and without elements for something else nothing is
dropped.

Edge cases: null or empty html gives empty text; markup that is cut off or not closed is read as far
as it goes; raw text of scripts and styles ends at its own end tag or the page's end; blocks without
a word are no blocks. A page's text is held by one task; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusspark.llm.common import table
from corpusspark.llm.html_pages import PAGES, written_out

RAW = "script|style|noscript|template|svg|iframe|object|canvas|textarea|select|title|video|audio"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-z][^\s/>]*)((?:"[^"<]*"|'[^'<]*'|[^'">])*+)>|<[a-z/!?][^>]*(?:>|\Z)|[^<]+|<""",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
CONTAINERS = frozenset(
    "html body head div section article main nav header footer aside form ul ol dl table tbody thead tr td th blockquote figure menu dialog details fieldset button".split()
)
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre br hr figcaption address summary caption legend option label".split())
BOILER_TAGS = frozenset("head nav header footer aside form menu dialog button fieldset".split())
MAIN_TAGS = frozenset(("article", "main"))
#: Names in class, id and role values of elements that are not the article.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr "
    "notice notices alert newsletter subscribe subscription signup sidebar sidebars aside nav navbar navigation menu menus breadcrumb "
    "breadcrumbs footer header masthead comment comments disqus reply replies respond responses discussion share sharing social related "
    "recommended recommendations popup modal overlay widget widgets login toolbar pagination pager copyright skip search contentinfo "
    "complementary dialog form toc outbrain taboola teaser legal".split()
)
#: Of these, names that an article's own parts have too.
UNSURE = frozenset("alert notice notices legal search copyright header toc discussion responses form banner".split())
#: What may stand beside a name without changing what it says; another word makes it unsure: share-price.
PARTS = frozenset(
    "box bar list links link block wrapper wrap container section area widget inner outer banner unit slot panel post posts item items content top bottom left right main "
    "site page global primary secondary button buttons icons icon group row col nav menu form signup policy thread feed body text title heading "
    "stories articles".split()
)
COMMENT_HINTS = frozenset("comment comments disqus reply replies respond responses discussion related teaser ad ads advert sponsored".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

#: Words of a block that is text by its length alone.
LONG = 15
FEATURES = (
    "words", "links", "words_before", "links_before", "words_after", "links_after", "sentence", "heading", "other", "unsure", "main", "page_has_main",
    "long_before", "long_after", "page_has_long",
)


def train(rows: list[tuple], depth: int = 12):
    """A CART tree: (feature, threshold, left, right) or a share of ones. Gini impurity; of equal splits
    the first feature, then the smallest threshold."""
    data = np.array(rows, dtype=float)

    def grow(x: np.ndarray, y: np.ndarray, left: int):
        share = float(y.mean())
        if not left or share in (0.0, 1.0):
            return share
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for t in (values[1:] + values[:-1]) / 2:
                low = x[:, f] <= t
                a, b = y[low], y[~low]
                impurity = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, float(t), low)
        if best is None:
            return share
        _, f, t, low = best
        return (f, t, grow(x[low], y[low], left - 1), grow(x[~low], y[~low], left - 1))

    return grow(data[:, :-1], data[:, -1], depth)


def classify(tree, row: tuple) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree >= 0.5


def _marks(tag: str, attributes: str) -> tuple[int, bool]:
    """What an element's class, id or role says: 2 for surely not the article, 1 for perhaps not, 0; and whether
    that it is the article."""
    other, main = 0, False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role" and value == "main" or name == "itemprop" and value == "articlebody":
            main = True
        elif tag in MAIN_TAGS:
            other = max(other, 2 * (not COMMENT_HINTS.isdisjoint(re.split(r"[^a-z]+", value))))
        elif tag not in ("html", "body") and name != "itemprop":
            for one in value.split():
                parts = [x for x in re.split(r"[^a-z]+", one) if x]
                named = HINTS.intersection(parts)
                if named:
                    sure = not named <= UNSURE and all(x in HINTS or x in PARTS for x in parts)
                    other = max(other, 2 if sure else 1)
    return other, main


def blocks(page: str) -> list[dict]:
    """The page's text blocks in order: text, words, links, what they stand in, heading, and whether they are
    labelled as kept."""
    out: list[dict] = []
    parts: list[str] = []
    link_parts: list[str] = []
    # Open containers: tag, how surely not the article, whether the article; and how many there are of each tag.
    stack: list[tuple[str, int, bool]] = [("", 0, False)]
    opened: dict[str, int] = {}
    in_link = heading = keep = False
    hint = 0

    def close() -> None:
        nonlocal parts, link_parts, hint, heading, keep
        if parts:
            words = entities.unescape("".join(parts)).split()
            if words:
                linked = len(entities.unescape(" ".join(link_parts)).split()) if link_parts else 0
                out.append({"text": " ".join(words), "words": len(words), "links": min(1.0, linked / len(words)), "other": max(stack[-1][1], hint), "main": stack[-1][2], "heading": heading, "keep": keep})
        parts, link_parts, hint, heading, keep = [], [], 0, False, False

    for m in TOKEN.finditer(page):
        tag = m[3]
        if tag is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                parts.append(text)
                if in_link:
                    link_parts.append(text)
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = not m[2]
            continue
        if tag not in BLOCKS:
            continue
        close()
        if tag in CONTAINERS:
            in_link = False
            if m[2]:
                if opened.get(tag):
                    while stack[-1][0] != tag:
                        opened[stack.pop()[0]] -= 1
                    opened[stack.pop()[0]] -= 1
            elif not m[4].endswith("/"):
                if tag == "body":  # a head that isn't closed ends here
                    del stack[1:]
                    opened.clear()
                _, other, main = stack[-1]
                own, own_main = _marks(tag, m[4]) if m[4] else (0, False)
                if tag == "header" and main:
                    own = 0
                elif tag in BOILER_TAGS:
                    own = 2
                stack.append((tag, max(other, own), main or own_main or tag in MAIN_TAGS))
                opened[tag] = opened.get(tag, 0) + 1
        elif not m[2]:
            heading = tag in HEADINGS
            if m[4]:
                hint = _marks(tag, m[4])[0]
        if not m[2] and m[4]:
            keep = bool(_KEEP.search(m[4]))
    close()
    return out


_KEEP = re.compile(r"\bkeep\b")
_NONE = {"words": 0, "links": 0.0}


def _after_long(found: list[dict]) -> list[bool]:
    """Whether a long block of text comes before each block."""
    out, seen = [], False
    for b in found:
        out.append(seen)
        seen = seen or b["words"] >= LONG and b["links"] < 0.5 and b["other"] < 2
    return out


def rows_of(found: list[dict]) -> list[tuple]:
    """The FEATURES of a page's blocks."""
    has_main = any(b["main"] and b["other"] < 2 for b in found)
    long_before, long_after = _after_long(found), _after_long(found[::-1])[::-1]
    has_long = any(b["words"] >= LONG and b["other"] < 2 for b in found)
    out = []
    for k, b in enumerate(found):
        before, after = found[k - 1] if k else _NONE, found[k + 1] if k + 1 < len(found) else _NONE
        out.append((
            b["words"], b["links"], before["words"], before["links"], after["words"], after["links"], b["text"][-1] in ".!?…:;\"”»)", b["heading"], b["other"] == 2, b["other"] == 1, b["main"], has_main,
            long_before[k], long_after[k], has_long,
        ))
    return out


def labelled(pages: list[str] = PAGES) -> list[tuple]:
    """The labelled table: the features of all blocks of the pages, and whether each is kept."""
    out = []
    for page in pages:
        found = blocks(written_out(page))
        out += [(*row, b["keep"]) for row, b in zip(rows_of(found), found, strict=True)]
    return out


def main_text(page: str, tree) -> str:
    found = blocks(page)
    if not any(b["links"] or b["other"] or b["main"] for b in found):
        return " ".join(b["text"] for b in found)
    return " ".join(b["text"] for b, row in zip(found, rows_of(found), strict=True) if classify(tree, row))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text for every row of ``pages``."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = train(labelled())
        for pdf in batches:
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": [main_text(x, tree) for x in pdf["html"]]})

    return rows.mapInPandas(run, "page_id long, url string, text string")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = extract(table(spark, sf_dir, "pages"))
    return text.withColumn("n_chars", F.length("text").cast("long"))


