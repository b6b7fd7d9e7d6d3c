"""Main text of web pages.

A page becomes a flat list of text blocks. Each has its word count, its link density and those of its
neighbours, and what its ancestors say: chrome (menus, footers, adverts, comments ...), article, heading.
A decision tree, trained on the small labelled table below, keeps or drops each block; the kept ones are
joined in page order by one line feed, whole.

NULL and empty pages have an empty text. Unclosed and stray tags are tolerated: an end tag closes up to
the tag it names, a cut-off tag at the end of a page is no text, unclosed scripts reach to the end. Rows may repeat.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from functools import lru_cache

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession

from reposieve.llm.common import per_row

# Names of HTML and words that sites use in class, id and role.
RAW = ("script", "style", "title", "textarea", "template", "noscript", "iframe", "svg", "select", "button", "object")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
CHROME_TAGS = frozenset("nav aside form menu dialog footer head fieldset".split())
ARTICLE_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CHROME_WORDS = frozenset(
    "ad ads advert advertisement adverts adsense adsbygoogle alert banner breadcrumb breadcrumbs captcha comment comments commentlist complementary consent "
    "contentinfo cookie cookies copyright disclaimer disqus dialog discussion feedback footer gdpr login menu modal nav navbar navigation newsletter notice "
    "notification overlay pager pagination popup privacy promo promoted promotion recommended related replies respond search share sharing sidebar signin signup "
    "skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar trending widget widgets".split()
)
ARTICLE_WORDS = frozenset("articlebody entry-content post-content post-body article-body article-content story-body main".split())
#: A header names the page outside the article, and the article inside it.
OUTER_WORDS = frozenset("header masthead".split())

_TAG = re.compile(r"""<(?:!--.*?(?:-->|$)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)(>|$))""", re.S)
_RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?=[\s=]|$)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "chrome", "article", "heading")


@lru_cache(4096)
def kind(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element is chrome, article, or chrome only outside an article."""
    chrome, article, outer = tag in CHROME_TAGS, tag in ARTICLE_TAGS, tag == "header"
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            chrome = True
        elif name in ("class", "id", "role"):
            whole = set(value.split())
            parts = {p for w in whole for p in _PART.split(w)} | whole
            chrome = chrome or not CHROME_WORDS.isdisjoint(parts)
            outer = outer or not OUTER_WORDS.isdisjoint(parts)
            article = article or not ARTICLE_WORDS.isdisjoint(whole)
    return chrome, article, outer


def blocks(page: str) -> list[tuple[str, int, float, int, int, int]]:
    """``(text, words, link density, chrome, article, heading)`` of every block that has text."""
    found, pieces, linked, stack = [], [], 0, []
    places = defaultdict(list)  # where in the stack a tag is open
    chrome = article = heading = in_link = 0

    def flush():
        nonlocal linked
        if pieces:
            words = html.unescape("".join(pieces)).split()
            if words:
                share = min(1.0, linked / len(words))
                found.append((" ".join(words), len(words), share, int(chrome > 0), int(article > 0), int(heading > 0)))
            pieces.clear()
        linked = 0

    def close(depth):
        nonlocal chrome, article, heading
        while len(stack) > depth:
            tag, a, b, c = stack.pop()
            places[tag].pop()
            chrome, article, heading = chrome - a, article - b, heading - c

    def push(tag, *flags):
        nonlocal chrome, article, heading
        places[tag].append(len(stack))
        stack.append((tag, *flags))
        chrome, article, heading = chrome + flags[0], article + flags[1], heading + flags[2]

    def text(piece):
        nonlocal linked
        if piece:
            pieces.append(piece)
            if in_link:
                linked += len(piece.split())

    at = 0
    while True:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        end, tag, attributes, _ = m.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW and not end:
            flush() if tag not in ("button", "object") else None
            stop = _RAW_END[tag].search(page, at)
            at = stop.start() if stop else len(page)
        elif tag == "a":
            in_link = 0 if end else 1
        elif tag in ("br", "td", "th"):
            pieces.append(" ") if tag == "br" else flush()
        elif tag in VOID:
            if tag == "hr":
                flush()
        elif tag not in INLINE:
            flush()
            if end:
                if places[tag]:
                    close(places[tag][-1])
                    in_link = 0
                continue
            if stack and stack[-1][0] == "p":
                close(len(stack) - 1)
            if tag == "li" and places["li"]:
                last = places["li"][-1]
                if not any(places[x] and places[x][-1] > last for x in ("ul", "ol", "menu")):
                    close(last)
            a, b, c = kind(tag, attributes)
            push(tag, int(a or c and not article), int(b), int(tag in HEADINGS))
        elif not end and attributes and kind(tag, attributes)[0]:
            # Inline adverts and the like are blocks of their own.
            flush()
            push(tag, 1, 0, 0)
        elif end and stack and stack[-1][0] == tag:
            flush()
            close(len(stack) - 1)
    flush()
    return found


def features(found: list[tuple]) -> list[tuple[float, ...]]:
    """A row of ``FEATURES`` for each block; beyond the page ends there are no words."""
    size = [(float(b[1]), b[2]) for b in found]
    around = [(0.0, 0.0), *size, (0.0, 0.0)]
    return [
        (*around[i + 1], *around[i], *around[i + 2], float(b[3]), float(b[4]), float(b[5])) for i, b in enumerate(found)
    ]


_LONG = "The river rose again in the spring and the people of the valley moved their herds to the upper fields before the water came."
_MORE = "Nobody had counted the days, yet everyone agreed that the bridge would hold for one more season at least."
_LINKS = '<a href="/a">Home</a> <a href="/b">World</a> <a href="/c">Sport</a>'
#: Small labelled table: pages and, for each of their blocks in order, whether it is main text.
LABELLED = [
    (f"<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav><article><h1>Spring floods</h1><p>{_LONG}</p><p>{_MORE}</p><p>So it did.</p></article><footer>&copy; 2020 The Valley Post</footer>", "00" "1111" "0"),
    (f"<header><h1>The Valley Post</h1></header><div class=ad>Buy boots now, half price until Sunday evening.</div><main><h2>Bridge</h2><p>{_MORE}</p><ul><li>Two arches</li><li>One tower</li></ul></main><aside>Read more about the weather of the week.</aside>", "0" "0" "1111" "0"),
    (f"<div>{_LINKS}</div><div><h1>Spring floods</h1></div><div>{_LONG}</div><div>{_MORE}</div><div>Copyright notice</div>", "0" "111" "0"),
    (f"<div>{_LINKS}</div><p>{_LONG}</p><p>{_LONG} {_MORE}</p><p>{_MORE}</p><div>{_LINKS}</div>", "0" "111" "0"),
    (f"<article><p>One.</p><p>{_LONG}</p><p>Two words.</p><p>See <a href=/x>the map</a> for details.</p></article><section class=comments><p>Nice piece, I lived there as a child and remember all of it.</p><p>First!</p></section>", "1111" "00"),
    (f"<div id=cookie-notice>We use cookies to make this site better for you and for our partners.</div><article><h1>Herds</h1><p>{_LONG}</p></article><div class=sidebar><p>Popular this week are stories on bridges and on boats.</p></div>", "0" "11" "0"),
    (f"<form><p>Leave your name and address and we will write to you every week.</p></form><div class=post-content><p>{_MORE}</p><p>Yes.</p><blockquote>{_LONG}</blockquote></div>", "0" "111"),
    (f"<p>{_LINKS}</p><h1>Towers</h1><p>{_MORE}</p><p>{_LONG}</p><h2>Notes</h2><p>{_LONG}</p><p>{_LINKS} {_LINKS}</p>", "0" "11111" "0"),
    (f"<article><h1>Index</h1><p><a href=/1>All stories of the year in one list</a></p><p>{_LONG}</p><aside>Advertisement</aside><p>Short end.</p></article><div class=related><h3>Related</h3><p>{_MORE}</p></div>", "111" "0" "1" "00"),
    (f"<main><p>{_MORE}</p><div class=share>Share this with your friends</div><p>{_LONG}</p><nav>{_LINKS}</nav><p>End</p></main><footer><p>{_MORE}</p></footer>", "1" "0" "1" "0" "1" "0"),
    (f"<div>Menu</div><div><a href=/1>One</a></div><div><a href=/2>Two</a></div><div>{_LONG}</div><div>{_MORE} {_LONG}</div><div>{_LONG}</div><div><a href=/3>Next</a></div>", "000" "111" "0"),
    (f"<ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul><div><p>{_LONG}</p><p>It held.</p><p>{_MORE}</p></div><p><a href=/p>Privacy</a></p>", "00" "111" "0"),
    ("<article><p>Yes.</p><p>No, not so.</p><p>So it is.</p></article>", "111"),
    (f"<article><p>{_LONG}</p><p>Then one.</p><p>It held.</p></article>", "111"),
    (f"<article><h2>Two</h2><p>Few words here.</p><p>{_MORE}</p></article><div>About us and our other pages</div>", "111" "0"),
    (f"<main><p>It held.</p><p>{_LONG}</p><p>Then.</p><p>{_LONG}</p><p>Third one.</p></main>", "11111"),
    (f"<article><h1>Lists</h1><p><a href=/1>First</a></p><p><a href=/2>Second of two</a></p><p>End.</p></article><p>{_LINKS}</p>", "1111" "0"),
    (f"<main><p>{_MORE} {_LONG}</p></main><p>{_LINKS}</p><div>Back to top</div>", "1" "00"),
    (f"<article><p>{_LONG}</p></article>", "1"),
    ("<article><p>Short.</p></article><p>Imprint</p>", "1" "0"),
    (f"<article><h1>A</h1><p>B</p></article><div class=promo>{_LONG} {_MORE}</div><div class=newsletter><p>{_MORE}</p></div><footer>C</footer>", "11" "0" "0" "0"),
]


def labelled() -> list[tuple[float, tuple[float, ...]]]:
    rows = []
    for page, marks in LABELLED:
        found = blocks(page)
        assert len(found) == len(marks), (page, found)
        rows += [(float(m), f) for m, f in zip(marks, features(found))]
    return rows


def train(spark: SparkSession) -> tuple:
    """Decision tree as nested ``(feature, threshold, left, right)``; leaves are 0 or 1."""
    rows = spark.createDataFrame([(y, Vectors.dense(x)) for y, x in labelled()], ["label", "features"]).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=8, maxBins=64, seed=1).fit(rows)

    def export(node):
        if node.subtreeDepth() == 0:
            return float(node.prediction())
        split = node.split()
        return split.featureIndex(), float(split.threshold()), export(node.leftChild()), export(node.rightChild())

    return export(model._java_obj.rootNode())


def decide(tree, x: tuple[float, ...]) -> bool:
    while isinstance(tree, tuple):
        feature, threshold, left, right = tree
        tree = left if x[feature] <= threshold else right
    return tree > 0.5


def main_text(page: bytes | None, tree) -> str:
    found = blocks((page or b"").decode("utf-8", "replace"))
    return "\n".join(b[0] for b, x in zip(found, features(found)) if decide(tree, x))


def extract(pages: DataFrame, tree, keep: list[str], html_col: str = "html") -> DataFrame:
    """``keep`` with ``text`` and ``n_chars`` of every row."""
    def of(page):
        text = main_text(page, tree)
        return text, len(text)

    return per_row(pages, keep, html_col, of, "text string, n_chars long")
