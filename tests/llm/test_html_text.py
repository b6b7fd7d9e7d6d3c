import re
import time
from html import unescape

import pytest

from reposieve.llm import html_text, queries

TEXT = "The ferry left the harbour late, and the wind had turned before anybody on the pier noticed it."


@pytest.fixture(scope="module")
def tree(spark):
    return html_text.train(spark)


def main(page, tree):
    return html_text.main_text(page if page is None else page.encode(), tree)


def test_tree_fits_its_table(tree):
    assert all(html_text.decide(tree, x) == (y == 1) for y, x in html_text.labelled())


@pytest.mark.parametrize("page,want", [
    (f"<body><nav><a href=/>Home</a></nav><article><h1>Tides</h1><p>{TEXT}</p><p>Ha.</p></article><footer>&copy; X</footer>", ["Tides", TEXT, "Ha."]),
    (f"<header class='site-header'><p>{TEXT}</p></header><main><p>{TEXT}</p></main>", [TEXT]),
    (f"<article><header><h1>Tides</h1></header><p>{TEXT}</p><div class='comments'><p>{TEXT} So true.</p></div></article>", ["Tides", TEXT]),
    (f"<div id='cookie-banner'>{TEXT}</div><article><p>{TEXT}</p></article><aside><p>{TEXT}</p></aside><form>{TEXT}<input></form>", [TEXT]),
    (f"<script>var a='<p>{TEXT}</p>';</script><style>p{{}}</style><article><p>A &amp; B &lt;i&gt; &#233;&nbsp; c</p><!-- {TEXT} --></article>", ["A & B <i> é c"]),
    (f"<article><p><b>Bold.<br><p>{TEXT}<p>Third <i>one</i>.</article>", ["Bold.", TEXT, "Third one."]),
    (f"<article><p>{TEXT}</p><p>Cut &am</p></article><foo", [TEXT, "Cut &am"]),
    (f"<article><p>{TEXT}</p><script>never closed <p>{TEXT}", [TEXT]),
    (f"<article><p>{TEXT}</p><p hidden>{TEXT}</p><p style='display: none'>{TEXT}</p></article>", [TEXT]),
    ("", []), (None, []), ("   ", []), ("<<<>>>&&&", None), ("</p></div>" * 50, []),
])
def test_pages(tree, page, want):
    got = main(page, tree)
    assert want is None or got == "\n".join(want)


def test_long_and_deep_pages(tree):
    page = "<div>" * 5000 + "<article>" + f"<p>{TEXT}</p>" * 3000 + "</article>"
    assert main(page, tree).count("\n") == 2999


@pytest.mark.parametrize("tag", html_text.RAW)
def test_letters_that_lower_to_two_do_not_move_the_end(tree, tag):
    page = "İ" * 60 + f"<{tag}>x</{tag.upper()}><article><p>{TEXT}</p><{tag}>İİİ y</{tag}><p>{TEXT} Two.</p></article>"
    assert main(page, tree).split("\n")[-2:] == [TEXT, f"{TEXT} Two."]


def test_open_tags_take_linear_time(tree):
    for page in ("<div>" * 200_000, "<li>" * 200_000, "<ul><li>" * 100_000, "<div><li>" * 100_000 + "</ul>" * 100_000):
        start = time.time()
        assert main(f"{page}<article><p>{TEXT}</p></article>", tree).endswith(TEXT)
        assert time.time() - start < 2


def test_whole_given_table(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.QUERIES["op1_html"](spark, sf)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = found.collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id].html, re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", body.replace("<br>", " "))]
        assert r.text == "\n".join(filter(None, blocks)) and r.n_chars == len(r.text)


def test_awkward_rows(spark, tree):
    table = [(1, None, None, "x"), (1, None, None, "x"), (None, "u", "<p>", "y"), (2, "u", f"<article><p>{TEXT}</p></article>", "z")]
    df = spark.createDataFrame(table, "page_id long, url string, html string, text string")
    rows = html_text.extract(df, tree, ["page_id", "url"]).collect()
    assert sorted((r.text, r.n_chars) for r in rows) == [("", 0)] * 3 + [(TEXT, len(TEXT))]
    assert html_text.extract(df.filter("false"), tree, ["page_id"]).collect() == []
