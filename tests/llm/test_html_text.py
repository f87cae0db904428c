import html
import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from tests.conftest import SF_MID
from wavepanel.llm import html_text as H
from wavepanel.llm.queries import op11_html_text

PROSE = ["Rivers carry sand and silt from the hills to the sea, and lay it down where they slow.",
         "Every spring the water rises, cuts new banks, and leaves the old bends behind as lakes.",
         "Farmers have long known this, and built their houses on the higher ground beside them."]
PAGES = [
    # no article element: the densest div, its short lines too
    ("<html><body><div id='top-nav'><a href=/>Home</a><a href=/b>About us</a></div><div class='content'><h1>Rivers</h1>"
     f"<p>{PROSE[0]}<p>{PROSE[1]}<p>So.<p>{PROSE[2]}</div><div class='sidebar'><p>{PROSE[0]}</div>"
     "<div class='footer'><p>All rights reserved.</div></body></html>", ["Rivers", PROSE[0], PROSE[1], "So.", PROSE[2]]),
    # comments, related links, adverts, forms and notices within the article
    (f"<body><main><h1>Rivers</h1><p>{PROSE[0]}</p><div class='ad-box'><p>{PROSE[1]}</p></div><p>{PROSE[2]}</p>"
     f"<aside>{PROSE[1]}</aside><form><p>{PROSE[1]}</p><input></form><section id='comments'><article class='comment'>"
     f"<p>{PROSE[1]}</p></article></section><div role='alert'>{PROSE[0]}</div></main>", ["Rivers", PROSE[0], PROSE[2]]),
    # menu and form left open before the article; entities, white space, breaks, comments and scripts
    (f"<body><nav><ul><li><a href=/>Home</a><article><h1>Salt &amp; sand&nbsp;&#8212; &lt;b&gt;</h1><p>One\n\t two<br>three "
     f"<b>four</b><!-- no --><script>if (a < b) document.write('<p>no</p>')</script> five.<p>{PROSE[0]}</article>",
     ["Salt & sand — <b>", "One two three four five.", PROSE[0]]),
    # the article's own header stays, the page's doesn't; tables, lists, quotes
    (f"<header><h1>The Daily</h1><p>{PROSE[0]}</p></header><article><header><h1>Title</h1></header><ul><li>{PROSE[1]}<li>two</ul>"
     f"<table><tr><td>a<td>b<tr><td>c</table><blockquote>{PROSE[2]}</blockquote></article><footer>end</footer>",
     ["Title", PROSE[1], "two", "a", "b", "c", PROSE[2]]),
    # hidden text, runs of links in the article
    (f"<article><p hidden>{PROSE[1]}</p><p style='display: none'>{PROSE[1]}</p><p>{PROSE[0]}</p><p>{PROSE[2]}</p>"
     f"<ul><li><a href=1>Other</a><li><a href=2>Another</a><li><a href=3>More</a></ul></article>", [PROSE[0], PROSE[2]]),
    (f"<p>{PROSE[0]}", [PROSE[0]]),
    ("just words", ["just words"]),
    (None, []), ("", []), (" \n ", []), ("<nav><a href=1>x</a></nav>", []), ("<![x[y]]> <!bad <? <", ["<"]),
    (f"<article><p>{'w ' * 200_000}</p><p>x</article>", [("w " * 200_000).strip(), "x"]),
]


@pytest.mark.parametrize("page", range(len(PAGES)))
def test_written_pages(page):
    given, want = PAGES[page]
    if given is not None and not given.startswith("<![x"):
        assert H.main_text(given).split("\n") == (want or [""])
    elif given:
        H.main_text(given)


def article(page: str) -> str:
    """The article element of the given tables' pages, read by patterns."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", inner))
    return "\n".join(b for b in blocks if b)


def test_query_equals_the_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF_MID}/pages.parquet").collect()}
    found = op11_html_text(spark, SF_MID).collect()
    assert len(found) == len(pages)
    for r in found:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_awkward_rows(spark):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                           T.StructField("html", T.StringType()), T.StructField("text", T.StringType()), T.StructField("id", T.StringType())])
    rows = [(i, f"u{i}", p, "x", "y") for i, (p, _) in enumerate(PAGES)]
    rows += [(None, None, PAGES[0][0], "x", "y"), (1, "u1", PAGES[1][0], "x", "y")]
    found = H.extract_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id is None, r.page_id, r.url, r.text, r.n_chars) for r in found if r.page_id != 11) == sorted(
        (i is None, i, u, t, len(t)) for i, u, t in ((i, u, H.main_text(p or "")) for i, u, p, _, _ in rows) if i != 11)
    assert H.extract_text(spark.createDataFrame([], schema)).collect() == []


def test_no_markup_raises():
    draw = random.Random(3)
    bits = ["<", ">", "</", "<p>", "</p>", "<article", "<article>", "</article>", "<!--", "-->", "<![", "]]>", "<!", "<?", "&", "&#", "&#x110000;",
            "&amp", "<script>", "</script", "<td>", "<a href='", "x", " ", "\x00", "é", "<div class=ad>", "</div>", "<li>", "<style>", "<form>"]
    for _ in range(3000):
        H.main_text("".join(draw.choice(bits) for _ in range(draw.randrange(30))))


def test_deep_and_long_pages_take_linear_time():
    assert H.main_text("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"
    assert H.main_text("<article>" + "<p>ab" * 50_000 + "</b>" * 50_000).count("\n") == 49_999


def test_smoothing_and_threshold():
    flat = H.smoothed(np.full(20, 3.0))
    assert np.allclose(flat, 3.0)
    peak = H.smoothed(np.eye(1, 21, 10)[0])
    assert peak.argmax() == 10 and abs(peak.sum() - 1) < 1e-9 and np.allclose(peak, peak[::-1])
    assert 1 < H.threshold(np.array([0, 0.1, 0.2, 5, 5.5])) < 5
    assert H.threshold(np.zeros(4)) < 0
