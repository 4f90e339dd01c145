import os
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessera.llm.html_extract import Line, extract, extract_pages, stretches, window_sums

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">one</a></li><li>two</li></ul></nav><!-- ad --><div class="ad">Buy this now</div>
<article><h1>A &amp; B</h1><p>First <b>bo</b>ld &lt;x&gt;.<br><p>Tiny.<aside>aside</aside><p>  Last\n one&nbsp;here </p>
<section class="comments"><p>reader says a lot of long things that must not appear here at all</p></section></article>
<div id="cookie-notice">We use cookies</div><form><label>Name</label></form><footer>&copy; me</footer></body></html>"""


def test_article_is_whole_and_clean():
    assert extract(PAGE) == "A & B First bold <x>. Tiny. Last one here"


def test_edges():
    assert extract(None) == extract("") == ""
    assert extract("<nav>only menu</nav>") == ""
    assert extract("<article><p>cut o") == "cut o"
    assert extract("<nav><a>x</a><article><p>in unclosed nav</p></article>") == "in unclosed nav"
    assert extract("<article><p>1 < 2 and 3 > 2</p></article>") == "1 < 2 and 3 > 2"
    assert extract("<article>" + "<p>a</p>" * 20_000 + "</article>").count("a") == 20_000
    assert extract("<article><p>&amp &am &#233; &eacute;</p></article>") == "& &am é é"


def test_line_blocks_without_article():
    body = "".join(f"<p>{'word ' * 30}{i}</p>" for i in range(5))
    page = f"<body><div><a href=x>home</a> <a href=y>about</a></div><div>tiny</div><div>.</div><hr>{body}<div><a>next page and other links to follow</a></div><p>end</p></body>"
    text = extract(page)
    assert all(f"word {i}" in text for i in range(5)) and "home" not in text and "next page" not in text


def test_nothing_else_is_dropped_without_article():
    long, last = "word " * 180, "closing words " * 14
    page = f"<body><div><p>{long}</p><div class=ad>x</div><div class=ad>y</div><div class=ad>z</div><p>{last}</p></div></body>"
    assert extract(page) == f"{long.strip()} {last.strip()}"
    assert extract("<body><nav>menu</nav><div><p>A short page.</p><p>Two lines.</p></div></body>") == "A short page. Two lines."
    linked = f"<p>See <a>{'linked words ' * 10}</a> here</p>"
    assert "linked words" in extract(f"<body><div><p>{long}</p>{linked}<p>{last}</p></div></body>")


def test_teaser_article_is_not_the_page():
    text = extract(f"<body><article><p>Teaser card</p></article><div>{'<p>' + 'main text ' * 30 + '</p>'}</div></body>")
    assert text.count("main text") == 30


def test_pages_frame(spark):
    rows = [(1, "u", PAGE), (2, None, None), (1, "u", PAGE), (None, "v", "")]
    out = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text"))
    got = out.collect()
    assert len(got) == 4 and [r.n_chars for r in got if r.page_id == 1] == [len(extract(PAGE))] * 2
    assert all(r.text == "" and r.n_chars == 0 for r in got if r.page_id != 1)
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@given(st.lists(st.integers(0, 60), max_size=40), st.integers(1, 5))
def test_window_sums_equal_brute_force(weights, window):
    assert window_sums(weights, window) == [sum(weights[i : i + window]) for i in range(len(weights))]


@given(st.lists(st.sampled_from([0, 0, 5, 30, 90]), max_size=40), st.integers(1, 120))
def test_stretches_equal_brute_force(weights, surge):
    lines = [Line("x" * w, "", False, False) for w in weights]
    sums = [sum(weights[i : i + 3]) for i in range(len(weights))]
    got = {i for a, b in stretches(lines, weights, sums, surge) for i in range(a, b)}
    # a line is kept if a surge stands at or before it and no dive between them
    want = {i for i in range(len(weights)) if any(weights[s] and sums[s] >= surge and all(sums[s : i + 1]) for s in range(i + 1))}
    assert got == want


def test_distribution_decides():
    body = "".join(f"<p>{'word ' * 30}{i}</p>" for i in range(4))
    far = "<div>" + "<p><a>link text here</a></p>" * 4 + "</div>"
    # a short line far from every surge goes, a heading shortly before one stays
    assert extract(f"<body><div>lost</div>{far}<h1>Top</h1><p>By</p><p>Me</p>{body}{far}<p>gone</p></body>") == "Top By Me " + " ".join("word " * 30 + str(i) for i in range(4))
    # in an article all that stands between dives is kept
    assert extract(f"<article><h2>A</h2><p>b</p><p>c</p><p>d</p>{body}<aside>x</aside><p>e</p></article><p>{'outside ' * 9}</p>").startswith("A b c d word")


def test_class_words():
    long = "<p>" + "text of the article " * 20 + "</p>"
    for name in ("share-price", "notice-board", "article-header", "related-work", "entry-header"):
        assert "Kept here" in extract(f"<article>{long}<div class='{name}'>Kept here</div>{long}</article>"), name
    for name in ("ad", "ad-300x250", "share-buttons", "site-header", "cookie-notice", "post-comments", "comment", "left-sidebar", "siteFooter", "alert alert-info", "newsletter-signup"):
        assert "Gone" not in extract(f"<article>{long}<div class='{name}'>Gone</div>{long}</article>"), name


SMALL = "/root/testdata/sf0.01/pages.parquet"


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no test data")
def test_pages_do_not_need_article_tags(spark):
    for (html,) in spark.read.parquet(SMALL).select("html").collect():
        whole = extract(html)
        assert len(extract(html.replace("<article", "<div").replace("</article>", "</div>"))) >= 0.95 * len(whole) > 0


def test_hostile_markup_is_linear():
    n = 40_000
    for page in ("<div>" * n + "</x-y><section></nav>" * n, "<svg>" * n, "<div>" * n + "<article>" * n, "<a x" * n + '"', '<a "x>' * (n + 1), "<p>" * n + "</div>" * n, "<b class=ad>" * n + "</i>" * n):
        start = time.perf_counter()
        extract(page)
        assert time.perf_counter() - start < 5
