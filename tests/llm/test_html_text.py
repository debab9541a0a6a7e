import html
import re
import time

import numpy as np

from axiomata.llm import html_text, queries


def test_article_without_what_is_around_it():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header>Site</header><nav><ul><li>Home</li></ul></nav><div class="cookie-notice">We use cookies</div><aside>Side</aside>
    <article><header><h1>The  title &amp; more</h1></header><p><b>First<br>line</b> of a long paragraph that is the text.<p>Short.</p>
    <form><input>search</form><div class="ad">Buy</div><ul><li>one</li><li>two</li></ul><div id="comments"><p>Nice post, a long comment by a reader of it.</p></div></article>
    <footer>&copy; us</footer></body></html>"""
    assert html_text.main_text(page) == "The title & more\nFirst line of a long paragraph that is the text.\nShort.\none\ntwo"


def test_region_without_an_article_element():
    page = "<body><div id=top><a>a</a><a>b</a></div><div><div><h2>Head</h2><p>" + "long text " * 30 + "</p><p>tail</p></div><div class='sidebar'>no</div></div></body>"
    assert html_text.main_text(page).split("\n")[0] == "Head" and html_text.main_text(page).endswith("tail")


def test_odd_pages():
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<div></div>") == ""
    assert html_text.main_text("just text") == "just text"
    assert html_text.main_text("<p>a</b></p></div><p>unclosed <i>b") == "a\nunclosed b"
    assert html_text.main_text("<p>" + "word " * 100_000) == ("word " * 100_000).strip()
    assert html_text.main_text("<script>only</script><!-- c -->") == ""


def test_unclosed_head_and_an_article_header():
    assert html_text.main_text("<html><head><title>t</title><meta x><body><p>text</p>") == "text"
    assert html_text.main_text("<article><div class='entry-header'><h1>T</h1></div><p>long text of it</p><div class='share-buttons'>x</div></article>") == "T\nlong text of it"


def test_parts_of_the_method():
    assert np.allclose(html_text.smoothed(np.ones(20)), 1)
    assert 2 < html_text.threshold(np.array([1, 1.5, 1, 9, 10, 11])) < 9


def test_query_against_the_article_elements(spark, sf_dir):
    rows = {r.page_id: r for r in queries.op4_html_text(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inner = re.sub("<!--.*?-->", "", re.search("<article>(.*)</article>", r.html, re.S)[1], flags=re.S)
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", lambda m: " " if m[0].startswith("<br") else "", b))).strip() for b in re.split("</?(?:p|h1)[^>]*>", inner)]
        want = "\n".join(b for b in blocks if b)
        assert (rows[r.page_id].text, rows[r.page_id].n_chars, rows[r.page_id].url) == (want, len(want), r.url)


def test_nulls_repeats_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, "<p>a</p>", "t"), (1, None, "<p>a</p>", "t"), (None, "u", None, "t")], "page_id long, url string, html string, kind string")
    got = html_text.with_main_text(df, keep=("page_id", "kind")).collect()
    assert sorted((r.page_id or 0, r.text, r.kind) for r in got) == [(0, "", "t"), (1, "a", "t"), (1, "a", "t")]
    assert html_text.with_main_text(df.limit(0)).count() == 0


def test_pages_without_an_article_element_keep_title_and_lead():
    long = "".join(f"<p>{'some long text of a paragraph ' * 8}{k}</p>" for k in range(3))
    title = f"<body><div><a href=x>one</a> <a href=y>two</a></div><h1>The title</h1><p>Short lead in.</p><div>{long}</div><p><a href=z>More stories of ours</a></p></body>"
    got = html_text.main_text(title).split("\n")
    assert got[:2] == ["The title", "Short lead in."] and len(got) == 5 and got[-1].endswith("paragraph 2")
    split = f"<body><h1>The title</h1><div>{long * 6}</div><div><p>The last part of it.</p></div><footer><p>foot</p></footer></body>"
    got = html_text.main_text(split).split("\n")
    assert got[0] == "The title" and got[-1] == "The last part of it." and len(got) == 20


def test_time_is_linear_in_unclosed_and_deep_tags():
    pages = ["<div>x" * 100_000, "<b>x" * 100_000, "<i>" * 50_000 + "<li>y</li>" * 50_000, "<b><head><p>z" * 30_000, "<div>" * 50_000 + "deep" + "</div>" * 50_000 + "</span>" * 50_000]
    for page in pages:
        start = time.perf_counter()
        assert html_text.main_text(page)
        assert time.perf_counter() - start < 6, page[:20]


def test_a_kept_column_may_have_any_name(spark):
    df = spark.createDataFrame([(1, "<p>a</p>", "k")], "page_id long, html string, __html string")
    assert [tuple(r) for r in html_text.with_main_text(df, keep=("page_id", "__html")).collect()] == [(1, "k", "a")]
