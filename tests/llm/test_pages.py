"""Page texts and URL filters."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from loam.llm import html_extract as H
from loam.llm import url_filter as U

WEIGHTS = {"word": 3.0, "a word": 0.5, "p": 0.05, "h1": 0.05, "li": 2.0, "a": 1.0, "div": 1.0}


def text(page):
    return H.main_text(page, WEIGHTS)


def test_article_alone():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>x";</script></head><body>
    <nav><ul><li><a href="/a">Menu</a></ul></nav><header>Site</header><div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->
    <article><h1>Ti&amp;tle</h1><p>One <b>t</b>wo&nbsp;three<br>four</p><aside>side <p>bar</p></aside><p class="lead">five <form>name <input name=x></form> six</p>
    <div class="comments"><p>reader</p></div></article><footer>&copy; me</footer></body></html>"""
    assert text(page) == "Ti&tle One two three four five six"


def test_odd_pages():
    for page in (None, "", "   ", "<nav>x</nav>", "<p></p>", "<!-- x"):
        assert text(page) == ""
    assert text("just text") == "just text"
    assert text("<p>a<p>b<b>c") == "a bc"
    assert text("<p>1 < 2 &lt; 3 &#233; &unknown; x</p>") == "1 < 2 < 3 é &unknown; x"
    assert text('<b title="a>b">link</b> text') == "link text"
    assert text("<article><p>x " + "word " * 200_000 + "</article>").count("word") == 200_000
    assert text("<div class=ad><div>in</div>ad</div><p>body text</p>") == "body text"


def test_broken_pages_are_read_in_one_go():
    for broken in ("<a ", '<a ">"', "<a \"'>", "</x>", "<div>", "<!--", "<script ", "<!", "a<b "):
        began = time.process_time()
        text(broken * 100_000)
        assert time.process_time() - began < 20, broken
    assert text("a <b") == "a <b" and text("<p>x <!-- > y") == "x" and text("x<script a<b>no</script> y") == "x y"


def test_menu_without_a_name_is_outside():
    """No element is set apart here: the scan leaves the link list out by its score."""
    links = "".join(f"<li><a href='/{i}'>w</a></li>" for i in range(20))
    assert text(f"<ul>{links}</ul><p>{'word ' * 30}</p><ul>{links}</ul>") == ("word " * 30).strip()


def test_wrappers_are_read():
    """A class that speaks of a sidebar or comments doesn't hide the article around which it lies."""
    inner = "<h1>Title</h1><p>one two <span class='ad'>buy</span>three</p><div class='comments'><p>reader</p></div>"
    want = "Title one two three"
    for page in (
        f"<body><div class='layout has-sidebar'><div class='sidebar'>a b c</div><article>{inner}</article></div></body>",
        f"<div id='page' class='no-comments'><div class=related><article>teaser</article></div><main>{inner}</main></div>",
        f"<div class='with-header'><div id=form-page>{inner}</div></div><div class='footer'>end</div>",
        f"<main><div class='side content'><article>{inner}</article></div></main>",
        f"<div class='no-menu'><article>{inner}",
    ):
        assert text(page) == want, page
    # what isn't around the article stays apart, however long
    assert text(f"<article>{inner}</article><div class='comments'>{'reader ' * 50}</div>") == want
    assert text("<div class='search'>" * 3000 + "<p>deep words</p>") == "deep words"


def test_pages_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r for r in H.extract(pages.withColumn("text", F.lit("clash"))).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        inner = r["html"][r["html"].index("<article>") : r["html"].index("</article>")]
        import html
        import re

        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", inner)).split())
        assert got[r["page_id"]]["text"] == want
        assert got[r["page_id"]]["n_chars"] == len(want)
    assert H.extract(pages.limit(0)).count() == 0
    empty = H.extract(spark.createDataFrame([(None, None, None)], "page_id long, url string, html string"), WEIGHTS).collect()
    assert [tuple(r) for r in empty] == [(None, None, "", 0)]


def verdicts(df):
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in df.collect()}


def test_rules(spark):
    rows = [
        (1, "http://x.example.com/en/7/a"), (2, "https://www.Example.COM/en/8?q#f"), (3, "http://a.net/de/1"), (4, "http://example.net/de/8"), (5, "http://b.org/es/"), (6, "http://b.org/esp"),
        (7, None), (8, "no scheme/en/"), (9, "http://notcom/en/"), (10, "ftp://com/en/"), (11, "http://x.com?/en/"), (12, ""), (1, "http://x.example.com/en/7/a"), (None, "http://x.com/en/"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("html", F.lit(None).cast("string")).withColumn("host", F.lit("clash"))
    out = U.filter_urls(df, U.RULES, U.page_edges(df))
    got = verdicts(out)
    assert out.count() == len(rows)
    assert got[1] == ("x.example.com", "/en/7/a", "example.com/en/7", "allow")
    assert got[2] == ("www.example.com", "/en/8", "com/en/", "block")
    assert got[3][2:] == ("net/de/", "allow")
    assert got[4][2:] == ("example.net/de/8", "block")
    assert got[5][2:] == ("org/es/", "block") and got[6][2:] == (None, "allow")
    assert got[7] == got[8] == got[12] == ("", "", None, "allow")
    assert got[9][2:] == (None, "allow") and got[10][2:] == ("com/en/", "block")
    assert got[11] == ("x.com", "", None, "allow") and got[None][3] == "block"
    assert U.filter_urls(df.limit(0), U.RULES, U.page_edges(df.limit(0))).count() == 0


def test_aliases(spark):
    rows = [
        (1, "http://a.site/x", '<link rel="canonical" href="https://b.com/en/1">'),
        (2, "http://c.site/y", "<META content=\"0; URL='http://a.site/x#top'\" http-equiv=refresh>"),
        (3, "http://d.site/z", '<link href="//example.com/en/7z" rel=canonical>'),
        (4, "http://e.site/z", None),
        (5, "http://f.site/d/p", '<link rel="canonical" href="q?a=1&amp;b=2">'),
        (6, "http://f.site/d/q?a=1&b=2", ""),
        (7, "https://c.site/y", ""),
        (8, "http://lone.site/", '<link rel="stylesheet" href="http://b.com/en/1">'),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {i: v[3] for i, v in verdicts(U.filter_urls(df, U.RULES, U.page_edges(df))).items()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "allow"}
    more = spark.createDataFrame([("http://a.site/x", "http://d.site/z"), ("http://e.site/z", "http://c.site/y"), (None, "http://c.site/y")], "src string, dst string")
    both = {i: v[3] for i, v in verdicts(U.filter_urls(df, U.RULES, U.page_edges(df).unionByName(more))).items()}
    assert both == dict.fromkeys(range(1, 9), "allow")  # the allowed URL goes before the blocked one


def test_plan_is_native(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    plan = U.filter_urls(pages, U.RULES, U.page_edges(pages))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
