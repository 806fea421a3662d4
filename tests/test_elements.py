"""The native element tree against a plain-Python walk of the same pages, and hand-written values for odd markup."""

import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from ferret import rules
from ferret.functions import elements as E
from ferret.operators import extract as X
from ferret.sources.adapters import widen_pages
from ferret.sources.tables import read_table
from tests.conftest import SF01
from tests.html_walk import walk_one

FIELDS = ["p_texts", "content_broad", "content_narrow", "signals", "h1_texts", "h2_texts", "pre_code", "pre_texts"]


def fields_of(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").withColumn("url", F.lit("https://h.io/"))
    return [r.asDict() for r in E.page_fields(df).orderBy("page_id").collect()]


def check(got, page):
    want = walk_one(page)
    for f in FIELDS:
        assert got[f] == want[f], (f, page[:300] if page else page)


def test_given_pages_equal_the_walk(spark):
    pages = [r.html for r in widen_pages(read_table(spark, SF01, "pages")).select("html").collect()]
    for got, page in zip(fields_of(spark, pages), pages, strict=True):
        check(got, page)


def test_random_nestings_equal_the_walk(spark):
    rnd = random.Random(9)
    tags = ["p", "div", "pre", "code", "h1", "h2", "article", "b", "main", "ul", "li", "span"]
    attrs = ["", "", ' class="content"', " class='post x'", " id=content", ' class="markdown-body  tutorial" id="z"', ' title="a > b"', " CLASS=cobol", ' data-class="entry"']
    words = ["text ", " Guide to", "how to", " ", "\n", "INTRODUCTION", "x &amp; y", "fortran"]
    pages = []
    for _ in range(150):
        out = []
        for _ in range(rnd.randrange(1, 60)):
            k = rnd.random()
            t = rnd.choice(tags)
            out.append(f"<{t}{rnd.choice(attrs)}>" if k < 0.35 else f"</{t}>" if k < 0.6 else rnd.choice(["<br>", "<!-- <p>c</p> -->", "<img src=x>", "<hr/>", "<script>if (a<b) x='<p>'</script>",
                       "<style>p > a {}</style>", "<!DOCTYPE html>"]) if k < 0.7 else rnd.choice(words))
        pages.append("".join(out))
    for got, page in zip(fields_of(spark, pages), pages, strict=True):
        check(got, page)


def test_null_empty_and_long_pages(spark):
    long = "<div class=content>" + "<p>one<b>two</b>three" * 3000 + "</div>"
    got = fields_of(spark, [None, "", "no markup", long, "<" * 50, "<p" + " a='b'" * 3000 + ">t"])
    for g in got[:3]:
        assert g["p_texts"] == [] and g["signals"] == [] and g["content_broad"] is None
    assert got[3]["p_texts"] == ["one", "three"] * 3000
    assert got[4]["p_texts"] == [] and got[5]["p_texts"] == ["t"]


def test_code_with_children_and_attributes_with_brackets(spark):
    page = ('<pre><code>a <b>x</b> y</code></pre><pre>plain</pre><a title="a>b" href="/w">1</a><a title="x href=y" href="/z">2</a><a href=/u/v?q=1>3</a><a HREF=\'/s\'>4</a>'
            '<!-- <a href="/hidden">h</a> --><script>var s = "<a href=/no>";</script><a name=n>5</a><a href="">6</a><a data-href="/d">7</a>')
    got = fields_of(spark, [page])[0]
    assert got["pre_code"] == ["a ", " y"] and got["pre_texts"] == ["plain"]
    df = spark.createDataFrame([(1, "https://h.io/a/b", page)], "page_id long, url string, html string")
    assert [r.href for r in X.links(df).orderBy("pos").collect()] == ["/w", "/z", "/u/v?q=1", "/s"]


@pytest.mark.parametrize("base", ["https://h.io/d1/d2/page", "https://h.io/d1/d2/", "https://h.io", "https://h.io/x?q=/a/../b#f"])
def test_links_are_resolved_like_urljoin(spark, base):
    hrefs = ["../up/x", "./here", "a/../b", "/abs/../c", "plain", "https://z.org/./k", "..", ".", "../..", "../../../../e", "a/./b/..", "/..", "/.", "./", "../?q=1", "a/../b#f/../g", "x/y",
             "//c.org/../y", "#f", "?z=1", "g/..//h"]
    df = spark.createDataFrame([(1, base, "".join(f'<a href="{h}">l</a>' for h in hrefs))], "page_id long, url string, html string")
    got = [r.link for r in X.links(df, resolve=True).orderBy("pos").collect()]
    assert got == [urljoin(base, h) for h in hrefs]


def test_page_extraction_runs_without_python(spark):
    plan = X.extract_resources(read_table(spark, SF01, "pages"), query="the")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_signal_names_of_all_rules(spark):
    page = ('<pre class="cobol x"><code class=fortran></code></pre><h1>A GUIDE</h1><h1>how to</h1><h1>Tutorial</h1><h2>introduction tutorial</h2><table class="mysyntax"></table>'
            '<div class="a compilers" id=content><main class="doc"></main></div><article></article>')
    got = set(fields_of(spark, [page])[0]["signals"])
    assert got == set(walk_one(page)["signals"]) and len(got) >= 14
    assert got <= {E.signal_name(k, v) for k, v in rules.STRUCTURE_SIGNALS_BROAD + rules.STRUCTURE_SIGNALS_NARROW}
