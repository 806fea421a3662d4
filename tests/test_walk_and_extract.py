"""HTML walk and page extraction on hand-made pages."""

from tests.html_walk import walk_one
from ferret.operators import extract as X

PAGE = ("<html><head><title> My  Tutorial </title>"
        '<meta name="description" content="">'
        '<meta name="keywords" content="python,code"></head><body>'
        "<nav><a href='/x'>n</a></nav>"
        "<p><b>bold</b> tail<p>second &amp; more<p>third</p><p>fourth</p>"
        "<div class='content'>  </div><article><h1>A Guide</h1>direct</article>"
        "<pre><code>print(1)</code></pre><pre>cobol here</pre>"
        "<h2>Introduction</h2></body></html>")


def test_walk_direct_text_and_implied_p():
    w = walk_one(PAGE)
    assert w["p_texts"][:3] == [" tail", "second & more", "third"]
    assert w["pre_code"] == ["print(1)"]
    assert w["pre_texts"] == ["cobol here"]
    assert w["content_broad"] == "direct"          # article comes first in the list
    assert "tag:pre" in w["signals"] and "heading:h1:guide" in w["signals"]
    assert "heading:h2:introduction" in w["signals"]


def test_whitespace_only_text_counts_for_selector():
    w = walk_one("<body><div class='content'> </div><main>m</main></body>",
                 selectors_broad=[".content", "main"])
    assert w["content_broad"] == " "


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_extract_broad_fields(spark):
    p = _pages(spark, [(1, "https://github.com/u/tutorial", PAGE)])
    r = X.extract_resources(p, query="tutorial").first()
    assert r.title == "My Tutorial"
    assert r.description == "tail second & more third"   # meta empty -> first three <p>
    assert r.tags == "python,code"
    assert r.type == "tutorial"
    assert r.code_snippets == ["print(1)"]
    assert r.languages[-1] == "tutorial"                # query appended
    assert abs(r.quality_score - 0.75) < 1e-9           # 0.5 + 0.2 github.com + 0.05 one snippet


def test_extract_drops_pages_without_description(spark):
    p = _pages(spark, [(2, "https://a.b/tutorial", "<html><head><title>T</title></head><body></body></html>")])
    assert X.extract_resources(p).count() == 0


def test_legacy_query_moves_first_and_pre_snippets(spark):
    html = ("<html><head><title>cobol cobol</title><meta name='x'></head><body>"
            "<p>java text cobol</p><pre>COBOL code</pre><pre>other</pre></body></html>")
    p = _pages(spark, [(3, "https://x.org/cobol", html)])
    r = X.extract_resources(p, query="cobol").first()
    assert r.languages[0] == "cobol"
    assert r.code_snippets == ["COBOL code"]


def test_links_resolution(spark):
    html = ("<a href='https://a.com/x'>1</a><a href=\"//cdn.org/y\">2</a><a href=\"/root\">3</a>"
            "<a href=\"#f\">4</a><a href=\"?q=1\">5</a><a href=\"rel/p\">6</a>")
    html = html.replace("'", '"')
    p = _pages(spark, [(1, "https://h.io/dir/page?x=1#top", html)])
    got = [r.link for r in X.links(p, resolve=True).orderBy("pos").collect()]
    from urllib.parse import urljoin
    base = "https://h.io/dir/page?x=1#top"
    assert got == [urljoin(base, h) for h in ["https://a.com/x", "//cdn.org/y", "/root", "#f", "?q=1", "rel/p"]]


def test_dot_segment_links_use_urljoin(spark):
    from urllib.parse import urljoin
    hrefs = ["../up/x", "./here", "a/../b", "/abs/../c", "plain", "https://z.org/./k"]
    html = "".join(f'<a href="{h}">l</a>' for h in hrefs)
    base = "https://h.io/d1/d2/page"
    p = _pages(spark, [(1, base, html)])
    got = {r.pos: r.link for r in X.links(p, resolve=True).collect()}
    assert [got[i] for i in range(len(hrefs))][:4] == [urljoin(base, h) for h in hrefs[:4]]
    assert got[4] == urljoin(base, "plain") and got[5] == "https://z.org/./k"
