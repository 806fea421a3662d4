"""Native HTML fields against hand-written values."""

from ferret.functions import elements as E
from ferret.functions import html as H
from ferret.operators import extract as X

PAGE = ("<html><head><title>A &mdash; B&#8217;s</title><meta name='keywords' content='x, &quot;y&quot;'>"
        "<meta content=plain name=description></head><body><!-- <a href='/no'>x</a> --><h1><b>Child</b> own <i>x</i></h1>"
        "<a href=\"/one\">1</a><a class=c href='/two?a=1&amp;b=2'>2</a><a href=three>3</a><a data-href='/no'>4</a>"
        "&copy; &#x41; &amp;lt; &unknown;</body></html>")


def test_fields(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<head><title>T</title></head><p>no body &lt;tag&gt;</p>"), (3, None), (4, "")], "page_id long, html string")
    got = {r.page_id: r for r in df.select("page_id", X.title("html").alias("title"), H.own_text("html", "h1").alias("h1"), X.tags("html").alias("tags"),
                                           X.meta_description("html").alias("description"), E.hrefs("html").alias("hrefs"),
                                           X.body_text("html").alias("body")).collect()}
    assert got[1].title == "A — B’s" and got[1].h1 == " own " and got[1].tags == 'x, "y"' and got[1].description == "plain"
    assert got[1].hrefs == ["/one", "/two?a=1&b=2", "three"]
    assert got[1].body.endswith("© a &lt; &unknown;") and "/no" not in got[1].body
    assert got[2].body == "no body <tag>" and got[2].h1 is None and got[2].hrefs == []
    assert got[3].body is None and got[4].body == "" and got[4].title is None
