"""Each branch of the rule cascades on hand-made rows (the generated data reaches few)."""

from pyspark.sql import functions as F

from ferret.operators import classify as D
from ferret.operators import predicates as C


def _one(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_should_follow_broad_cascade(spark):
    urls = ["ftp://x.org/a", "https://x.org/a.zip", "https://x.org/the-query", "https://github.com/a",
            "https://x.org/tutorial/checkout", "https://x.org/checkout", "https://x.org/plain", None]
    got = _one(spark, C.should_follow_broad("u", "Query"), [(u,) for u in urls], "u string")
    assert got == [False, False, True, True, True, False, True, False]


def test_should_follow_narrow_empty_list_is_false(spark):
    rows = [("https://docs.example.com/tutorial",)]
    assert _one(spark, C.should_follow_narrow("u"), rows, "u string") == [False]
    assert _one(spark, C.should_follow_narrow("u", ["example.com"]), rows, "u string") == [True]


def test_live_filter_null_language_is_no_match(spark):
    rows = [(None, "click"), ("EN", "Click"), ("fr", "click")]
    got = _one(spark, C.live_filter("l", "t", "en", "CLICK"), rows, "l string, t string")
    assert got == [False, True, False]


def test_all_terms_and_score(spark):
    df = spark.createDataFrame([("aaaa bb", "aa  bb"), ("x", "x y")], "t string, q string")
    got = df.select(C.all_terms("t", "q"), C.term_count_score("t", "q")).collect()
    assert [tuple(r) for r in got] == [(True, 3), (False, 1)]


def test_resource_type_branches(spark):
    rows = [("A Guide", "x.org", "https://x.org/"), ("Video", "x.org", "https://x.org/"),
            ("t", "youtube.com", "https://youtube.com/"), ("Docs", "docs.x.org", "https://docs.x.org/"),
            ("Reference", "x.org", "https://x.org/"), ("t", "github.com", "https://x.org/github.com/r"),
            ("t", "x.org", "https://x.org/reference/a"), ("t", "x.org", "https://x.org/how-to"),
            ("t", "x.org", "https://x.org/")]
    broad = _one(spark, D.resource_type("t", "d", "u"), rows, "t string, d string, u string")
    narrow = _one(spark, D.resource_type("t", "d", "u", broad=False), rows, "t string, d string, u string")
    assert broad == ["tutorial", "video", "video", "documentation", "documentation", "repository",
                     "documentation", "tutorial", "article"]
    assert narrow[4] == "article"


def test_quality_processor_thresholds(spark):
    def py(content_len, n_snip, desc_len, url):
        s = 0
        if content_len > 5000:
            s += 3
        elif content_len > 1000:
            s += 2
        elif content_len > 500:
            s += 1
        s += min(n_snip, 3)
        s += 2 if desc_len > 100 else (1 if desc_len > 50 else 0)
        s += 3 if any(x in url for x in ["github.com", "stackoverflow.com", "docs.python.org"]) else 0
        return min(s / 10, 1.0)
    cases = [(500, 0, 50, "x"), (501, 1, 51, "x"), (1000, 5, 100, "x"), (1001, 3, 101, "x"),
             (2001, 0, 0, "https://github.com"), (5001, 5, 101, "https://docs.python.org")]
    rows = [("c" * c, ["s"] * n, "d" * d, u) for c, n, d, u in cases]
    got = _one(spark, D.quality_processor("c", "s", "d", "u"), rows,
               "c string, s array<string>, d string, u string")
    assert got == [py(*c) for c in cases]


def test_quality_broad_and_narrow(spark):
    rows = [("github.com", ["a"] * 5, "x" * 5001), ("ibm.com", [], "x" * 2001), ("a.b", [], None)]
    got = _one(spark, D.quality_broad("d", "s", "c", "cobol"), rows, "d string, s array<string>, c string")
    assert [round(g, 6) for g in got] == [1.0, 1.0, 0.5]
    rows = [(["a"], "d" * 250, "k", "https://github.com/x"), ([], None, None, "x")]
    got = _one(spark, D.quality_narrow("s", "d", "t", "u"), rows,
               "s array<string>, d string, t string, u string")
    assert got == [(1 + 0.5 + 1 + 0.5) / 4, 0.0]


def test_detect_languages_broad_append_and_body(spark):
    rows = [("Learn Rust", "fast", "body python"), ("x", "y", "body has ruby")]
    got = _one(spark, D.detect_languages_broad("t", "d", "b", "Kotlin"), rows, "t string, d string, b string")
    assert got[0][-1] == "kotlin" and "rust" in got[0]
    assert "ruby" in got[1] and got[1][-1] == "kotlin"


def test_detect_language_groups_then_snippets(spark):
    rows = [("https://x.org", "Django tips", "", None, []),
            ("https://x.org", "t", "d", None, ["use cargo"]),
            ("https://x.org", "t", "d", "golang,x", []),
            ("https://x.org", "t", "d", None, [])]
    got = _one(spark, D.detect_language("u", "t", "d", "g", "s"), rows,
               "u string, t string, d string, g string, s array<string>")
    assert got == ["python", "rust", "go", "unknown"]
