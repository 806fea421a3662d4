"""Scalar expressions against Python's own string semantics (the reference's)."""

import hashlib
from urllib.parse import urlparse

from pyspark.sql import functions as F

from ferret import rules
from ferret.functions import text as T

SAMPLES = ["  a\tb\n c ", "x y", " lead", "", "no-space", "a\x0bb\x1cc", "ends 　"]


def test_rule_list_sizes():
    assert len(rules.QUERY_URL_TEMPLATES) == 111
    assert len(rules.FOLLOW_PRIORITY_DOMAINS) == 104
    assert len(rules.PROGRAMMING_PATHS) == 37
    assert len(rules.VALUABLE_URL_PATTERNS) == 37
    assert len(rules.TECH_KEYWORDS) == 45
    assert len(rules.LANGUAGES_BROAD) == 154
    assert len(rules.STRUCTURE_SIGNALS_BROAD) == 52
    assert len(rules.DEFAULT_START_URLS_BROAD) == 24
    assert len(rules.DEFAULT_START_URLS_DISTRIBUTED) == 24
    assert len(rules.RELEVANT_URL_PATTERNS) == 18


def test_squeeze_matches_python_split(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "s string")
    got = [r[0] for r in df.select(T.squeeze_ws("s")).collect()]
    assert got == [" ".join(s.split()) for s in SAMPLES]


def test_clean_text_order_and_null(spark):
    df = spark.createDataFrame([("<b>a</b>\n\n<i>b</i>",), (None,), ("<a\nhref='x'>t</a>",)], "s string")
    got = [r[0] for r in df.select(T.clean_text("s")).collect()]
    assert got == ["a b", "", "t"]


def test_count_occurrences_non_overlapping(spark):
    df = spark.createDataFrame([("aaaa", "aa"), ("abcabc", "bc"), ("x", "y")], "t string, w string")
    got = [r[0] for r in df.select(T.count_occurrences("t", F.col("w"))).collect()]
    assert got == ["aaaa".count("aa"), "abcabc".count("bc"), 0]


def test_netloc_keeps_port_and_userinfo(spark):
    urls = ["http://user:pw@host.com:8080/a?b#c", "https://x.org", "//cdn.net/p", "mailto:a@b", "/rel"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [r[0] for r in df.select(T.netloc("u")).collect()]
    assert got == [urlparse(u).netloc for u in urls]


def test_md5_hash(spark):
    df = spark.createDataFrame([("https://a.b/c",)], "u string")
    assert df.select(T.url_hash("u")).first()[0] == hashlib.md5(b"https://a.b/c").hexdigest()


def test_ordered_matches_keeps_list_order(spark):
    df = spark.createDataFrame([("java and python and c++",)], "t string")
    got = df.select(T.ordered_matches("t", rules.LANGUAGES_BROAD)).first()[0]
    expect = [w for w in rules.LANGUAGES_BROAD if w in "java and python and c++"]
    assert got == expect


def test_analyze_tokens(spark):
    df = spark.createDataFrame([("Héllo, wörld_1! x-y",)], "t string")
    assert df.select(T.analyze("t")).first()[0] == ["héllo", "wörld_1", "x", "y"]
