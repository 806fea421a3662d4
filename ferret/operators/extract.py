"""Page extraction (B1-B13): pages (page_id, url, html) -> resource rows.

Single-tag fields are regex expressions (functions.html), tree-dependent ones come from a fold over the page's
tokens (functions.elements): one scan, no join, no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import elements as E
from ..functions import html as H
from ..functions.text import bind_once, clean_text, col_, html_unescape, netloc, squeeze_ws
from . import classify as D
from .common import spread
from . import predicates as C


def title(html="html") -> Column:
    """B1: first <title> text, else first <h1> text."""
    return F.coalesce(H.first_tag_text(html, "title"), H.own_text(html, "h1"))


def meta_description(html="html") -> Column:
    return H.meta_content(html, "description")


def description(meta_desc, p_texts) -> Column:
    """B2: meta description when non-empty, else the first three <p> direct texts."""
    fallback = F.array_join(F.slice(F.coalesce(col_(p_texts), F.array().cast("array<string>")),
                                    1, 3), " ")
    return F.when(F.coalesce(col_(meta_desc), F.lit("")) != "", col_(meta_desc)).otherwise(fallback)


def usable(title_col, desc_col) -> Column:
    """Title and description both present and non-empty (before squeezing)."""
    return (F.coalesce(col_(title_col), F.lit("")) != "") & \
        (F.coalesce(col_(desc_col), F.lit("")) != "")


def domain(url="url") -> Column:
    """B5."""
    return netloc(url)


def tags(html="html") -> Column:
    """Meta keywords."""
    return H.meta_content(html, "keywords")


def body_text(html="html") -> Column:
    """B10."""
    return H.body_text(html)


def legacy_pre_snippets(snippets, pre_texts, query: str | None) -> Column:
    """For five legacy queries, when there are no code snippets, <pre> texts that
    contain the query."""
    if not query or query.lower() not in rules.LEGACY_PRE_QUERIES:
        return col_(snippets)
    q = query.lower()
    fallback = F.filter(F.coalesce(col_(pre_texts), F.array().cast("array<string>")),
                        lambda p: F.lower(p).contains(q))
    return F.when(F.size(col_(snippets)) == 0, fallback).otherwise(col_(snippets))


def links(pages: DataFrame, resolve: bool = False) -> DataFrame:
    """(page_id, src_url, href, link) for every href; ``link`` is the raw value
    (standalone crawler) or the value resolved against the page URL (distributed)."""
    l = pages.select("page_id", F.col("url").alias("src_url"),
                     F.posexplode(E.hrefs("html")).alias("pos", "href"))
    link = resolve_url(F.col("src_url"), F.col("href")) if resolve else F.col("href")
    return l.select("page_id", "src_url", "pos", "href", link.alias("link"))


DOT_SEGMENT = r"(^|/)\.\.?(/|$|[?#])"


def has_dot_segments(href) -> Column:
    """A relative reference (no scheme, not '//') whose path has '.' or '..' segments."""
    h = F.trim(col_(href))
    return F.coalesce(~h.rlike(r"^([a-zA-Z][a-zA-Z0-9+.-]*:|//)") & h.rlike(DOT_SEGMENT), F.lit(False))


def without_dots(base, href) -> Column:
    """A reference with '.' or '..' in its path, resolved as ``urljoin`` does: the segments are folded from the left, '..'
    takes the one before away."""
    b, h = col_(base), F.trim(col_(href))
    origin = F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    base_path = F.split(F.regexp_extract(b, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/", -1)
    path = F.regexp_extract(h, r"^([^?#]*)", 1)
    rest = F.regexp_extract(h, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.when(F.element_at(base_path, -1) == "", base_path).otherwise(F.slice(base_path, 1, F.size(base_path) - 1))
    merged = bind_once(F.concat(folder, F.split(path, "/", -1)), lambda m: F.filter(m, lambda x, i: (i == 0) | (i == F.size(m) - 1) | (x != "")))
    segments = F.when(path.startswith("/"), F.split(path, "/", -1)).otherwise(merged)

    def step(done, x):
        return F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))

    def joined(all_):
        kept = F.aggregate(all_, F.array().cast("array<string>"), step)
        ended = F.when(F.element_at(all_, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
        return F.array_join(ended, "/")

    out = bind_once(segments, joined)
    return F.concat(origin, F.when(out == "", "/").otherwise(F.when(out.startswith("/"), out).otherwise(F.concat(F.lit("/"), out))), rest)


def resolve_url(base, href) -> Column:
    """urljoin: absolute, scheme-relative, root-relative, fragment, query and relative references, with dot segments."""
    b, h = col_(base), F.trim(col_(href))
    scheme = F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    origin = F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    no_frag = F.regexp_extract(b, r"^([^#]*)", 1)
    no_query = F.regexp_extract(b, r"^([^?#]*)", 1)
    path = F.regexp_extract(b, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    dir_ = F.regexp_extract(path, r"^(.*/)", 1)
    return (F.when(has_dot_segments(h), without_dots(b, h))
            .when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), h)
            .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
            .when(h.startswith("/"), F.concat(origin, h))
            .when(h == "", no_frag)
            .when(h.startswith("#"), F.concat(no_frag, h))
            .when(h.startswith("?"), F.concat(no_query, h))
            .otherwise(F.concat(origin, F.when(dir_ == "", F.lit("/")).otherwise(dir_), h)))


def analyse_pages(pages: DataFrame) -> DataFrame:
    """The tree's fields and the single-tag ones, one row per page, in one stage (shared by both rule sets)."""
    walked = E.page_fields(spread(pages.select("page_id", "url", "html")))
    fields = walked.select(
        *[c for c in walked.columns if c != "html"],
        title("html").alias("title_raw"),
        H.first_tag_text("html", "title").alias("title_only"),
        meta_description("html").alias("meta_description"),
        tags("html").alias("tags"),
        body_text("html").alias("body_text"),
        domain("url").alias("domain"),
    )
    return once(fields)


def once(df: DataFrame) -> DataFrame:
    """``df``, each of its columns computed once: the rows pass through a generator of one row, below which Spark pushes no filter.
    Else every later filter would be moved below the projection and compute the fields it reads anew."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def extract_resources(pages: DataFrame, query: str | None = None, mode: str = "broad",
                      at: str | None = None) -> DataFrame:
    """Resource rows from pages, with the broad (standalone) or narrow (distributed)
    rules: page test -> fields -> drop unusable -> squeeze -> languages -> relevance gate ->
    content, snippets, tags, type, quality."""
    a = analyse_pages(pages)
    a = a.withColumn("desc_raw", description("meta_description", "p_texts"))
    h1 = F.array_join("h1_texts", " ")
    h2 = F.array_join("h2_texts", " ")
    if mode == "broad":
        title_only = F.coalesce(F.col("title_only"), F.lit(""))
        page_ok = C.is_resource_page_broad("url", "signals", "tags", "meta_description",
                                           title_only, h1, h2, "body_text", query)
    else:
        page_ok = C.is_resource_page_narrow(F.coalesce(F.col("title_only"), F.lit("")), "signals")
    a = a.where(page_ok & usable("title_raw", "desc_raw"))
    a = once(a.withColumn("title", squeeze_ws("title_raw")).withColumn("description", squeeze_ws("desc_raw")))
    if mode == "broad":
        a = D.with_languages_broad(a, "title", "description", "body_text", query)
        head = F.col("_head")
        gate = head.contains(query.lower()) | F.coalesce(F.col("body_text"), F.lit("")) \
            .contains(query.lower()) if query else F.lit(True)
        content = F.col("content_broad")
        snippets = legacy_pre_snippets(F.col("pre_code"), F.col("pre_texts"), query)
    else:
        a = a.withColumn("languages", D.detect_languages_narrow("title", "description"))
        gate = C.relevance_gate_narrow("title", "description", query)
        content = F.col("content_narrow")
        snippets = F.col("pre_code")
    a = a.where(gate).withColumn("content", content).withColumn("code_snippets", snippets)
    rtype = D.resource_type("title", "domain", "url", broad=(mode == "broad"))
    if mode == "broad":
        quality = D.quality_broad("domain", "code_snippets", "content", query)
    else:
        quality = D.quality_narrow("code_snippets", "description", "tags", "url")
    return a.select(
        F.col("page_id").alias("doc_id"), D.resource_id("url").alias("resource_id"), "url",
        "title", "description", "content", "code_snippets", "tags", "domain",
        rtype.alias("type"), "languages", F.lit(None).cast("string").alias("language"),
        D.stamp(at).alias("timestamp"), F.lit(None).cast("timestamp").alias("indexed_date"),
        quality.alias("quality_score"))


__all__ = ["title", "meta_description", "description", "usable", "squeeze_ws", "domain",
           "tags", "body_text", "legacy_pre_snippets", "links",
           "resolve_url", "clean_text", "html_unescape", "extract_resources", "analyse_pages"]
