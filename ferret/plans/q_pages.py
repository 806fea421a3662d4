"""Driver queries for page extraction (B), predicates (C) and classification (D).

Page queries run over the widened pages fixture (every page kept, fragments
appended so rule branches the raw pages never reach are exercised).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import html as H
from ..functions.text import clean_text, squeeze_ws
from ..operators import classify as D
from ..operators import extract as X
from ..operators import predicates as C
from ..sources import adapters as A
from ..sources.tables import read_table
from . import oracle as O
from .catalog import register

QUERY = "the"          # a word the generated pages and documents contain
LEGACY_QUERY = "cobol"  # a legacy name: exercises the reordering and legacy tests


def wide_pages(spark, sf_dir):
    return A.widen_pages(read_table(spark, sf_dir, "pages"))


def doc_res(spark, sf_dir):
    return A.read_doc_resources(spark, sf_dir)


# ---------------------------------------------------------------- B

@register("b01_title", O.with_(O.WIDE_PAGES) + f"""
SELECT page_id, {O.squeeze(O.title('html'))} AS title FROM wpages""")
def b01_title(spark, sf_dir):
    return wide_pages(spark, sf_dir).select("page_id", squeeze_ws(X.title("html")).alias("title"))


@register("b02_description", O.with_tree(O.WIDE_PAGES, O.tree()) + f"""
SELECT page_id, {O.squeeze('desc_raw')} AS description FROM pd""")
def b02_description(spark, sf_dir):
    a = X.analyse_pages(wide_pages(spark, sf_dir))
    return a.select("page_id", squeeze_ws(X.description("meta_description", "p_texts"))
                    .alias("description"))


@register("b02_meta_description", O.with_(O.WIDE_PAGES) + f"""
SELECT page_id, {O.meta_content('html', 'description')} AS meta_description FROM wpages""")
def b02_meta_description(spark, sf_dir):
    return wide_pages(spark, sf_dir).select("page_id", X.meta_description("html")
                                            .alias("meta_description"))


@register("b03_drop_unusable", O.with_tree(O.WIDE_PAGES, O.tree()) + f"""
SELECT page_id FROM pd WHERE {O.USABLE}""")
def b03_drop_unusable(spark, sf_dir):
    a = X.analyse_pages(wide_pages(spark, sf_dir))
    d = X.description("meta_description", "p_texts")
    return a.where(X.usable("title_raw", d)).select("page_id")


@register("b04_squeeze_ws", O.with_("d AS (SELECT doc_id, " + O.squeeze("text") + " AS s FROM documents)")
          + """
SELECT doc_id, length(s) AS n_chars, md5(s) AS digest FROM d""")
def b04_squeeze_ws(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", squeeze_ws("text").alias("s"))
    return d.select("doc_id", F.length("s").alias("n_chars"), F.md5("s").alias("digest"))


@register("b05_domain", O.with_(O.WIDE_PAGES) + f"""
SELECT page_id, {O.netloc('url')} AS domain FROM wpages""")
def b05_domain(spark, sf_dir):
    return wide_pages(spark, sf_dir).select("page_id", X.domain("url").alias("domain"))


@register("b06_main_content", O.with_tree(O.VARIED_PAGES, O.tree("vpages")) + """
SELECT page_id, length(content_broad) AS broad_len, md5(content_broad) AS broad_digest, length(content_narrow) AS narrow_len FROM pf""")
def b06_main_content(spark, sf_dir):
    a = X.analyse_pages(A.varied_pages(read_table(spark, sf_dir, "pages")))
    return a.select("page_id", F.length("content_broad").alias("broad_len"),
                    F.md5("content_broad").alias("broad_digest"),
                    F.length("content_narrow").alias("narrow_len"))


@register("b07_code_snippets", O.with_tree(O.WIDE_PAGES, O.tree()) + """
SELECT page_id, len(pre_code) AS n_snippets, array_to_string(pre_code, '|') AS snippets FROM pf""")
def b07_code_snippets(spark, sf_dir):
    a = X.analyse_pages(wide_pages(spark, sf_dir))
    return a.select("page_id", F.size("pre_code").alias("n_snippets"), F.array_join("pre_code", "|").alias("snippets"))


#: Some pages get plain <pre> blocks, half of them with the legacy query.
PRE_SQL = """,
prep AS (SELECT page_id, url, html || CASE WHEN page_id % 8 < 4 THEN '<pre>IDENTIFICATION <b>Cobol</b> DIVISION cobol</pre><pre>other</pre>' ELSE '' END AS html FROM wpages)"""


@register("b08_legacy_pre_snippets", O.with_tree(O.WIDE_PAGES + PRE_SQL, O.tree("prep")) + """
SELECT page_id, array_to_string(CASE WHEN len(pre_code) = 0 THEN list_filter(pre_texts, lambda x: contains(lower(x), 'cobol')) ELSE pre_code END, '|') AS snippets FROM pf""")
def b08_legacy_pre_snippets(spark, sf_dir):
    p = wide_pages(spark, sf_dir)
    more = F.when(F.col("page_id") % 8 < 4, F.lit("<pre>IDENTIFICATION <b>Cobol</b> DIVISION cobol</pre><pre>other</pre>")).otherwise(F.lit(""))
    a = X.analyse_pages(p.withColumn("html", F.concat("html", more)))
    return a.select("page_id", F.array_join(X.legacy_pre_snippets("pre_code", "pre_texts", LEGACY_QUERY), "|").alias("snippets"))


@register("b09_tags", O.with_(O.WIDE_PAGES) + f"""
SELECT page_id, {O.meta_content('html', 'keywords')} AS tags FROM wpages""")
def b09_tags(spark, sf_dir):
    return wide_pages(spark, sf_dir).select("page_id", X.tags("html").alias("tags"))


@register("b10_body_text", O.with_(O.WIDE_PAGES) + f"""
SELECT page_id, length(b) AS n_chars, md5(b) AS digest
FROM (SELECT page_id, {O.body_text('html')} AS b FROM wpages)""")
def b10_body_text(spark, sf_dir):
    p = wide_pages(spark, sf_dir).select("page_id", X.body_text("html").alias("b"))
    return p.select("page_id", F.length("b").alias("n_chars"), F.md5("b").alias("digest"))


@register("b11_links", O.with_(O.WIDE_PAGES) + f"""
SELECT page_id, pos, href, {O.resolve_url('url', 'href')} AS link
FROM (SELECT page_id, url, unnest(h) AS href, unnest(range(len(h))) AS pos
      FROM (SELECT page_id, url, {O.hrefs('html')} AS h FROM wpages))""")
def b11_links(spark, sf_dir):
    return X.links(wide_pages(spark, sf_dir), resolve=True).select("page_id", "pos", "href", "link")


@register("b12_clean_text", O.with_("d AS (SELECT doc_id, " + O.clean_text("text") + " AS s FROM documents)")
          + """
SELECT doc_id, length(s) AS n_chars, md5(s) AS digest FROM d""")
def b12_clean_text(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", clean_text("text").alias("s"))
    return d.select("doc_id", F.length("s").alias("n_chars"), F.md5("s").alias("digest"))


def _resource_view(df):
    return df.select("doc_id", "url", "title", "description", "type",
                     F.array_join("languages", ",").alias("languages"),
                     F.round("quality_score", 6).alias("quality_score"),
                     F.size("code_snippets").alias("n_snippets"),
                     F.length("content").alias("content_len"), "tags", "domain")


@register("b13_extract_broad", O.with_tree(O.WIDE_PAGES, O.tree()) + "," + O.extraction(QUERY, "broad"))
def b13_extract_broad(spark, sf_dir):
    return _resource_view(X.extract_resources(wide_pages(spark, sf_dir), query=QUERY))


@register("b13_extract_broad_legacy", O.with_tree(O.WIDE_PAGES, O.tree()) + "," + O.extraction(LEGACY_QUERY, "broad"))
def b13_extract_broad_legacy(spark, sf_dir):
    return _resource_view(X.extract_resources(wide_pages(spark, sf_dir), query=LEGACY_QUERY))


@register("b13_extract_narrow", O.with_tree(O.WIDE_PAGES, O.tree()) + "," + O.extraction(None, "narrow"))
def b13_extract_narrow(spark, sf_dir):
    return _resource_view(X.extract_resources(wide_pages(spark, sf_dir), mode="narrow"))


# ---------------------------------------------------------------- C

def _all_links_sql():
    return O.with_(O.WIDE_PAGES, f"""
links AS (
  SELECT page_id, pos, href, {O.resolve_url('url', 'href')} AS link FROM (
    SELECT page_id, url, unnest(h) AS href, unnest(range(len(h))) AS pos
    FROM (SELECT page_id, url, {O.hrefs('html')} AS h FROM wpages))
  UNION ALL SELECT page_id, -1 AS pos, url AS href, url AS link FROM wpages
)""")


def _all_links(spark, sf_dir):
    p = wide_pages(spark, sf_dir)
    l = X.links(p, resolve=True).select("page_id", "pos", "href", "link")
    own = p.select("page_id", F.lit(-1).alias("pos"), F.col("url").alias("href"),
                   F.col("url").alias("link"))
    return l.unionByName(own)


@register("c01_should_follow_broad", _all_links_sql() + f"""
SELECT page_id, pos, href, {O.should_follow_broad('href', QUERY)} AS follow FROM links""")
def c01_should_follow_broad(spark, sf_dir):
    l = _all_links(spark, sf_dir)
    return l.select("page_id", "pos", "href", C.should_follow_broad("href", QUERY).alias("follow"))


@register("c02_should_follow_narrow", _all_links_sql() + f"""
SELECT page_id, pos, link, {O.should_follow_narrow('link', rules.ALLOWED_DOMAINS)} AS follow,
       {O.should_follow_narrow('link', ['example.com', 'github.com'])} AS follow_allowed
FROM links""")
def c02_should_follow_narrow(spark, sf_dir):
    l = _all_links(spark, sf_dir)
    return l.select("page_id", "pos", "link", C.should_follow_narrow("link").alias("follow"),
                    C.should_follow_narrow("link", ["example.com", "github.com"])
                    .alias("follow_allowed"))


@register("c03_is_resource_page_broad", O.with_tree(O.VARIED_PAGES, O.tree("vpages")) + f"""
SELECT page_id, {O.is_resource_page_broad(LEGACY_QUERY)} AS is_resource, array_to_string(signals, ',') AS signals FROM pf""")
def c03_is_resource_page_broad(spark, sf_dir):
    a = X.analyse_pages(A.varied_pages(read_table(spark, sf_dir, "pages")))
    ok = C.is_resource_page_broad("url", "signals", "tags", "meta_description",
                                  F.coalesce("title_only", F.lit("")), F.array_join("h1_texts", " "),
                                  F.array_join("h2_texts", " "), "body_text", LEGACY_QUERY)
    return a.select("page_id", ok.alias("is_resource"), F.array_join("signals", ",").alias("signals"))


@register("c03_native_signals", O.with_(O.WIDE_PAGES) + f"""
SELECT page_id,
       {O.contains_any_hof(f"lower(coalesce(url, ''))", rules.VALUABLE_URL_PATTERNS)} AS url_word,
       ({O.contains_any_hof(f"lower(coalesce({O.meta_content('html', 'keywords')}, ''))", rules.TECH_KEYWORDS)}
        OR {O.contains_any_hof(f"lower(coalesce({O.meta_content('html', 'description')}, ''))", rules.TECH_KEYWORDS)}) AS meta_word,
       coalesce({O.count_occ(O.body_text('html'), "'cobol'")} >= 2, FALSE) AS legacy_dense,
       ({' + '.join(f"CASE WHEN contains({O.body_text('html')}, {O.lit(w)}) THEN 1 ELSE 0 END" for w in rules.LEGACY_VOCABULARY['cobol'])}) >= 3
         AS legacy_vocab
FROM wpages""")
def c03_native_signals(spark, sf_dir):
    p = wide_pages(spark, sf_dir)
    return p.select("page_id", C.url_has_valuable_word("url").alias("url_word"),
                    C.meta_has_tech_word(X.tags("html"), X.meta_description("html")).alias("meta_word"),
                    C.legacy_dense(X.body_text("html"), LEGACY_QUERY).alias("legacy_dense"),
                    C.legacy_vocabulary(X.body_text("html"), LEGACY_QUERY).alias("legacy_vocab"))


@register("c04_is_resource_page_narrow", O.with_tree(O.VARIED_PAGES, O.tree("vpages")) + f"""
SELECT page_id, {O.is_resource_page_narrow()} AS is_resource FROM pf""")
def c04_is_resource_page_narrow(spark, sf_dir):
    a = X.analyse_pages(A.varied_pages(read_table(spark, sf_dir, "pages")))
    return a.select("page_id", C.is_resource_page_narrow(F.coalesce("title_only", F.lit("")),
                                                         "signals").alias("is_resource"))


@register("c05_relevance_gate_broad", O.with_(O.RESOURCES) + f"""
SELECT doc_id FROM res
WHERE contains(lower(concat_ws(' ', title, description)), {O.lit(QUERY)})
   OR contains(coalesce(lower(content), ''), {O.lit(QUERY)})""")
def c05_relevance_gate_broad(spark, sf_dir):
    r = doc_res(spark, sf_dir)
    return r.where(C.relevance_gate_broad("title", "description", F.lower("content"), QUERY)) \
        .select("doc_id")


@register("c06_relevance_gate_narrow", O.with_(O.RESOURCES) + f"""
SELECT doc_id FROM res WHERE contains(lower(concat_ws(' ', title, description)), {O.lit(QUERY)})""")
def c06_relevance_gate_narrow(spark, sf_dir):
    r = doc_res(spark, sf_dir)
    return r.where(C.relevance_gate_narrow("title", "description", QUERY)).select("doc_id")


@register("c07_term_filter", O.with_(O.RESOURCES) + """
SELECT doc_id, url FROM res WHERE coalesce(type = 'video', FALSE)""")
def c07_term_filter(spark, sf_dir):
    return doc_res(spark, sf_dir).where(C.term_filter("type", "video")).select("doc_id", "url")


@register("c08_language_filter", O.with_(O.RESOURCES) + """
SELECT doc_id FROM res WHERE coalesce(language = 'fr' OR list_contains(languages, 'fr'), FALSE)""")
def c08_language_filter(spark, sf_dir):
    return doc_res(spark, sf_dir).where(C.language_filter("fr")).select("doc_id")


EVENTS_FEED = """
feed AS (
  SELECT event_id, 'https://u.example.com/' || CAST(user_id AS VARCHAR) AS url,
         'event ' || event_type AS title, props AS description, event_type AS type,
         CASE WHEN value >= 10 THEN 'EN' WHEN value >= 5 THEN 'fr' END AS language,
         CAST(ts AS TIMESTAMP) AS timestamp, value
  FROM events
)"""


@register("c09_live_filter", O.with_(EVENTS_FEED) + """
SELECT event_id FROM feed
WHERE lower(coalesce(language, '')) = 'en' AND lower(coalesce(type, '')) = 'click'""")
def c09_live_filter(spark, sf_dir):
    f = A.events_feed(read_table(spark, sf_dir, "events"))
    return f.where(C.live_filter("language", "type", "en", "CLICK")).select("event_id")


STANDING = "The of"


@register("c10_all_terms", O.with_(O.RESOURCES) + f"""
SELECT doc_id, score FROM (
  SELECT doc_id, h,
         CAST(list_sum(list_transform({O.query_words(O.lit(STANDING))}, lambda t: {O.count_occ('h', 't')})) AS BIGINT) AS score
  FROM (SELECT doc_id, lower(concat_ws(' ', title, description)) AS h FROM res))
WHERE len(list_filter({O.query_words(O.lit(STANDING))}, lambda t: NOT contains(h, t))) = 0""")
def c10_all_terms(spark, sf_dir):
    r = doc_res(spark, sf_dir).select("doc_id", F.lower(F.concat_ws(" ", "title", "description"))
                                      .alias("h"))
    q = F.lit(STANDING)
    return r.where(C.all_terms("h", q)).select("doc_id", C.term_count_score("h", q).alias("score"))


# ---------------------------------------------------------------- D

@register("d01_detect_languages_broad", O.with_(O.RESOURCES) + f"""
SELECT doc_id, array_to_string({O.detect_languages_broad('title', 'description', 'lower(content)', LEGACY_QUERY)}, ',')
         AS languages
FROM res""")
def d01_detect_languages_broad(spark, sf_dir):
    r = doc_res(spark, sf_dir).withColumn("_body", F.lower("content"))
    r = D.with_languages_broad(r, "title", "description", "_body", LEGACY_QUERY)
    return r.select("doc_id", F.array_join("languages", ",").alias("languages"))


@register("d02_detect_languages_narrow", O.with_(O.RESOURCES) + f"""
SELECT doc_id, array_to_string({O.detect_languages_narrow('title', 'description')}, ',') AS languages
FROM res""")
def d02_detect_languages_narrow(spark, sf_dir):
    r = doc_res(spark, sf_dir)
    return r.select("doc_id", F.array_join(D.detect_languages_narrow("title", "description"), ",")
                    .alias("languages"))


@register("d03_detect_language", O.with_(O.RESOURCES) + f"""
SELECT doc_id, {O.detect_language('url', 'title', 'description', 'tags', '[content]')} AS language
FROM res""")
def d03_detect_language(spark, sf_dir):
    r = doc_res(spark, sf_dir)
    return r.select("doc_id", D.detect_language("url", "title", "description", "tags",
                                                F.array("content")).alias("language"))


@register("d04_resource_type_broad", O.with_(O.WIDE_PAGES) + f"""
SELECT page_id, {O.resource_type(O.squeeze(O.title('html')), O.netloc('url'), 'url')} AS type
FROM wpages""")
def d04_resource_type_broad(spark, sf_dir):
    p = wide_pages(spark, sf_dir)
    return p.select("page_id", D.resource_type(squeeze_ws(X.title("html")), X.domain("url"), "url")
                    .alias("type"))


@register("d05_resource_type_narrow", O.with_(O.WIDE_PAGES) + f"""
SELECT page_id, {O.resource_type(O.squeeze(O.title('html')), O.netloc('url'), 'url', broad=False)} AS type
FROM wpages""")
def d05_resource_type_narrow(spark, sf_dir):
    p = wide_pages(spark, sf_dir)
    return p.select("page_id", D.resource_type(squeeze_ws(X.title("html")), X.domain("url"), "url",
                                               broad=False).alias("type"))


@register("d06_quality_processor", O.with_(O.RESOURCES) + f"""
SELECT doc_id, round({O.quality_processor('content', '[content]', 'description', 'url')}, 6) AS quality
FROM res""")
def d06_quality_processor(spark, sf_dir):
    r = doc_res(spark, sf_dir)
    return r.select("doc_id", F.round(D.quality_processor("content", F.array("content"),
                                                          "description", "url"), 6).alias("quality"))


@register("d07_quality_broad", O.with_(O.RESOURCES) + f"""
SELECT doc_id, round({O.quality_broad('domain', 'code_snippets', 'content', LEGACY_QUERY)}, 6) AS quality
FROM res""")
def d07_quality_broad(spark, sf_dir):
    r = doc_res(spark, sf_dir)
    return r.select("doc_id", F.round(D.quality_broad("domain", "code_snippets", "content",
                                                      LEGACY_QUERY), 6).alias("quality"))


@register("d08_quality_narrow", O.with_(O.RESOURCES) + f"""
SELECT doc_id, round({O.quality_narrow('code_snippets', 'description', 'tags', 'url')}, 6) AS quality
FROM res""")
def d08_quality_narrow(spark, sf_dir):
    r = doc_res(spark, sf_dir)
    return r.select("doc_id", F.round(D.quality_narrow("code_snippets", "description", "tags", "url"),
                                      6).alias("quality"))


@register("d09_primary_language", O.with_(O.RESOURCES) + """
SELECT doc_id, coalesce(language, languages[1]) AS language FROM res""")
def d09_primary_language(spark, sf_dir):
    return doc_res(spark, sf_dir).select("doc_id", D.primary_language().alias("language"))


@register("d10_default_quality", O.with_(O.RESOURCES) + """
SELECT doc_id, coalesce(quality_score, CAST(0.7 AS DOUBLE)) AS quality_score FROM res""")
def d10_default_quality(spark, sf_dir):
    return doc_res(spark, sf_dir).select("doc_id", D.default_quality().alias("quality_score"))


STAMP = "2024-02-01 12:00:00"


@register("d11_stamp", O.with_(O.RESOURCES) + f"""
SELECT doc_id, TIMESTAMP '{STAMP}' AS indexed_date FROM res""")
def d11_stamp(spark, sf_dir):
    return doc_res(spark, sf_dir).select("doc_id", D.stamp(STAMP).alias("indexed_date"))


@register("d12_resource_id", O.with_(O.WIDE_PAGES) + """
SELECT page_id, md5(url) AS resource_id FROM wpages""")
def d12_resource_id(spark, sf_dir):
    return wide_pages(spark, sf_dir).select("page_id", D.resource_id("url").alias("resource_id"))


FIXED_AT = "2024-02-01 00:00:00"


@register("d13_enrich_resources", O.with_(O.RESOURCES, f"""
enr AS (SELECT doc_id, url, title, description, tags, code_snippets, {O.clean_text('content')} AS content
        FROM res)""") + f"""
SELECT doc_id, md5(url) AS resource_id, md5(content) AS content_digest,
       {O.detect_language('url', 'title', 'description', 'tags', 'code_snippets')} AS language,
       round({O.quality_processor('content', 'code_snippets', 'description', 'url')}, 6) AS quality_score,
       '{FIXED_AT}' AS indexed_date
FROM enr""")
def d13_enrich_resources(spark, sf_dir):
    e = D.enrich_resources(doc_res(spark, sf_dir), at=FIXED_AT)
    return e.select("doc_id", "resource_id", F.md5("content").alias("content_digest"), "language",
                    F.round("quality_score", 6).alias("quality_score"),
                    F.date_format("indexed_date", "yyyy-MM-dd HH:mm:ss").alias("indexed_date"))
