"""Driver queries for ranked search (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import analyze
from ..operators import search as S
from ..operators import stored_index as I
from ..session import scratch_dir
from ..sources import adapters as A
from . import oracle as O
from .catalog import register

# ---------------------------------------------------------------- search (E)

def _search_inputs(spark, sf_dir, **qkw):
    res = A.read_doc_resources(spark, sf_dir)
    qry = A.read_queries(spark, sf_dir, **qkw)
    return res, qry, S.build_search_tables(res)


@register("e01_analyze", O.with_(O.RESOURCES) + f"""
SELECT doc_id, len({O.tokens('content')}) AS n_content_tokens,
       array_to_string({O.tokens('title')}, ' ') AS title_tokens
FROM res""")
def e01_analyze(spark, sf_dir):
    r = A.read_doc_resources(spark, sf_dir)
    return r.select("doc_id", F.size(analyze("content")).alias("n_content_tokens"),
                    F.array_join(analyze("title"), " ").alias("title_tokens"))


@register("e02_term_stats", O.with_(O.RESOURCES, O.index()) + """
SELECT field, term, df, sum_tf FROM term_stats
JOIN (SELECT field, term, CAST(sum(tf) AS BIGINT) AS sum_tf FROM postings GROUP BY field, term) USING (field, term)""")
def e02_term_stats(spark, sf_dir):
    return S.term_totals(S.build_search_tables(A.read_doc_resources(spark, sf_dir)))


@register("e02_field_stats", O.with_(O.RESOURCES, O.index()) + """
SELECT field, n_docs, round(avgdl, 6) AS avgdl FROM field_stats""")
def e02_field_stats(spark, sf_dir):
    t = S.build_search_tables(A.read_doc_resources(spark, sf_dir))
    return t.field_stats.select("field", "n_docs", F.round("avgdl", 6).alias("avgdl"))


@register("e03_match", O.with_(O.RESOURCES, O.queries(), O.index(), O.QTERMS,
                               O.match_scores(["content"])) + """
SELECT query_id, doc_id, round(score, 6) AS score FROM scores""")
def e03_match(spark, sf_dir):
    res, qry, t = _search_inputs(spark, sf_dir)
    return S.match_scores(t, qry, ["content"]).select("query_id", "doc_id",
                                                     F.round("score", 6).alias("score"))


@register("e04_multi_match", O.with_(O.RESOURCES, O.queries(), O.index(), O.QTERMS,
                                     O.match_scores()) + """
SELECT query_id, doc_id, round(score, 6) AS score FROM scores""")
def e04_multi_match(spark, sf_dir):
    res, qry, t = _search_inputs(spark, sf_dir)
    return S.match_scores(t, qry).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def _hits_sql(**qkw) -> str:
    return O.with_(O.RESOURCES, O.queries(**qkw), O.index(), O.QTERMS, O.match_scores(),
                   O.MATCHES, O.COLLAPSED, O.PAGE) + O.FORMAT_HITS


@register("e05_filtered_search", _hits_sql(type_="tutorial", language="en"))
def e05_filtered_search(spark, sf_dir):
    res, qry, t = _search_inputs(spark, sf_dir, type_="tutorial", language="en")
    return S.search_batch(t, res, qry)["hits"]


@register("e06_collapse", O.with_(O.RESOURCES, O.queries(), O.index(), O.QTERMS,
                                  O.match_scores(), O.MATCHES, O.COLLAPSED) + """
SELECT query_id, doc_id, url, rscore FROM collapsed""")
def e06_collapse(spark, sf_dir):
    res, qry, t = _search_inputs(spark, sf_dir)
    m = S.batch_matches(t, res, qry, S.batch_info(t, qry), by_url=True)
    return S.collapse_by_url(m).select("query_id", "doc_id", "url", "rscore")


@register("e07_page", O.with_(O.RESOURCES, O.queries(page=1, size=5), O.index(), O.QTERMS,
                              O.match_scores(), O.MATCHES, O.COLLAPSED, O.PAGE) + """
SELECT query_id, rank, doc_id, rscore FROM page_hits""")
def e07_page(spark, sf_dir):
    res, qry, t = _search_inputs(spark, sf_dir, page=1, size=5)
    return S.search_batch(t, res, qry)["page"].select("query_id", "rank", "doc_id", "rscore")


@register("e09_type_facet", O.with_(O.RESOURCES, O.queries(), O.index(), O.QTERMS,
                                    O.match_scores(), O.MATCHES) + f"""
SELECT query_id, key, doc_count FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_count DESC, key) AS _r
  FROM (SELECT query_id, type AS key, count(*) AS doc_count FROM matches
        WHERE type IS NOT NULL GROUP BY query_id, type))
WHERE _r <= 10""")
def e09_type_facet(spark, sf_dir):
    res, qry, t = _search_inputs(spark, sf_dir)
    return S.search_batch(t, res, qry)["type_facet"]


@register("e10_page_language_facet", O.with_(O.RESOURCES, O.queries(), O.index(), O.QTERMS,
                                             O.match_scores(), O.MATCHES, O.COLLAPSED,
                                             O.PAGE) + """
SELECT query_id, plang AS key, count(*) AS doc_count FROM page_hits
WHERE plang IS NOT NULL GROUP BY query_id, plang""")
def e10_page_language_facet(spark, sf_dir):
    res, qry, t = _search_inputs(spark, sf_dir)
    return S.search_batch(t, res, qry)["language_facet"]


@register("e11_total", O.with_(O.RESOURCES, O.queries(), O.index(), O.QTERMS,
                               O.match_scores(), O.MATCHES) + """
SELECT q.query_id, q.q, CAST(coalesce(t.total, 0) AS BIGINT) AS total
FROM qry q LEFT JOIN (SELECT query_id, count(*) AS total FROM matches GROUP BY query_id) t
  ON q.query_id = t.query_id""")
def e11_total(spark, sf_dir):
    res, qry, t = _search_inputs(spark, sf_dir)
    return S.search_batch(t, res, qry)["totals"]


@register("e12_format_hits", _hits_sql())
def e12_format_hits(spark, sf_dir):
    res, qry, t = _search_inputs(spark, sf_dir)
    return S.search_batch(t, res, qry)["hits"]


@register("e13_snapshot_search", O.with_(O.RESOURCES, O.queries(), O.index(), O.QTERMS,
                                         O.match_scores(), O.MATCHES) + f"""
SELECT query_id, rank, doc_id, rscore, url FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY rank) AS _u FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {O.ORDER}) AS rank FROM matches)
  WHERE rank <= 100)
WHERE _u = 1""")
def e13_snapshot_search(spark, sf_dir):
    index = I.write_index(A.read_doc_resources(spark, sf_dir), scratch_dir(spark, "index"))
    return I.snapshot(index, A.read_queries(spark, sf_dir)).select("query_id", "rank", "doc_id", "rscore", "url")


@register("e15_explain", O.with_(O.RESOURCES, O.queries(), O.index(), O.QTERMS,
                                 O.term_scores(["content"])) + f"""
SELECT query_id, doc_id, term, tf, dl, round(idf, 6) AS idf,
       round(tf * {O.D(S.K1 + 1)} / (tf + {O.D(S.K1)} * ({O.D(1 - S.B)} + {O.D(S.B)} * dl / avgdl)), 6)
         AS tf_norm,
       round(score, 6) AS score
FROM tscores""")
def e15_explain(spark, sf_dir):
    res, qry, t = _search_inputs(spark, sf_dir)
    return S.explain_match(t, qry, "content")


@register("e16_match_recent", O.with_(O.RESOURCES, O.queries(), O.index(), O.QTERMS,
                                      O.match_scores(["content"])) + """
SELECT query_id, rank, doc_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS ts FROM (
  SELECT s.query_id, s.doc_id, r.timestamp,
         row_number() OVER (PARTITION BY s.query_id ORDER BY r.timestamp DESC, s.doc_id) AS rank
  FROM scores s JOIN res r ON s.doc_id = r.doc_id)
WHERE rank <= 10""")
def e16_match_recent(spark, sf_dir):
    res, qry, t = _search_inputs(spark, sf_dir)
    return S.match_recent(t, res, qry, "content", 10)


@register("e17_match_all", O.with_(O.RESOURCES) + """
SELECT doc_id, url, title FROM res ORDER BY doc_id LIMIT 10""")
def e17_match_all(spark, sf_dir):
    return S.match_all(A.read_doc_resources(spark, sf_dir), 10)


@register("e18_search_batch", _hits_sql(page=0, size=20))
def e18_search_batch(spark, sf_dir):
    res, qry = A.read_doc_resources(spark, sf_dir), A.read_queries(spark, sf_dir, page=0, size=20)
    return I.search(I.write_index(res, scratch_dir(spark, "index")), qry)["hits"]


@register("e19_stored_index_search", _hits_sql(page=0, size=20))
def e19_stored_index_search(spark, sf_dir):
    """The index is written, forgotten by the catalog as at the end of a session, and opened again."""
    path = scratch_dir(spark, "index")
    I.write_index(A.read_doc_resources(spark, sf_dir), path)
    I.forget_index(spark, path)
    return I.search(I.open_index(spark, path), A.read_queries(spark, sf_dir, page=0, size=20))["hits"]


# Every third query asks for a domain, every third for a type and language, the others for a list field and a field that is always empty.
FILTERS_SQL = """
qf AS (SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN 'src' || (item_id % 20) END AS f_domain,
              CASE item_id % 3 WHEN 1 THEN 'video' END AS f_type, CASE item_id % 3 WHEN 1 THEN 'en' END AS f_language,
              CASE item_id % 3 WHEN 2 THEN 'fr' END AS f_languages, CASE item_id % 12 WHEN 2 THEN 'none' END AS f_tags FROM benchmark),
kept AS (
  SELECT s.query_id, s.doc_id, s.score, round(s.score, 6) AS rscore, r.url, r.type, r.plang, r.timestamp
  FROM scores s JOIN res r USING (doc_id) JOIN qf f USING (query_id)
  WHERE coalesce(r.domain = f.f_domain, f.f_domain IS NULL) AND coalesce(r.type = f.f_type, f.f_type IS NULL)
    AND (f.f_language IS NULL OR coalesce(r.language = f.f_language, FALSE) OR list_contains(r.languages, f.f_language))
    AND (f.f_languages IS NULL OR list_contains(r.languages, f.f_languages))
    AND (f.f_tags IS NULL OR coalesce(r.tags = f.f_tags, FALSE)))"""


@register("e05_any_field_filters", O.with_(O.RESOURCES, O.queries(page=0, size=20), O.index(), O.QTERMS, O.match_scores(), FILTERS_SQL,
                                           O.COLLAPSED.replace("FROM matches", "FROM kept"), O.PAGE) + O.FORMAT_HITS)
def e05_any_field_filters(spark, sf_dir):
    """E5 with filters on any record field, other ones for each query."""
    n = F.col("query_id")
    when = lambda rest, value: F.when(n % 3 == rest, value)
    wanted = F.create_map(F.lit("domain"), when(0, F.concat(F.lit("src"), n % 20)), F.lit("type"), when(1, F.lit("video")), F.lit("language"), when(1, F.lit("en")),
                          F.lit("languages"), when(2, F.lit("fr")), F.lit("tags"), F.when(n % 12 == 2, F.lit("none")))
    qry = A.read_queries(spark, sf_dir, page=0, size=20).withColumn("filters", wanted)
    return I.search(I.write_index(A.read_doc_resources(spark, sf_dir), scratch_dir(spark, "index")), qry)["hits"]


def _hl_sql(text: str, pre: str = "<em>", post: str = "</em>") -> str:
    runs = f"regexp_extract_all({text}, {O.lit(S.TOKEN_PATTERN + '|[^\\p{L}\\p{N}_]+')}, 0)"
    hit = f"list_contains(t.terms, lower(r))"
    marked = f"list_transform({runs}, lambda r: CASE WHEN {hit} THEN {O.lit(pre)} || r || {O.lit(post)} ELSE r END)"
    return (f"CASE WHEN len(list_filter({runs}, lambda r: {hit})) > 0 "
            f"THEN array_to_string({marked}, '') END")


@register("e08_highlight", O.with_(O.RESOURCES, O.queries(), O.index(), O.QTERMS, O.match_scores(),
                                   O.MATCHES, O.COLLAPSED, O.PAGE, """
terms AS (SELECT query_id, list_sort(list(term)) AS terms FROM qterms GROUP BY query_id)""") + f"""
SELECT h.query_id, h.rank, h.doc_id AS id,
       {_hl_sql('r.title')} AS title_hl, {_hl_sql('r.description')} AS description_hl,
       {_hl_sql('r.content')} AS content_hl,
       {_hl_sql("array_to_string(r.code_snippets, ' ')", '<code>', '</code>')} AS code_snippets_hl
FROM page_hits h JOIN res r ON h.doc_id = r.doc_id JOIN terms t ON t.query_id = h.query_id""")
def e08_highlight(spark, sf_dir):
    res, qry, t = _search_inputs(spark, sf_dir)
    page = S.search_batch(t, res, qry)["page"]
    return S.highlights(page, res, qry)


@register("e14_low_result_queries", O.with_(O.RESOURCES, O.queries(type_="video", language="es"), O.index(), O.QTERMS,
                                            O.match_scores(), O.MATCHES) + f"""
SELECT q.query_id, q.q, CAST(coalesce(t.total, 0) AS BIGINT) AS total, md5('crawl:' || q.q) AS job_id,
       {O.lit(S.rules.LOW_RESULT_MESSAGE)} AS message,
       CASE WHEN coalesce(t.total, 0) = 0 THEN {O.lit(S.rules.ZERO_RESULT_INSTRUCTIONS)} END AS instructions
FROM qry q LEFT JOIN (SELECT query_id, count(*) AS total FROM matches GROUP BY query_id) t
  ON q.query_id = t.query_id
WHERE q.page = 0 AND coalesce(t.total, 0) < {S.rules.LOW_RESULT_THRESHOLD}""")
def e14_low_result_queries(spark, sf_dir):
    res, qry, t = _search_inputs(spark, sf_dir, type_="video", language="es")
    return S.low_result_queries(S.search_batch(t, res, qry)["totals"], qry)
