"""Driver queries for table sinks (A), reports (F) and the frontier (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..operators import frontier as G
from ..operators import predicates as C
from ..operators import reports as R
from ..operators import extract as X
from ..schema import RESOURCE_SCHEMA
from ..session import scratch_dir
from ..sources import adapters as A
from ..sources import sinks as K
from ..sources.tables import conform_resources, read_table
from . import oracle as O
from .catalog import register
from .q_pages import QUERY, wide_pages

WORKERS = ["worker-0", "worker-1", "worker-2"]

# ---------------------------------------------------------------- SQL blocks

DEDUPED = """
ex AS (
  SELECT * EXCLUDE (_r) FROM (
    SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY doc_id DESC) AS _r FROM res)
  WHERE _r = 1
)"""

LABEL_UPDATES = f"""
inc0 AS (
  SELECT l.doc_id AS load_seq, CAST(l.quality AS DOUBLE) AS quality_score,
         {O.doc_url('l')} || CASE WHEN l.doc_id % {A.NEW_EVERY} = 0 THEN '/new' ELSE '' END AS url,
         CASE WHEN l.toxic = 0 THEN 'tutorial' END AS type
  FROM labels l
),
inc AS (
  SELECT * EXCLUDE (_r) FROM (
    SELECT *, md5(url) AS rid, row_number() OVER (PARTITION BY md5(url) ORDER BY load_seq DESC) AS _r
    FROM inc0) WHERE _r = 1
)"""

CONV_ITEMS = """
inc0 AS (
  SELECT conv_id * 1000 + turn AS load_seq, 'https://chat.example.com/' || CAST(conv_id AS VARCHAR) AS url,
         role || ' ' || CAST(turn AS VARCHAR) AS title, text AS description, role AS type
  FROM conversations
),
inc AS (
  SELECT * EXCLUDE (_r) FROM (
    SELECT *, md5(url) AS rid, row_number() OVER (PARTITION BY md5(url) ORDER BY load_seq DESC) AS _r
    FROM inc0) WHERE _r = 1
)"""


def _links_sql():
    return f"""
lnk AS (
  SELECT page_id AS src_seq, pos, {O.resolve_url('url', 'href')} AS url FROM (
    SELECT page_id, url, unnest(h) AS href, unnest(range(len(h))) AS pos
    FROM (SELECT page_id, url, {O.hrefs('html')} AS h FROM wpages))
  UNION ALL SELECT page_id AS src_seq, -1 AS pos, url FROM wpages
),
visited AS (SELECT DISTINCT md5(url) AS url_hash FROM wpages),
pending AS (
  SELECT url, md5(url) AS url_hash, src_seq, pos, CAST(1 AS BIGINT) AS batch FROM lnk
  WHERE md5(url) NOT IN (SELECT url_hash FROM visited)
),
seen AS (SELECT DISTINCT url_hash FROM pending)"""


# ---------------------------------------------------------------- spark helpers

def deduped(spark, sf_dir):
    return K.dedupe_resources(A.read_doc_resources(spark, sf_dir))


def label_updates(spark, sf_dir):
    return A.label_updates(read_table(spark, sf_dir, "labels"))


def conv_items(spark, sf_dir):
    return A.conversation_pages(read_table(spark, sf_dir, "conversations"))


def frontier(spark, sf_dir):
    p = wide_pages(spark, sf_dir)
    links = X.links(p, resolve=True).select(F.col("link").alias("url"),
                                            F.col("page_id").alias("src_seq"), "pos")
    own = p.select("url", F.col("page_id").alias("src_seq"), F.lit(-1).alias("pos"))
    visited = p.select(F.md5("url").alias("url_hash")).distinct()
    pending, seen = G.enqueue(None, None, visited, links.unionByName(own), batch=1)
    return pending, seen, visited


# ---------------------------------------------------------------- A

@register("a01_read_pages", """
SELECT page_id, url, length(html) AS html_chars FROM pages""")
def a01_read_pages(spark, sf_dir):
    from ..sources.tables import read_pages, table_path
    p = read_pages(spark, table_path(sf_dir, "pages"))
    return p.select("page_id", "url", F.length("html").alias("html_chars"))


@register("a02_read_resources", O.with_(O.RESOURCES) + """
SELECT doc_id, resource_id, url, title, description, length(content) AS content_len, tags, domain,
       type, array_to_string(languages, ',') AS languages, language,
       strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS ts, quality_score
FROM res""")
def a02_read_resources(spark, sf_dir):
    r = conform_resources(A.read_doc_resources(spark, sf_dir))
    return r.select("doc_id", "resource_id", "url", "title", "description",
                    F.length("content").alias("content_len"), "tags", "domain", "type",
                    F.array_join("languages", ",").alias("languages"), "language",
                    F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"), "quality_score")


@register("a03_upsert_resources", O.with_(O.RESOURCES, DEDUPED, LABEL_UPDATES) + """
SELECT coalesce(inc.rid, ex.resource_id) AS resource_id,
       CASE WHEN inc.rid IS NOT NULL THEN inc.url ELSE ex.url END AS url,
       ex.title AS title,
       CASE WHEN inc.rid IS NOT NULL THEN inc.type ELSE ex.type END AS type,
       CASE WHEN inc.rid IS NOT NULL THEN inc.quality_score ELSE ex.quality_score END AS quality_score,
       ex.resource_id IS NULL AS is_new
FROM ex FULL OUTER JOIN inc ON ex.resource_id = inc.rid""")
def a03_upsert_resources(spark, sf_dir):
    u = K.upsert_resources(deduped(spark, sf_dir), label_updates(spark, sf_dir))
    return u.select("resource_id", "url", "title", "type", "quality_score", "is_new")


@register("a04_replace_resources", O.with_(O.RESOURCES, DEDUPED, LABEL_UPDATES) + """
SELECT resource_id, url, title, type, quality_score FROM ex
WHERE resource_id NOT IN (SELECT rid FROM inc)
UNION ALL
SELECT rid AS resource_id, url, CAST(NULL AS VARCHAR) AS title, type, quality_score FROM inc""")
def a04_replace_resources(spark, sf_dir):
    r = K.replace_resources(deduped(spark, sf_dir), label_updates(spark, sf_dir))
    return r.select("resource_id", "url", "title", "type", "quality_score")


@register("a06_change_feed", O.with_(O.RESOURCES, DEDUPED, CONV_ITEMS) + """
SELECT inc.rid AS id, inc.url, inc.title, inc.description, inc.type, CAST(NULL AS VARCHAR) AS domain,
       CAST(NULL AS VARCHAR) AS language
FROM inc LEFT JOIN ex ON ex.resource_id = inc.rid WHERE ex.resource_id IS NULL""")
def a06_change_feed(spark, sf_dir):
    u = K.upsert_resources(deduped(spark, sf_dir), conv_items(spark, sf_dir))
    return K.change_feed(u).select("id", "url", "title", "description", "type", "domain", "language")


@register("a07_export_sample", O.with_(O.RESOURCES) + """
SELECT doc_id, url, title, description, type, array_to_string(languages, ',') AS languages, quality_score FROM res ORDER BY doc_id LIMIT 100""")
def a07_export_sample(spark, sf_dir):
    """The sample is written as JSON lines and read back."""
    path = scratch_dir(spark, "sample")
    K.write_json(K.export_sample(A.read_doc_resources(spark, sf_dir), 100), path)
    back = spark.read.schema(RESOURCE_SCHEMA).json(path)
    return back.select("doc_id", "url", "title", "description", "type", F.array_join("languages", ",").alias("languages"), "quality_score")


@register("a08_reindex", O.with_(O.RESOURCES) + """
SELECT doc_id, resource_id, url, quality_score, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS ts FROM res""")
def a08_reindex(spark, sf_dir):
    from pyspark.sql import types as T
    target = T.StructType([f for f in RESOURCE_SCHEMA.fields if f.name != "content"])
    r = K.reindex(A.read_doc_resources(spark, sf_dir).drop("content"), target)
    return r.select("doc_id", "resource_id", "url", "quality_score",
                    F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"))


# ---------------------------------------------------------------- F

def _bytes_sql():
    parts = [f"coalesce(strlen({c}), 0)" for c in R.STRING_FIELDS]
    parts += [f"coalesce(strlen(array_to_string({c}, '')), 0)"
              for c in ["code_snippets", "languages"]]
    return " + ".join(parts)


@register("f01_index_status", O.with_(O.RESOURCES) + f"""
SELECT count(*) AS indexed_resources, CAST(coalesce(sum({_bytes_sql()}), 0) AS BIGINT) AS index_size
FROM res""")
def f01_index_status(spark, sf_dir):
    return R.index_status(A.read_doc_resources(spark, sf_dir))


@register("f02_index_stats", O.with_(O.RESOURCES) + """
SELECT 'total' AS dimension, CAST(NULL AS VARCHAR) AS key, count(*) AS doc_count,
       strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS last_updated FROM res
UNION ALL SELECT 'type', type, count(*), NULL FROM res GROUP BY type
UNION ALL SELECT 'domain', domain, count(*), NULL FROM res GROUP BY domain
UNION ALL SELECT 'language', l, count(*), NULL FROM (SELECT unnest(languages) AS l FROM res) GROUP BY l""")
def f02_index_stats(spark, sf_dir):
    return R.index_stats(A.read_doc_resources(spark, sf_dir))


@register("f03_terms", O.with_(O.RESOURCES) + """
SELECT field, key, doc_count, rank FROM (
  SELECT 'type' AS field, type AS key, count(*) AS doc_count,
         row_number() OVER (ORDER BY count(*) DESC, type) AS rank
  FROM res WHERE type IS NOT NULL GROUP BY type) WHERE rank <= 10
UNION ALL SELECT field, key, doc_count, rank FROM (
  SELECT 'languages' AS field, l AS key, count(*) AS doc_count,
         row_number() OVER (ORDER BY count(*) DESC, l) AS rank
  FROM (SELECT unnest(languages) AS l FROM res) GROUP BY l) WHERE rank <= 20
UNION ALL SELECT field, key, doc_count, rank FROM (
  SELECT 'domain' AS field, domain AS key, count(*) AS doc_count,
         row_number() OVER (ORDER BY count(*) DESC, domain) AS rank
  FROM res WHERE domain IS NOT NULL GROUP BY domain) WHERE rank <= 20""")
def f03_terms(spark, sf_dir):
    r = A.read_doc_resources(spark, sf_dir)
    return (R.terms(r, "type", 10).unionByName(R.terms(r, "languages", 20, multi=True))
            .unionByName(R.terms(r, "domain", 20)))


@register("f04_most_recent", O.with_(O.RESOURCES) + """
SELECT doc_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS ts FROM res
ORDER BY timestamp DESC, doc_id LIMIT 10""")
def f04_most_recent(spark, sf_dir):
    return R.most_recent(A.read_doc_resources(spark, sf_dir), 10).select(
        "doc_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@register("f05_by_id", O.with_(O.RESOURCES, DEDUPED, LABEL_UPDATES) + """
SELECT resource_id, doc_id FROM ex WHERE resource_id IN (SELECT rid FROM inc)""")
def f05_by_id(spark, sf_dir):
    ids = label_updates(spark, sf_dir).select(F.md5("url").alias("resource_id"))
    return R.by_id(deduped(spark, sf_dir), ids).select("resource_id", "doc_id")


@register("f05_exists", O.with_(O.RESOURCES, DEDUPED, CONV_ITEMS) + """
SELECT i.resource_id, ex.resource_id IS NOT NULL AS found
FROM (SELECT DISTINCT rid AS resource_id FROM inc
      UNION SELECT resource_id FROM ex WHERE doc_id % 2 = 0) i
LEFT JOIN ex ON ex.resource_id = i.resource_id""")
def f05_exists(spark, sf_dir):
    known = deduped(spark, sf_dir)
    ids = conv_items(spark, sf_dir).select(F.md5("url").alias("resource_id")).unionByName(known.where("doc_id % 2 = 0").select("resource_id"))
    return R.exists(known, ids)


@register("f06_frontier_stats", O.with_(O.WIDE_PAGES, _links_sql()) + f"""
SELECT (SELECT count(DISTINCT url_hash) FROM visited) AS visited,
       (SELECT count(*) FROM pending) AS pending,
       (SELECT count(DISTINCT url_hash) FROM seen) AS seen,
       CAST({len(WORKERS)} AS BIGINT) AS workers""")
def f06_frontier_stats(spark, sf_dir):
    pending, seen, visited = frontier(spark, sf_dir)
    return R.frontier_stats(pending, seen, visited, len(WORKERS))


@register("f07_requests_by_endpoint", """
SELECT event_type AS endpoint, count(*) AS requests FROM events GROUP BY event_type""")
def f07_requests_by_endpoint(spark, sf_dir):
    return R.requests_by_endpoint(read_table(spark, sf_dir, "events"), "event_type")


@register("f08_document_size", O.with_(O.RESOURCES) + """
SELECT count(*) AS n_docs, round(avg(strlen(content)), 6) AS avg_bytes,
       round(avg(strlen(content)) * 100000, 3) AS projected_100k,
       round(avg(strlen(content)) * 1000000, 3) AS projected_1m
FROM res""")
def f08_document_size(spark, sf_dir):
    return R.document_size(A.read_doc_resources(spark, sf_dir))


@register("f09_job_counts", O.with_(O.WIDE_PAGES, f"""
pj AS (SELECT page_id, url, html, md5('crawl:' || {O.netloc('url')}) AS job_id FROM wpages),
jl AS (SELECT job_id, {O.resolve_url('url', 'href')} AS link
       FROM (SELECT job_id, url, unnest({O.hrefs('html')}) AS href FROM pj)),
jp AS (SELECT job_id, {O.contains_any_hof("lower(coalesce(url, ''))", rules.VALUABLE_URL_PATTERNS)} AS is_resource FROM pj)""") + """
SELECT coalesce(r.job_id, d.job_id) AS job_id, coalesce(d.urls_discovered, 0) AS urls_discovered,
       coalesce(r.resources_found, 0) AS resources_found
FROM (SELECT job_id, count(*) FILTER (WHERE is_resource) AS resources_found FROM jp GROUP BY job_id) r
FULL OUTER JOIN (SELECT job_id, count(DISTINCT link) AS urls_discovered FROM jl GROUP BY job_id) d
  ON r.job_id = d.job_id""")
def f09_job_counts(spark, sf_dir):
    p = wide_pages(spark, sf_dir)
    job = lambda url: F.md5(F.concat(F.lit("crawl:"), X.domain(url)))
    jl = X.links(p, resolve=True).select(job("src_url").alias("job_id"), "link")
    jp = p.select(job("url").alias("job_id"), C.url_has_valuable_word("url").alias("is_resource"))
    return R.job_counts(jl, jp)


# ---------------------------------------------------------------- G

@register("g01_enqueue", O.with_(O.WIDE_PAGES, _links_sql()) + """
SELECT url, url_hash, batch, src_seq, pos FROM pending""")
def g01_enqueue(spark, sf_dir):
    pending, _, _ = frontier(spark, sf_dir)
    return pending.select("url", "url_hash", "batch", "src_seq", "pos")


@register("g02_mark_visited", O.with_(O.WIDE_PAGES, _links_sql()) + """
SELECT url_hash FROM visited UNION SELECT md5(url) FROM pending WHERE pos = 0""")
def g02_mark_visited(spark, sf_dir):
    pending, _, visited = frontier(spark, sf_dir)
    return G.mark_visited(visited, pending.where("pos = 0").select("url"))


@register("g03_seed_if_empty", O.with_(O.WIDE_PAGES, _links_sql()) + f"""
SELECT url, md5(url) AS url_hash, pos FROM (
  SELECT unnest({O.lst(rules.DEFAULT_START_URLS_DISTRIBUTED)}) AS url,
         unnest(range({len(rules.DEFAULT_START_URLS_DISTRIBUTED)})) AS pos)
WHERE NOT EXISTS (SELECT 1 FROM pending WHERE md5(url) NOT IN (SELECT md5(url) FROM lnk))""")
def g03_seed_if_empty(spark, sf_dir):
    """The frontier of the next crawl, when every link of the pages has been visited."""
    links, _, visited = frontier(spark, sf_dir)
    pending, seen = G.enqueue(None, None, G.mark_visited(visited, links), links.select("url", "src_seq", "pos"), batch=2)
    return G.seed_if_empty(pending, seen, G.seed_table(spark)).select("url", "url_hash", "pos")


@register("g04_assign_worker", O.with_(O.WIDE_PAGES, _links_sql()) + f"""
SELECT url, src_seq, pos, {O.lst(WORKERS)}[CAST(('0x' || md5(url))::UHUGEINT % {len(WORKERS)} AS INTEGER) + 1]
         AS worker
FROM pending""")
def g04_assign_worker(spark, sf_dir):
    pending, _, _ = frontier(spark, sf_dir)
    return G.assign_worker(pending, WORKERS).select("url", "src_seq", "pos", "worker")


@register("g05_take_batch", O.with_(O.WIDE_PAGES, _links_sql()) + f"""
SELECT url, worker, take FROM (
  SELECT *, row_number() OVER (PARTITION BY worker ORDER BY batch, src_seq, pos) AS take FROM (
    SELECT *, {O.lst(WORKERS)}[CAST(('0x' || md5(url))::UHUGEINT % {len(WORKERS)} AS INTEGER) + 1] AS worker
    FROM pending))
WHERE take <= {rules.BATCH_SIZE}""")
def g05_take_batch(spark, sf_dir):
    pending, _, _ = frontier(spark, sf_dir)
    return G.take_batch(G.assign_worker(pending, WORKERS)).select("url", "worker", "take")


def _templates_sql(q: str) -> str:
    arr = O.lst(rules.QUERY_URL_TEMPLATES)
    return (f"list_transform({arr}, lambda t: replace(replace(t, '{{q_lower}}', lower({q})), "
            f"'{{q}}', {q}))")


@register("g06_seed_urls_for_query", O.with_(O.queries()) + f"""
SELECT query_id, unnest(range({len(rules.QUERY_URL_TEMPLATES)})) AS pos, unnest({_templates_sql('q')}) AS url
FROM qry""")
def g06_seed_urls_for_query(spark, sf_dir):
    return G.seed_urls_for_query(A.read_queries(spark, sf_dir))


@register("g07_choose_start_urls", O.with_(O.queries()) + f"""
SELECT job_id, unnest(range(len(u))) AS pos, unnest(u) AS url FROM (
  SELECT md5('crawl:' || CAST(query_id AS VARCHAR)) AS job_id,
         CASE WHEN query_id % 3 = 1 THEN ['https://a.example.com/' || CAST(query_id AS VARCHAR), 'https://b.example.com/']
              WHEN query_id % 3 = 2 OR coalesce(q, '') = '' THEN {O.lst(rules.DEFAULT_START_URLS_BROAD)}
              ELSE {_templates_sql('q')} END AS u
  FROM qry)""")
def g07_choose_start_urls(spark, sf_dir):
    q = A.read_queries(spark, sf_dir)
    key = F.col("query_id").cast("string")
    given = F.concat(F.lit("https://a.example.com/"), key, F.lit(",https://b.example.com/"))
    jobs = q.select(F.md5(F.concat(F.lit("crawl:"), key)).alias("job_id"),
                    F.when(F.col("query_id") % 3 != 2, F.col("q")).alias("query"),
                    F.when(F.col("query_id") % 3 == 1, given).alias("start_urls"))
    return G.choose_start_urls(jobs)


@register("g07_distributed_start_urls", f"""
WITH pend AS (SELECT 'w' || (user_id % 5) AS worker, 'https://u.example.com/' || user_id AS url, event_id FROM events WHERE event_type = 'click'),
took AS (SELECT worker, url, row_number() OVER (PARTITION BY worker ORDER BY event_id) - 1 AS pos FROM pend QUALIFY pos < {rules.BATCH_SIZE}),
jobs AS (SELECT item_id AS job_id, 'w' || (item_id % 9) AS worker,
                CASE WHEN item_id % 2 = 1 THEN ['https://a.example.com/' || item_id, 'https://b.example.com/'] END AS given FROM benchmark)
SELECT j.job_id, t.pos, t.url FROM jobs j JOIN took t ON t.worker = j.worker
UNION ALL
SELECT job_id, unnest(range(len(u))) AS pos, unnest(u) AS url FROM (
  SELECT job_id, coalesce(given, {O.lst(rules.DEFAULT_START_URLS_DISTRIBUTED)}) AS u FROM jobs WHERE worker NOT IN (SELECT worker FROM took))""")
def g07_distributed_start_urls(spark, sf_dir):
    """Five of nine workers have URLs pending; the others take the list of their job, or the defaults."""
    e = read_table(spark, sf_dir, "events").where("event_type = 'click'")
    pending = e.select(F.concat(F.lit("w"), (F.col("user_id") % 5).cast("string")).alias("worker"), F.concat(F.lit("https://u.example.com/"), F.col("user_id").cast("string")).alias("url"),
                       F.lit(0).cast("long").alias("batch"), F.col("event_id").alias("src_seq"), F.lit(0).alias("pos"))
    n = F.col("item_id")
    given = F.when(n % 2 == 1, F.array(F.concat(F.lit("https://a.example.com/"), n.cast("string")), F.lit("https://b.example.com/")))
    jobs = read_table(spark, sf_dir, "benchmark").select(n.alias("job_id"), F.concat(F.lit("w"), (n % 9).cast("string")).alias("worker"), given.alias("start_urls"))
    return G.distributed_start_urls(jobs, pending)


@register("g08_link_table", O.with_(O.WIDE_PAGES) + f"""
SELECT page_id, pos, url AS src_url, href AS dst_url FROM (
  SELECT page_id, url, unnest(h) AS href, unnest(range(len(h))) AS pos
  FROM (SELECT page_id, url, {O.hrefs('html')} AS h FROM wpages))
WHERE {O.should_follow_broad('href', QUERY)}""")
def g08_link_table(spark, sf_dir):
    return G.link_table(wide_pages(spark, sf_dir), "broad", QUERY)


@register("g08_link_table_narrow", O.with_(O.WIDE_PAGES) + f"""
SELECT page_id, pos, src_url, dst_url FROM (
  SELECT page_id, pos, url AS src_url, {O.resolve_url('url', 'href')} AS dst_url FROM (
    SELECT page_id, url, unnest(h) AS href, unnest(range(len(h))) AS pos
    FROM (SELECT page_id, url, {O.hrefs('html')} AS h FROM wpages)))
WHERE {O.should_follow_narrow('dst_url', ['example.com', 'github.com'])}""")
def g08_link_table_narrow(spark, sf_dir):
    return G.link_table(wide_pages(spark, sf_dir), "narrow", allowed_domains=["example.com", "github.com"])


@register("g09_reachable", f"""
WITH RECURSIVE edges AS (
  SELECT DISTINCT 'https://n.example.com/' || CAST(l_orderkey AS VARCHAR) AS src,
                  'https://n.example.com/' || CAST(l_partkey AS VARCHAR) AS dst
  FROM lineitem
),
r(url, depth) AS (
  SELECT DISTINCT 'https://n.example.com/' || CAST(n_nationkey AS VARCHAR), 0 FROM nation
  UNION
  SELECT e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.url WHERE r.depth < {rules.DEPTH_LIMIT}
)
SELECT url, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY url""")
def g09_reachable(spark, sf_dir):
    links = A.lineitem_links(read_table(spark, sf_dir, "lineitem"))
    seeds = read_table(spark, sf_dir, "nation").select(
        F.concat(F.lit("https://n.example.com/"), F.col("n_nationkey").cast("string")).alias("url"))
    return G.reachable(seeds, links).select("url", F.col("depth").cast("int").alias("depth"))


@register("g10_crawl_jobs", O.with_(O.queries()) + f"""
SELECT md5('crawl:' || CASE WHEN coalesce(q, '') <> '' THEN q ELSE {O.lit(rules.DEFAULT_QUERY)} END) AS job_id,
       CASE WHEN coalesce(q, '') <> '' THEN q ELSE {O.lit(rules.DEFAULT_QUERY)} END AS query
FROM qry""")
def g10_crawl_jobs(spark, sf_dir):
    return G.crawl_jobs(A.read_queries(spark, sf_dir)).select("job_id", "query")


@register("g11_cap_per_domain", O.with_(O.WIDE_PAGES) + f"""
SELECT page_id, domain FROM (
  SELECT page_id, {O.netloc('url')} AS domain,
         row_number() OVER (PARTITION BY {O.netloc('url')} ORDER BY page_id) AS _r FROM wpages)
WHERE _r <= 2""")
def g11_cap_per_domain(spark, sf_dir):
    return G.cap_per_domain(wide_pages(spark, sf_dir), 2).select("page_id", "domain")
