"""URL frontier and link tables (G1-G11) as batch DataFrame jobs.

The frontier is three tables: ``pending(url, url_hash, batch, src_seq, pos, worker)``
(FIFO order = batch, src_seq, pos; duplicates allowed), ``seen(url_hash)`` and
``visited(url_hash)``. Set operations are anti/semi joins on url_hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import rules
from ..functions.text import col_, netloc
from ..session import ensure_checkpoint_dir, stored
from . import extract as X
from . import predicates as C

FIFO = ["batch", "src_seq", "pos"]


def enqueue(pending: DataFrame, seen: DataFrame, visited: DataFrame, links: DataFrame,
            batch: int) -> tuple[DataFrame, DataFrame]:
    """G1: links whose hash is not visited are appended to pending (duplicates stay) and
    their hashes added to seen. ``links``: (url, src_seq, pos). Returns (pending, seen)."""
    l = links.select(F.col("url"), F.md5("url").alias("url_hash"), "src_seq", "pos",
                     F.lit(batch).cast("long").alias("batch"))
    new = l.join(visited.select("url_hash"), "url_hash", "left_anti")
    pending2 = pending.unionByName(new.select(*pending.columns), allowMissingColumns=False) \
        if pending is not None else new
    seen2 = (seen.select("url_hash").unionByName(new.select("url_hash")).distinct()
             if seen is not None else new.select("url_hash").distinct())
    return pending2, seen2


def mark_visited(visited: DataFrame, urls: DataFrame) -> DataFrame:
    """G2."""
    return visited.select("url_hash").unionByName(urls.select(F.md5("url").alias("url_hash"))).distinct()


def seed_if_empty(pending: DataFrame, seen: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seed rows only when pending and seen are both empty; seeds already seen are
    skipped. The emptiness test is two LIMIT 1 probes (no data reaches the driver)."""
    s = seeds.select("url", F.md5("url").alias("url_hash"), "pos")
    if pending.limit(1).count() or seen.limit(1).count():
        return s.limit(0)
    return s.join(seen.select("url_hash"), "url_hash", "left_anti")


def seed_table(spark: SparkSession, urls=None) -> DataFrame:
    """The default start URLs as a table (url, pos)."""
    urls = urls or rules.DEFAULT_START_URLS_DISTRIBUTED
    return spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "url string, pos int")


def md5_mod(url, n: int) -> Column:
    """md5(url) read as a 128-bit unsigned integer, modulo n, folded over four 32-bit
    hex groups so no intermediate exceeds 64 bits."""
    h = F.md5(col_(url))
    acc = F.lit(0).cast("long")
    for i in range(4):
        part = F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long")
        acc = F.pmod(acc * F.lit(1 << 32) + part, F.lit(n))
    return acc


def assign_worker(pending: DataFrame, workers: list[str], window: int | None = None) -> DataFrame:
    """Every pending URL gets a worker by md5(url) mod n; with ``window``, only the first
    so many in FIFO order (one round; the others stay pending)."""
    first = pending if window is None else pending.orderBy(*FIFO).limit(window)
    idx = md5_mod("url", len(workers))
    arr = F.array(*[F.lit(w) for w in workers])
    return first.withColumn("worker", F.element_at(arr, (idx + 1).cast("int")))


def take_batch(assigned: DataFrame, size: int = rules.BATCH_SIZE) -> DataFrame:
    """Per worker, the first ``size`` URLs in FIFO order."""
    w = W.partitionBy("worker").orderBy(*FIFO)
    return assigned.withColumn("take", F.row_number().over(w)).where(F.col("take") <= size)


def seed_urls_for_query(queries: DataFrame, templates=None) -> DataFrame:
    """Search-page URLs for each query; raw query text, one template lower-cased.
    Each query row expands its own template array: no join."""
    templates = templates or rules.QUERY_URL_TEMPLATES
    q, ql = F.col("q"), F.lower(F.col("q"))
    arr = F.array(*[F.lit(t) for t in templates])
    urls = F.transform(arr, lambda t: F.replace(F.replace(t, F.lit("{q_lower}"), ql), F.lit("{q}"), q))
    return queries.select("query_id", F.posexplode(urls).alias("pos", "url"))


def choose_start_urls(jobs: DataFrame, defaults=None) -> DataFrame:
    """Given start URLs (a list, or text with commas), else query templates, else the defaults.
    ``jobs``: (job_id, query, start_urls)."""
    templates = F.array(*[F.lit(t) for t in rules.QUERY_URL_TEMPLATES])
    q = F.col("query")
    from_q = F.transform(templates, lambda t: F.replace(F.replace(t, F.lit("{q_lower}"), F.lower(q)),
                                                        F.lit("{q}"), q))
    chosen = F.when(F.size(given_urls(jobs)) > 0, given_urls(jobs)) \
        .when(F.coalesce(q, F.lit("")) != "", from_q).otherwise(F.array(*[F.lit(u) for u in defaults or rules.DEFAULT_START_URLS_BROAD]))
    return jobs.select("job_id", F.posexplode(chosen).alias("pos", "url"))


def given_urls(jobs: DataFrame) -> Column:
    """The start URLs a job names, as a list; empty where it names none."""
    none = F.array().cast("array<string>")
    if dict(jobs.dtypes)["start_urls"].startswith("array"):
        return F.coalesce("start_urls", none)
    return F.when(F.coalesce("start_urls", F.lit("")) != "", F.split("start_urls", ",", -1)).otherwise(none)


def distributed_start_urls(jobs: DataFrame, assigned: DataFrame, size: int = rules.BATCH_SIZE) -> DataFrame:
    """G7 of the distributed crawl: a worker starts with the first ``size`` URLs pending for it; only a worker without any
    takes the URLs its job names, or else the defaults. ``jobs``: (job_id, worker, start_urls); ``assigned``: pending URLs with their
    worker (G4)."""
    taken = take_batch(assigned, size)
    queued = jobs.select("job_id", "worker").join(taken.select("worker", (F.col("take") - 1).alias("pos"), "url"), "worker").select("job_id", "pos", "url")
    idle = jobs.join(taken.select("worker").distinct(), "worker", "left_anti").withColumn("query", F.lit(None).cast("string"))
    return queued.unionByName(choose_start_urls(idle, rules.DEFAULT_START_URLS_DISTRIBUTED))


def link_table(pages: DataFrame, mode: str = "broad", query: str | None = None,
               allowed_domains=None) -> DataFrame:
    """(src_url, dst_url) links a crawl would follow from a page snapshot."""
    if mode == "broad":
        l = X.links(pages, resolve=False)
        keep = C.should_follow_broad("link", query)
    else:
        l = X.links(pages, resolve=True)
        keep = C.should_follow_narrow("link", allowed_domains)
    return l.where(keep).select("page_id", "pos", "src_url", F.col("link").alias("dst_url"))


def reachable(seeds: DataFrame, links: DataFrame, max_depth: int = rules.DEPTH_LIMIT,
              max_pages: int | None = None, hub_edges: int = 100_000) -> DataFrame:
    """Hop-limited expansion from ``seeds`` (url) over ``links`` (src_url, dst_url).

    One join per hop against the not-yet-visited set; each hop's result is
    checkpointed to the shared checkpoint folder so lineage stays short and a lost
    executor recomputes at most one hop. Returns (url, depth) of every reached page;
    with ``max_pages``, the first so many by (depth, url). A page with more than ``hub_edges``
    links is a hub, whose links are spread.
    """
    ensure_checkpoint_dir(seeds.sparkSession)
    # The distinct edges, read twice, are written once (a checkpoint would make them twice and keep every URL in full).
    # Hubs are fewer than one per ``hub_edges`` links and are broadcast; a hop looks its frontier up while it reads the edges, unsorted.
    # The edges are dealt by source once and checkpointed, AQE choosing the width. The edges of a hub
    # go to several places by their target, and its frontier row goes to each of them.
    edges = stored(links.select("src_url", "dst_url").distinct(), "edges")
    hubs = (edges.groupBy("src_url").agg(F.ceil(F.count(F.lit(1)) / F.lit(hub_edges)).alias("places"))
            .where("places > 1").checkpoint())
    place = F.pmod(F.xxhash64("dst_url"), F.coalesce("places", F.lit(1)))
    edges = (edges.join(F.broadcast(hubs), "src_url", "left").select("src_url", place.alias("place"), "dst_url")
             .repartition("src_url", "place").checkpoint())
    hubs = hubs.withColumnRenamed("src_url", "url")
    visited = seeds.select(F.col("url"), F.lit(0).alias("depth")).distinct().checkpoint()
    frontier = visited
    for depth in range(1, max_depth + 1):
        dealt = frontier.join(F.broadcast(hubs), "url", "left").select(
            "url", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("places", F.lit(1)) - 1)).alias("place")).hint("shuffle_hash")
        nxt = (dealt.join(edges, (dealt.url == edges.src_url) & (dealt.place == edges.place))
               .select(F.col("dst_url").alias("url")).distinct()
               .join(visited.select("url"), "url", "left_anti")
               .withColumn("depth", F.lit(depth))).checkpoint()
        if nxt.limit(1).count() == 0:
            break
        visited = visited.unionByName(nxt)       # a union of checkpointed pieces
        frontier = nxt
    if max_pages:
        return visited.orderBy("depth", "url").limit(max_pages)   # distributed top-k
    return visited


def crawl_jobs(queries: DataFrame) -> DataFrame:
    """A crawl job per request: id, query (default 'python'), start URL list."""
    q = F.when(F.coalesce(F.col("q"), F.lit("")) != "", F.col("q")).otherwise(F.lit(rules.DEFAULT_QUERY))
    return queries.select(F.md5(F.concat(F.lit("crawl:"), q)).alias("job_id"), q.alias("query"),
                          F.lit(None).cast("string").alias("start_urls"))


def cap_per_domain(pages: DataFrame, n: int, order_col: str = "page_id") -> DataFrame:
    """At most ``n`` pages per domain, first by ``order_col``."""
    w = W.partitionBy("domain").orderBy(order_col)
    return (pages.withColumn("domain", netloc("url"))
            .withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r"))
