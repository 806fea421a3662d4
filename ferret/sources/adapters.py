"""Adapters that turn the driver tables into this engine's record shapes.

Each adapter is a projection over a whole table; the same expressions are written
as SQL in ``plans.oracle`` so the DuckDB check sees identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WS_RUN
from .tables import conform_resources, read_table

# FIXED VALUES: resource type assigned from doc_id % 5 in the documents adapter.
ADAPTER_TYPES = ["article", "tutorial", "video", "documentation", "repository"]
BASE_TIME = "2024-01-01 00:00:00"
# Every so many documents one repeats the URL of the document before it, so URL
# collapse and upsert-by-URL have duplicates to work on at every size.
REPEAT_EVERY = 10
# Every so many label updates one goes to a URL that no document has.
NEW_EVERY = 7


def doc_url(doc_id):
    repeats = (doc_id % REPEAT_EVERY == REPEAT_EVERY - 1).cast("bigint")
    return F.concat(F.lit("https://www.example.com/"), (doc_id - repeats).cast("string"))


def documents_as_resources(documents: DataFrame) -> DataFrame:
    """documents -> resource rows (one per document, keyed by doc_id)."""
    d = documents
    title = F.substring_index(d.text, "\n", 1)
    rest = F.substr(d.text, F.length(title) + 2)
    types = F.array(*[F.lit(t) for t in ADAPTER_TYPES])
    url = doc_url(d.doc_id)
    out = d.select(
        d.doc_id,
        F.md5(url).alias("resource_id"),
        url.alias("url"),
        title.alias("title"),
        F.when(rest != "", rest).alias("description"),
        d.text.alias("content"),
        F.array().cast("array<string>").alias("code_snippets"),
        F.lit(None).cast("string").alias("tags"),
        d.source.alias("domain"),
        F.element_at(types, (d.doc_id % 5 + 1).cast("int")).alias("type"),
        F.array(d.lang).alias("languages"),
        F.lit(None).cast("string").alias("language"),
        (F.to_timestamp(F.lit(BASE_TIME)) + F.make_interval(mins=d.doc_id.cast("int")))
        .alias("timestamp"),
    )
    return conform_resources(out)


def read_doc_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_as_resources(read_table(spark, sf_dir, "documents"))


def benchmark_queries(benchmark: DataFrame, n_words: int | None = None, type_=None, language=None,
                      page: int = 0, size: int = 10) -> DataFrame:
    """benchmark -> query table: the whole text, or its first ``n_words`` words where given."""
    q = benchmark.text
    if n_words is not None:
        q = F.array_join(F.slice(F.split(q, WS_RUN), 1, n_words), " ")
    return benchmark.select(
        benchmark.item_id.alias("query_id"),
        q.alias("q"),
        F.lit(type_).cast("string").alias("type"),
        F.lit(language).cast("string").alias("language"),
        F.lit(page).cast("int").alias("page"),
        F.lit(size).cast("int").alias("size"),
    )


def read_queries(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    return benchmark_queries(read_table(spark, sf_dir, "benchmark"), **kw)


def label_updates(labels: DataFrame) -> DataFrame:
    """labels -> partial resource updates: url, quality_score and type only.

    A label of toxic=1 sets the type to NULL, so the NULL-overwrite rule of the
    upsert is exercised on real rows; one label in ``NEW_EVERY`` goes to a new URL.
    """
    l = labels
    new = F.when(l.doc_id % NEW_EVERY == 0, F.lit("/new")).otherwise(F.lit(""))
    return l.select(
        l.doc_id.alias("load_seq"),
        F.concat(doc_url(l.doc_id), new).alias("url"),
        l.quality.cast("double").alias("quality_score"),
        F.when(l.toxic == 0, F.lit("tutorial")).alias("type"),
    )


def conversation_pages(conversations: DataFrame) -> DataFrame:
    """conversations -> a second batch of full resource items (one per conversation turn)."""
    c = conversations
    url = F.concat(F.lit("https://chat.example.com/"), c.conv_id.cast("string"))
    return c.select(
        (c.conv_id * 1000 + c.turn).alias("load_seq"),
        url.alias("url"),
        F.concat(c.role, F.lit(" "), c.turn.cast("string")).alias("title"),
        c.text.alias("description"),
        c.role.alias("type"),
    )


#: Markup in forms that the raw pages never use: quotings, a comment, references, a nested heading.
ODD_MARKUP = ("<a href='/single'>s</a><a class=c href=plain>u</a><!-- <a href=\"/hidden\">h</a> -->"
              "<a data-href=\"/no\">n</a>&copy; 2024 &#8212; &#x2019;s &unknown;<h1><b>Bold</b> own</h1>"
              "<meta name='description' content='single &quot;quoted&quot;'>")


def widen_pages(pages: DataFrame) -> DataFrame:
    """Test fixture: append fragments so rule branches the raw pages never reach are hit.

    Deterministic by page_id; every page is kept, none is dropped.
    """
    p = pages
    extra = (
        F.when(p.page_id % 4 == 1, F.lit("<pre><code>print(1)</code></pre>"))
        .when(p.page_id % 4 == 2, F.lit('<meta name="keywords" content="python,code">'))
        .when(p.page_id % 4 == 3, F.lit('<h2>Introduction</h2><a href="https://github.com/x">x</a>'))
        .otherwise(F.lit(""))
    )
    extra2 = F.when(p.page_id % 6 == 5,
                    F.lit('<meta name="description" content="A guide to cobol">')).otherwise(F.lit(""))
    extra3 = F.when(p.page_id % 7 == 3, F.lit(ODD_MARKUP)).otherwise(F.lit(""))
    suffix = (F.when(p.page_id % 5 == 1, F.lit("/tutorial"))
              .when(p.page_id % 5 == 2, F.lit("/docs/reference"))
              .when(p.page_id % 5 == 3, F.lit("/file.zip"))
              .when(p.page_id % 5 == 4, F.lit("/checkout"))
              .otherwise(F.lit("")))
    return p.select(p.page_id, F.concat(p.url, suffix).alias("url"),
                    F.concat(p.html, extra, extra2, extra3).alias("html"))


def varied_pages(pages: DataFrame) -> DataFrame:
    """Widened pages whose articles became sections (a third), some with a main element or another content class: pages without
    structure signals, and such that later selectors apply to."""
    p = widen_pages(pages)
    sections = F.when(p.page_id % 3 == 0, F.regexp_replace("html", "(</?)article", "$1section")).otherwise(p.html)
    n = p.page_id.cast("string")
    more = F.when(p.page_id % 6 == 0, F.concat(F.lit("<main>main "), n, F.lit("</main>"))) \
        .when(p.page_id % 6 == 1, F.concat(F.lit('<div class="post content">posted '), n, F.lit("</div>"))).otherwise(F.lit(""))
    return p.select("page_id", "url", F.concat(sections, more).alias("html"))


def lineitem_links(lineitem: DataFrame) -> DataFrame:
    """lineitem -> a link table (src, dst), distinct: the keys of orders and parts are nodes."""
    l = lineitem
    src = F.concat(F.lit("https://n.example.com/"), l.l_orderkey.cast("string"))
    dst = F.concat(F.lit("https://n.example.com/"), l.l_partkey.cast("string"))
    return l.select(src.alias("src_url"), dst.alias("dst_url")).distinct()


def events_feed(events: DataFrame) -> DataFrame:
    """events -> live result rows: url by user, type by event type, UTC timestamps."""
    e = events
    return e.select(
        e.event_id,
        F.concat(F.lit("https://u.example.com/"), e.user_id.cast("string")).alias("url"),
        F.concat(F.lit("event "), e.event_type).alias("title"),
        e.props.alias("description"),
        e.event_type.alias("type"),
        F.when(e.value >= 10, F.lit("EN")).when(e.value >= 5, F.lit("fr")).alias("language"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        e.value,
    )
