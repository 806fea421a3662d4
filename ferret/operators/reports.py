"""Aggregations and reports (F1-F9). All are partial-aggregated groupBys; top-k uses a
constant row_number bound (WindowGroupLimit) so no group is sorted whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

STRING_FIELDS = ["url", "title", "description", "content", "tags", "domain", "type", "language"]


def doc_bytes():
    """UTF-8 bytes of a resource's text fields (stand-in for stored document size)."""
    parts = [F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in STRING_FIELDS]
    arrays = [F.coalesce(F.octet_length(F.array_join(F.col(c), "")), F.lit(0))
              for c in ["code_snippets", "languages"]]
    return reduce(lambda a, b: a + b, parts + arrays).cast("long")


def index_status(resources: DataFrame) -> DataFrame:
    """resource count and total bytes; zeros for an empty table."""
    return resources.agg(F.count(F.lit(1)).alias("indexed_resources"),
                         F.coalesce(F.sum(doc_bytes()), F.lit(0)).cast("long").alias("index_size"))


def index_stats(resources: DataFrame) -> DataFrame:
    """(dimension, key, count, last_updated) for total, type, domain and language.

    Type, domain and the total come from one GROUPING SETS aggregation; languages are
    multi-valued, so they are exploded and counted separately.
    """
    r = resources.select("type", "domain", "languages", "timestamp")
    gs = (r.groupingSets([["type"], ["domain"], []], "type", "domain")
          .agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("last"),
               F.grouping_id().alias("gid")))
    dim = F.when(F.col("gid") == 3, F.lit("total")).when(F.col("gid") == 1, F.lit("type")) \
        .otherwise(F.lit("domain"))
    key = F.when(F.col("gid") == 1, F.col("type")).when(F.col("gid") == 2, F.col("domain"))
    a = gs.select(dim.alias("dimension"), key.alias("key"), F.col("n").alias("doc_count"),
                  F.when(F.col("gid") == 3, F.date_format("last", "yyyy-MM-dd HH:mm:ss"))
                  .alias("last_updated"))
    langs = (r.select(F.explode("languages").alias("key")).groupBy("key")
             .agg(F.count(F.lit(1)).alias("doc_count"))
             .select(F.lit("language").alias("dimension"), "key", "doc_count",
                     F.lit(None).cast("string").alias("last_updated")))
    return a.unionByName(langs)


def terms(resources: DataFrame, field: str, size: int, multi: bool = False) -> DataFrame:
    """top ``size`` values of ``field`` by document count (ties by key)."""
    v = F.explode(field) if multi else F.col(field)
    c = (resources.select(v.alias("key")).where(F.col("key").isNotNull())
         .groupBy("key").agg(F.count(F.lit(1)).alias("doc_count")))
    top = c.orderBy(F.col("doc_count").desc(), F.col("key")).limit(size)   # distributed top-k
    w = W.orderBy(F.col("doc_count").desc(), F.col("key"))                 # over <= size rows
    return (top.withColumn("rank", F.row_number().over(w))
            .select(F.lit(field).alias("field"), "key", "doc_count", "rank"))


def most_recent(resources: DataFrame, n: int = 10) -> DataFrame:
    """the ``n`` newest documents."""
    return resources.orderBy(F.col("timestamp").desc(), F.col("doc_id")).limit(n)


def by_id(resources: DataFrame, ids: DataFrame) -> DataFrame:
    """documents whose resource_id is in ``ids``."""
    return resources.join(ids.select("resource_id").distinct(), "resource_id", "left_semi")


def exists(resources: DataFrame, ids: DataFrame) -> DataFrame:
    """every requested id with a found flag."""
    have = resources.select("resource_id").distinct().withColumn("found", F.lit(True))
    return (ids.select("resource_id").distinct().join(have, "resource_id", "left")
            .select("resource_id", F.coalesce("found", F.lit(False)).alias("found")))


def frontier_stats(pending: DataFrame, seen: DataFrame, visited: DataFrame, n_workers: int) -> DataFrame:
    """|visited|, pending length, |seen|, workers."""
    u = (visited.select(F.lit("v").alias("set"), "url_hash")
         .unionByName(pending.select(F.lit("p").alias("set"), "url_hash"))
         .unionByName(seen.select(F.lit("s").alias("set"), "url_hash")))
    s = F.col("set")
    return u.agg(F.count_distinct(F.when(s == "v", F.col("url_hash"))).alias("visited"),
                 F.count(F.when(s == "p", F.lit(1))).alias("pending"),
                 F.count_distinct(F.when(s == "s", F.col("url_hash"))).alias("seen"),
                 F.lit(n_workers).alias("workers"))


def requests_by_endpoint(log: DataFrame, endpoint_col: str = "endpoint") -> DataFrame:
    """request lines counted by endpoint, descending."""
    return (log.groupBy(F.col(endpoint_col).alias("endpoint"))
            .agg(F.count(F.lit(1)).alias("requests"))
            .orderBy(F.desc("requests"), "endpoint"))


def document_size(resources: DataFrame, field: str = "content") -> DataFrame:
    """F8: average document bytes and linear projections to 100K and 1M documents."""
    avg = F.avg(F.octet_length(F.col(field)))
    return resources.agg(F.count(F.lit(1)).alias("n_docs"), F.round(avg, 6).alias("avg_bytes"),
                         F.round(avg * 100000, 3).alias("projected_100k"),
                         F.round(avg * 1000000, 3).alias("projected_1m"))


def job_counts(job_links: DataFrame, job_pages: DataFrame) -> DataFrame:
    """per job, distinct URLs discovered and resources found."""
    d = job_links.groupBy("job_id").agg(F.count_distinct("link").alias("urls_discovered"))
    r = job_pages.groupBy("job_id").agg(F.count_if(F.col("is_resource")).alias("resources_found"))
    return (r.join(d, "job_id", "full_outer")
            .select("job_id", F.coalesce("urls_discovered", F.lit(0)).alias("urls_discovered"),
                    F.coalesce("resources_found", F.lit(0)).alias("resources_found")))
