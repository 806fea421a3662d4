"""Benchmark: headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Jobs (each forced to completion with the no-op sink or a real parquet write):
  extract   B13 page extraction (broad rules) over all pages
  index     E2 build + write of the search tables over all documents
  search    E18 batch search (every benchmark query) over the written index
  snapshot  E13 top-100 snapshot per query
  upsert    A3 label batch merged into the deduplicated resource table
  percolate H3 standing queries against all document records
  reachable G9 hop expansion over the lineitem link graph
  reports   F2 + F3 index statistics
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from ferret.operators import extract as X  # noqa: E402
from ferret.operators import frontier as G  # noqa: E402
from ferret.operators import reports as R  # noqa: E402
from ferret.operators import stored_index as I  # noqa: E402
from ferret.session import build_session  # noqa: E402
from ferret.sources import adapters as A  # noqa: E402
from ferret.sources import sinks as K  # noqa: E402
from ferret.sources.tables import read_table  # noqa: E402
from ferret.streaming.percolate import percolate  # noqa: E402


def run(df):
    df.write.format("noop").mode("overwrite").save()


WARMUP_DIRS = os.environ.get("BENCH_WARMUP_DIRS", "/root/testdata/sf0.001:/root/testdata/sf0.01").split(":")


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    scratch = tempfile.mkdtemp(prefix="ferret-bench-", dir=os.environ.get("BENCH_SCRATCH"))
    warm = 0.0
    if os.environ.get("BENCH_WARMUP", "1") == "1":
        # One untimed pass of the same jobs on each of the smaller tables warms the JVM (JIT) and
        # starts the Python workers; its duration is reported as warmup_sec.
        t0 = time.perf_counter()
        for small in filter(os.path.isdir, WARMUP_DIRS):
            jobs(spark, small, tempfile.mkdtemp(dir=scratch), {}, {})
        warm = round(time.perf_counter() - t0, 3)
    times, counts = {}, {}
    jobs(spark, sf_dir, tempfile.mkdtemp(dir=scratch), times, counts)
    total = round(sum(times.values()), 3)
    thr = {
        "pages_per_sec": round(counts["pages"] / times["extract"], 1),
        "docs_per_sec_index": round(counts["documents"] / times["index"], 1),
        "queries_per_sec": round(counts["queries"] / times["search"], 2),
    }
    print(json.dumps({"metric": "total_time", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
                      "throughput": thr, "rows": counts, "warmup_sec": warm}))
    spark.stop()


def jobs(spark, sf_dir, scratch, times, counts):

    def timed(name, fn):
        t0 = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - t0, 3)

    pages = read_table(spark, sf_dir, "pages")
    res = A.read_doc_resources(spark, sf_dir)
    qry = A.read_queries(spark, sf_dir)
    counts["pages"] = pages.count()
    counts["documents"] = res.count()
    counts["queries"] = qry.count()

    timed("extract", lambda: run(X.extract_resources(pages, query="the")))
    index_dir = os.path.join(scratch, "index")
    timed("index", lambda: I.write_index(res, index_dir))
    index = I.open_index(spark, index_dir)
    timed("search", lambda: run(I.search(index, qry)["hits"]))
    timed("snapshot", lambda: run(I.snapshot(index, qry)))
    labels = A.label_updates(read_table(spark, sf_dir, "labels"))
    timed("upsert", lambda: K.upsert_resources(K.dedupe_resources(res), labels)
          .write.mode("overwrite").parquet(os.path.join(scratch, "resources_v1")))
    recs = res.select(F.col("doc_id").alias("record_id"),
                      F.lower(F.concat_ws(" ", "title", "description")).alias("text"))
    timed("percolate", lambda: run(percolate(recs, A.read_queries(spark, sf_dir))))
    links = A.lineitem_links(read_table(spark, sf_dir, "lineitem"))
    seeds = read_table(spark, sf_dir, "nation").select(
        F.concat(F.lit("https://n.example.com/"), F.col("n_nationkey").cast("string")).alias("url"))
    timed("reachable", lambda: run(G.reachable(seeds, links)))
    timed("reports", lambda: (run(R.index_stats(res)), run(R.terms(res, "domain", 20))))


if __name__ == "__main__":
    main()
