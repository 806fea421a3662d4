"""Upsert rules, frontier helpers and the live feed."""

import hashlib
import os
import uuid
from collections import deque

from pyspark.sql import functions as F

from ferret.operators import frontier as G
from ferret.schema import RESOURCE_SCHEMA
from ferret.sources import sinks as K
from ferret.sources.tables import conform_resources
from ferret.streaming import live as L
from ferret.streaming.percolate import percolate
from tests.conftest import SF001


def _existing(spark):
    rows = spark.createDataFrame(
        [(1, "https://a/1", "T1", "tutorial", 0.5), (2, "https://a/2", "T2", "video", 0.9)],
        "doc_id long, url string, title string, type string, quality_score double")
    return conform_resources(rows.withColumn("resource_id", F.md5("url")))


def test_upsert_null_overwrite_absent_kept_last_wins(spark):
    inc = spark.createDataFrame([(1, "https://a/1", None, 0.1), (2, "https://a/1", None, 0.2),
                                 (3, "https://a/9", "article", 0.3)],
                                "load_seq long, url string, type string, quality_score double")
    out = {r.url: r for r in K.upsert_resources(_existing(spark), inc).collect()}
    assert out["https://a/1"].type is None                   # NULL overwrites
    assert out["https://a/1"].quality_score == 0.2           # last write wins in the batch
    assert out["https://a/1"].title == "T1"                  # absent column kept
    assert out["https://a/1"].is_new is False and out["https://a/9"].is_new is True
    assert out["https://a/2"].touched is False


def test_upsert_idempotent(spark):
    inc = spark.createDataFrame([(1, "https://a/1", "x")], "load_seq long, url string, type string")
    once = K.upsert_resources(_existing(spark), inc).drop("is_new", "touched")
    twice = K.upsert_resources(once, inc).drop("is_new", "touched")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_replace_is_whole_row(spark):
    inc = spark.createDataFrame([(5, "https://a/1", "new")], "load_seq long, url string, title string")
    out = {r.url: r for r in K.replace_resources(_existing(spark), inc).collect()}
    assert out["https://a/1"].title == "new" and out["https://a/1"].type is None
    assert out["https://a/2"].type == "video"


def test_md5_mod_matches_python(spark):
    urls = [f"https://x/{i}" for i in range(50)]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [r[0] for r in df.select(G.md5_mod("url", 7)).collect()]
    assert got == [int(hashlib.md5(u.encode()).hexdigest(), 16) % 7 for u in urls]


def test_seed_if_empty_both_branches(spark):
    empty = spark.createDataFrame([], "url_hash string")
    seeds = G.seed_table(spark)
    assert G.seed_if_empty(empty, empty, seeds).count() == 24
    seen = spark.createDataFrame([(hashlib.md5(b"x").hexdigest(),)], "url_hash string")
    assert G.seed_if_empty(empty, seen, seeds).count() == 0


def test_reachable_matches_bfs(spark):
    edges = [(f"n{i}", f"n{(i * 7 + 3) % 40}") for i in range(40)] + [("n1", "n2"), ("n2", "n30")]
    links = spark.createDataFrame(edges, "src_url string, dst_url string")
    seeds = spark.createDataFrame([("n0",)], "url string")
    got = {r.url: r.depth for r in G.reachable(seeds, links, max_depth=5).collect()}
    adj = {}
    for s, d in edges:
        adj.setdefault(s, []).append(d)
    depth, dq = {"n0": 0}, deque(["n0"])
    while dq:
        u = dq.popleft()
        if depth[u] == 5:
            continue
        for v in adj.get(u, []):
            if v not in depth:
                depth[v] = depth[u] + 1
                dq.append(v)
    assert got == depth


def test_percolate_equals_brute_force(spark):
    texts = ["the cat and the hat", "aaaa", "nothing", "cat", ""]
    qs = [(1, "the cat"), (2, "aa"), (3, "dog"), (4, "  ")]
    recs = spark.createDataFrame(list(enumerate(texts)), "record_id long, text string")
    q = spark.createDataFrame(qs, "query_id long, q string")
    got = {(r.record_id, r.query_id): r.score for r in percolate(recs, q).collect()}
    exp = {}
    for i, t in enumerate(texts):
        for qid, qq in qs:
            words = qq.lower().split()
            if words and all(w in t for w in words):
                exp[(i, qid)] = sum(t.count(w) for w in set(words))
    assert got == exp


def test_percolate_counts_repeats_short_words_and_spans(spark):
    recs = spark.createDataFrame([(0, "the cat the"), (1, "xaby b"), (2, ""), (3, None), (4, "ab\tcatalog THE")],
                                 "record_id long, text string")
    q = spark.createDataFrame([(1, "The the"), (2, "ab"), (3, "b b"), (4, "the dog"), (5, None), (6, "cat a")],
                              "query_id long, q string")
    got = {(r.record_id, r.query_id): r.score for r in percolate(recs, q).collect()}
    # "the the" sums its word twice; (4, 6): cat 1, a in "ab" and twice in "catalog"
    assert got == {(0, 1): 4, (1, 2): 1, (1, 3): 4, (4, 2): 1, (4, 3): 2, (0, 6): 2, (4, 6): 4}
    assert percolate(recs, q.where("query_id > 99")).count() == 0


def test_assign_worker_leaves_nothing_out(spark):
    rows = spark.createDataFrame([(f"https://a/{i}", 1, i, 0) for i in range(300)], "url string, batch long, src_seq long, pos int")
    assert G.assign_worker(rows, ["w0", "w1"]).count() == 300
    assert G.assign_worker(rows, ["w0", "w1"], window=101).count() == 101


def test_resource_stream_makes_a_log(spark, tmp_path):
    from ferret.operators.extract import extract_resources
    from ferret.sources.tables import read_table, table_path
    base = str(tmp_path / "t")
    L.resource_stream(spark, table_path(SF001, "pages"), base, str(tmp_path / "ck"), query="the").awaitTermination()
    t = K.logged_table(spark, base)
    want = extract_resources(read_table(spark, SF001, "pages"), query="the")
    assert sorted(r.url for r in t.collect()) == sorted(r.url for r in want.collect()) and t.count() > 0


def test_log_of_three_micro_batches(spark, tmp_path):
    """Later items replace earlier ones, NULLs included, whatever micro-batch they came in; a second run adds nothing."""
    base = str(tmp_path)
    schema = "load_seq long, url string, title string, type string"
    for part in ([(1, "https://a/1", "T1", "video"), (2, "https://a/2", "T2", "article")], [(3, "https://a/1", "T3", None)], [(5, "https://a/3", "T5", "video"), (4, "https://a/3", "T4", "x")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    for _ in range(2):
        items = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        K.log_stream(items, f"{base}/log", f"{base}/ckpt").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{base}/log").count() == 5
    t = {r.url: (r.title, r.type) for r in K.logged_table(spark, f"{base}/log").collect()}
    assert t == {"https://a/1": ("T3", None), "https://a/2": ("T2", "article"), "https://a/3": ("T5", "video")}
    old = conform_resources(spark.createDataFrame([("https://a/1", "old", "d")], "url string, title string, description string").withColumn("resource_id", F.md5("url")))
    merged = {r.url: (r.title, r.description) for r in K.logged_table(spark, f"{base}/log", old).collect()}
    assert merged["https://a/1"] == ("T3", "d") and len(merged) == 3


def test_upsert_reads_either_side_once(spark, tmp_path):
    _existing(spark).write.parquet(str(tmp_path / "e"))
    inc = spark.createDataFrame([(1, "https://a/1", "x")], "load_seq long, url string, type string")
    for f in (K.upsert_resources, K.replace_resources):
        plan = f(spark.read.parquet(str(tmp_path / "e")), inc)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1


def test_fan_out_channels(spark):
    feed = spark.createDataFrame([("a", "q1"), ("b", None)], "id string, query string")
    got = sorted((r.channel, r.id) for r in L.fan_out(feed).collect())
    assert got == [("search:results:all", "a"), ("search:results:all", "b"), ("search:results:q1", "a")]


def test_percolate_stream_equals_batch(spark, tmp_path):
    from ferret.sources.adapters import documents_as_resources, benchmark_queries
    from ferret.sources.tables import read_table, table_path
    docs = read_table(spark, SF001, "documents")
    q = benchmark_queries(read_table(spark, SF001, "benchmark"), n_words=2)
    def recs(df):
        r = documents_as_resources(df)
        return r.select(F.col("doc_id").alias("record_id"),
                        F.lower(F.concat_ws(" ", "title", "description")).alias("text"))
    batch = {(r.record_id, r.query_id, r.score) for r in percolate(recs(docs), q).collect()}
    stream = recs(L.stream_files(spark, docs.schema, table_path(SF001, "documents")))
    out = str(tmp_path / "p")
    L.percolate_stream(spark, stream, q, out, str(tmp_path / "c")).awaitTermination()
    got = {(r.record_id, r.query_id, r.score) for r in spark.read.parquet(out).collect()}
    assert got == batch and len(got) > 0


def test_reachable_spreads_hub_links(spark):
    links = spark.createDataFrame([("hub", f"p{i}") for i in range(20)] + [("p3", "q"), ("q", "hub")], "src_url string, dst_url string")
    seeds = spark.createDataFrame([("hub",)], "url string")
    for hub_edges in (3, 100):
        got = {(r.url, r.depth) for r in G.reachable(seeds, links, max_depth=2, hub_edges=hub_edges).collect()}
        assert got == {("hub", 0), ("q", 2)} | {(f"p{i}", 1) for i in range(20)}


def test_publish_resources(spark):
    import json
    rows = [("u1", "The Cat", "and the hat", "article", ["en", "fr"]), ("u2", None, "cat", None, None), ("u3", 'q"\n', None, "x", [])]
    df = spark.createDataFrame(rows, "url string, title string, description string, type string, languages array<string>").withColumn(
        "timestamp", F.to_timestamp(F.lit("2024-01-01 00:00:05")))
    got = {(r.channel, r.url): json.loads(r.payload) for r in L.publish_resources(df, "the cat").collect()}
    assert set(got) == {("search:results:the cat", "u1")} | {("crawler:new_resources", u) for u in ("u1", "u2", "u3")}
    assert got["crawler:new_resources", "u1"] == got["search:results:the cat", "u1"] == {
        "url": "u1", "title": "The Cat", "description": "and the hat", "type": "article", "language": "en", "timestamp": "2024-01-01T00:00:05", "score": 3}
    assert got["crawler:new_resources", "u3"] == {"url": "u3", "title": 'q"\n', "type": "x", "timestamp": "2024-01-01T00:00:05"}
    assert {r.channel for r in L.publish_resources(df).collect()} == {"crawler:new_resources"}


def test_messages_of_a_subscription(spark):
    import json
    stats = spark.createDataFrame([(1, "q", 7), (2, "r", 0), (3, "s", 1)], "query_id long, q string, total long")
    results = spark.createDataFrame([(1, 2, 5, 1.5, "u", "T", None, "x", "en"), (3, 1, 6, 1.0, "v", None, None, None, None)],
                                    "query_id long, rank int, id long, score double, url string, title string, description string, type string, language string")
    live = spark.createDataFrame([(1, 1, "w", 4)], "query_id long, rank int, url string, score long")
    subs = spark.createDataFrame([(1, '{"type": "a"}'), (2, None), (3, "{bad"), (4, "[1]"), (5, "")], "query_id long, filters string")
    errors = L.filter_errors(subs)
    assert sorted(r.query_id for r in errors.collect()) == [3, 4]
    got = [(r.query_id, r.type, json.loads(r.json)) for r in L.messages(stats, results, live, errors).orderBy("query_id", "seq").collect()]
    assert [g[1] for g in got] == ["stats", "result", "status", "result", "stats", "status", "error", "error"]
    assert got[1][2] == {"type": "result", "data": {"id": 5, "score": 1.5, "url": "u", "title": "T", "type": "x", "language": "en", "source": "elasticsearch"}}
    assert got[3][2] == {"type": "result", "data": {"url": "w", "score": 4}, "source": "realtime"}
    assert got[6][2]["data"]["message"].startswith("Search error: ")


def test_start_urls_of_workers(spark):
    pending = spark.createDataFrame([("w1", f"u{i}", 0, i, 0) for i in range(12)], "worker string, url string, batch long, src_seq long, pos int")
    jobs = spark.createDataFrame([(1, "w1", ["x"]), (2, "w2", ["a", "b"]), (3, "w3", None), (4, "w4", [])], "job_id long, worker string, start_urls array<string>")
    got = {}
    for r in G.distributed_start_urls(jobs, pending).orderBy("job_id", "pos").collect():
        got.setdefault(r.job_id, []).append(r.url)
    from ferret import rules
    assert got[1] == [f"u{i}" for i in range(10)] and got[2] == ["a", "b"] and got[3] == got[4] == rules.DEFAULT_START_URLS_DISTRIBUTED


def test_sample_as_json_lines(spark, tmp_path):
    import json
    df = conform_resources(spark.createDataFrame([(2, "https://b", None), (1, "https://a", "ü\n")], "doc_id long, url string, title string"))
    K.write_json(K.export_sample(df, 5), str(tmp_path / "j"))
    lines = [json.loads(x) for p in sorted((tmp_path / "j").glob("*.json")) for x in p.read_text().splitlines()]
    assert [x["doc_id"] for x in lines] == [1, 2] and lines[0]["title"] == "ü\n" and "description" in lines[1] and lines[1]["title"] is None
