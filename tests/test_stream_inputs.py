"""Inputs of the stream queries: tables of part files, and micro-batches of several files."""

from pyspark.sql import functions as F

from ferret.plans import q_stream as Q
from ferret.streaming import live as L


def _drain(stream, tmp_path):
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def test_stream_of_a_table_of_part_files(spark, tmp_path):
    df = spark.range(100)
    df.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = _drain(L.stream_files(spark, df.schema, str(tmp_path / "documents.parquet")), tmp_path)
    assert sorted(r.id for r in got.collect()) == list(range(100))


def test_micro_batches_of_several_files(spark, tmp_path):
    df = spark.range(0, 9000, 1, 9).withColumn("v", F.col("id") * 2)
    stream = Q._in_batches(df, "id", str(tmp_path / "in"))
    counts = [r["count"] for r in spark.read.parquet(str(tmp_path / "in")).groupBy(F.input_file_name()).count().collect()]
    assert len(counts) == 9 and max(counts) < 1500
    assert _drain(stream, tmp_path).agg(F.count("*"), F.sum("v")).first()[:] == (9000, 9000 * 8999)


def test_stored_rows_are_made_once(spark):
    from ferret.session import stored
    df = stored(spark.range(5).withColumn("u", F.expr("uuid()")), "t")
    assert df.collect() == df.collect() and df.count() == 5


def test_reachable_reads_its_links_unsorted(spark, monkeypatch):
    """Hubs are broadcast and the frontier is a hash table: no hop sorts the edges."""
    from ferret.operators import frontier as G
    frame = type(spark.range(1))
    plans, keep = [], frame.checkpoint
    monkeypatch.setattr(frame, "checkpoint", lambda self, *a: (plans.append(self._jdf.queryExecution().executedPlan().toString()), keep(self, *a))[1])
    links = spark.createDataFrame([("a", f"b{i}") for i in range(9)] + [("b1", "c"), ("c", "a")], "src_url string, dst_url string")
    got = {(r.url, r.depth) for r in G.reachable(spark.createDataFrame([("a",)], "url string"), links, max_depth=3, hub_edges=4).collect()}
    assert got == {("a", 0), ("c", 2)} | {(f"b{i}", 1) for i in range(9)}
    hops = [p for p in plans if "ShuffledHashJoin [url" in p]
    assert len(hops) == 3 and not any("SortMergeJoin [src_url" in p for p in plans)


def test_records_of_the_stream_are_read_without_a_join(spark):
    """Records that arrive in micro-batches are one projection of the documents, as every group of them reads it anew."""
    from conftest import SF001

    from ferret.plans.q_stream import _records
    recs = _records(spark, SF001, "timestamp")
    assert recs.columns == ["record_id", "text", "url", "timestamp"]
    assert "Join" not in recs._jdf.queryExecution().optimizedPlan().toString()
    joined = _records(spark, SF001).join(_records(spark, SF001, "timestamp").select("record_id", "timestamp"), "record_id")
    assert recs.exceptAll(joined.select(*recs.columns)).count() == 0 and recs.count() == joined.count()
