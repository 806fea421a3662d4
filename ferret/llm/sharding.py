"""Sharding by weighted rendezvous hashing (DataFrame functions only).

Every shard scores every key with ``weight / -ln(u)``, u a uniform hash of (key, shard); the
highest score wins. Adding a shard only adds one score, so a row either stays or goes to the
new shard, and shares follow the weights.

Slots number the rows of a shard without a gap, in two steps. Rows fall by hash into
``buckets`` groups per shard, equal rows counted as one first, so no key makes a large group. A running sum
over bucket totals (``buckets`` rows per shard) gives each bucket's first slot; rows are
numbered inside their bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096
#: Bytes that a row weighs besides its text.
ROW_BYTES = 16


def shard_score(key: Column, shard: int, weight: float = 1.0) -> Column:
    """The score of one shard for a key; higher wins."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.lit(float(weight)) / -F.log(u)


def pick_shard(key: Column, weights: list[float]) -> Column:
    """struct(score, shard) of the winning shard; the lower shard wins an equal score."""
    best = F.greatest(*[F.struct(shard_score(key, s, w).alias("score"), F.lit(-s).alias("shard")) for s, w in enumerate(weights)]) \
        if len(weights) > 1 else F.struct(shard_score(key, 0, weights[0]).alias("score"), F.lit(0).alias("shard"))
    return best


def with_shard(docs: DataFrame, weights: list[float], id_col: str = "doc_id", shard_col: str = "shard") -> DataFrame:
    """The table with its shard number, for writing: ``.write.partitionBy(shard_col)``."""
    return docs.withColumn(shard_col, -pick_shard(F.col(id_col), weights).getField("shard"))


def assign_shards(docs: DataFrame, weights: list[float], grown: float | None = 1.0, id_col: str = "doc_id",
                  text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and grown_shard, a row per input row.

    size: UTF-8 bytes of the text plus 16. grown_shard: the shard once one more, of weight
    ``grown``, is added. A null text is empty (size 16, CRC 0); a null id is a key of its
    own; repeated rows share a shard and take a slot each; a key with many rows is one
    shard's, as the rule asks, but its slots are dealt in many groups by text; an empty
    table gives no rows.
    """
    key, text = F.col("id"), F.coalesce(F.col("t"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t")).select(
        "id", (F.length(text) + F.lit(ROW_BYTES)).cast("bigint").alias("size"), F.crc32(text).alias("crc"))
    rows = rows.groupBy("id", "size", "crc").agg(F.count(F.lit(1)).alias("times"))
    best = pick_shard(key, weights)
    more = shard_score(key, len(weights), grown) if grown is not None else F.lit(-1.0)
    rows = rows.withColumn("best", best).select(
        "id", "size", "crc", "times", (-F.col("best.shard")).alias("shard"),
        F.when(more > F.col("best.score"), F.lit(len(weights))).otherwise(-F.col("best.shard")).alias("grown_shard"),
        F.pmod(F.xxhash64("id", "size", "crc"), F.lit(buckets)).cast("int").alias("bucket"))
    totals = rows.groupBy("shard", "bucket").agg(F.sum("times").alias("total"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select("shard", "bucket", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "bucket").orderBy("id", "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("local", F.coalesce(F.sum("times").over(inside), F.lit(0))).join(firsts, ["shard", "bucket"])
    return placed.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), "shard", "grown_shard",
        F.explode(F.sequence(F.col("base") + F.col("local"), F.col("base") + F.col("local") + F.col("times") - 1)).alias("slot"))
