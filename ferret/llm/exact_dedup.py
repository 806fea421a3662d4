"""Exact deduplication by a heavy-hitter split (DataFrame functions only).

A Misra-Gries summary of the digests, ``1 / support`` counters per task and merged the same
way, holds every digest that more than ``support`` of the rows carry. A second look counts
those few exactly; the ones that are really heavy, at most ``1 / support`` of them, are
broadcast with their winner, and their rows are decided map-side. All other digests, each with fewer
than that share of the rows, go through an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import integer_id, materialise

#: Share of the rows from which a digest is heavy. 1 / SUPPORT bounds counters and broadcast rows.
SUPPORT = 0.005
SPACE = r"[\x20\x09-\x0D]+"


def text_digest(text: Column) -> Column:
    """SHA-256 (lowercase hex) of the text with runs of white space as one space; null is empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256)


def heavy_digests(rows: DataFrame, support: float) -> DataFrame:
    """The digests (column sha) that more than ``support`` of the rows carry; at most 1 / support rows."""
    found = rows.stat.freqItems(["sha"], support).select(F.explode("sha_freqItems").alias("sha")).distinct()
    total = rows.count()
    counts = rows.join(F.broadcast(found), "sha", "left_semi").groupBy("sha").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > support * total).select("sha")


def _winners(rows: DataFrame) -> DataFrame:
    """Per digest: the smallest id, the rows, and the rows with that id (1 unless rows repeat)."""
    by_row = rows.groupBy("sha", "id").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("rid"))
    order = F.coalesce(F.col("id"), F.lit((1 << 63) - 1))  # null ids last
    return by_row.groupBy("sha").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"),
                                     F.min_by("n", order).alias("keep_rows"), F.min_by("rid", order).alias("keep_rid"))


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return materialise(docs.select(integer_id(docs, id_col).alias("id"), text_digest(F.col(text_col)).alias("sha"))
                       .withColumn("rid", F.monotonically_increasing_id()), "digests")


def _decide(rows: DataFrame, wide: DataFrame, support: float) -> DataFrame:
    """``wide`` (with column sha) joined to its digest's winner; rows: the digest table."""
    heavy = materialise(heavy_digests(rows, support), "heavy")
    few = F.broadcast(_winners(rows.join(F.broadcast(heavy), "sha", "left_semi")))
    rest = _winners(rows.join(F.broadcast(heavy), "sha", "left_anti"))
    return wide.join(few, "sha").unionByName(wide.join(F.broadcast(heavy), "sha", "left_anti").join(rest, "sha"))


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256, a row per input row.

    Of rows with equal normalised texts the one with the smallest id is kept. Null text is
    empty. Null ids come after all others (keep_id is null only if all are). Of rows that
    repeat both id and text one is kept. An empty table gives no rows.
    """
    rows = _digests(docs, id_col, text_col)
    return _decide(rows, rows, support).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"),
        F.col("sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The kept rows of ``mark_duplicates`` with all their columns. Where a kept row repeats
    with the same id, one of the repeats stays."""
    rows = _digests(docs, id_col, text_col)
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(id_col).cast("bigint").alias("id"), text_digest(F.col(text_col)).alias("sha"), F.monotonically_increasing_id().alias("place"))
    found = _decide(rows, wide, support).where(F.col("id").eqNullSafe(F.col("keep_id")))
    once = found.where(F.col("keep_rows") == 1).select("row")
    # The first of them in reading order; whole rows need not be comparable (a map is not).
    again = found.where(F.col("keep_rows") > 1).groupBy("sha").agg(F.min_by("row", "place").alias("row")).select("row")
    return once.unionByName(again).select("row.*")
