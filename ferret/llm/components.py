"""Connected components by alternating large-star and small-star steps (DataFrame joins only).

Each step replaces a node's edges by edges to its smallest neighbour; a few rounds turn every
component into a star around its smallest node. A round's edges are written to the shared
folder, so lineage stays short; nothing but two numbers per round reaches the driver. A hub
is a skewed join key, never a collected group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    joined = large.join(low, "u")
    small = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(low.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every node of ``edges`` (u, v; bigint) that isn't its component's
    smallest node; label is that smallest node. Loops and repeated edges have no effect."""
    now = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        now = materialise(_stars(now), "edges")
        state, before = _state(now), state
        if state == before:
            break
    return now.select(F.col("u").alias("v"), F.col("v").alias("label"))


def _state(edges: DataFrame) -> tuple:
    """Rows, and two sums that change when an edge does."""
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("a"),
                  F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("b")).first()
    return r["n"], r["a"], r["b"]
