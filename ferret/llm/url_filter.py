"""URL filtering by dated lists: a temporal list join.

List entries are dated additions and removals of a target (a host or a domain above it). Per list
and target, in the order of their time, they become validity intervals [from, until). Every
capture is joined, as of its fetch time, with the intervals of its host and the domains above it:
an equality join on the target, with the time test beside it. Neighbouring additions are one interval.

The host with a third of all captures is one skewed key of that join; its side is split by
Spark's skew handling, and no list is broadcast by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """The lower-cased host, without user info, port and trailing dot; '' where there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(found, r"^.*@", ""), r":[0-9]*$", "")
    return F.lower(F.regexp_replace(bare, r"\.$", ""))


def domains(name: Column) -> Column:
    """The host and every domain above it with at least two labels."""
    labels = F.split(name, r"\.", -1)
    n = F.size(labels)
    above = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.when(name == "", F.array().cast("array<string>")).otherwise(F.array_distinct(above))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, target, since, until) from entries (list, target, action 'add' or 'remove', at).

    until is null while nothing ends the entry. Entries with a null list, target, action or time
    are left out. At one time a removal wins over an addition. Repeated entries have no effect.
    """
    one = entries.select("list", F.lower("target").alias("target"), "at", (F.col("action") == "add").alias("on")) \
        .where("list IS NOT NULL AND target IS NOT NULL AND at IS NOT NULL AND on IS NOT NULL") \
        .groupBy("list", "target", "at").agg(F.bool_and("on").alias("on"))
    order = Window.partitionBy("list", "target").orderBy("at")
    changes = one.withColumn("was", F.coalesce(F.lag("on").over(order), F.lit(False))).where("on != was")
    return changes.withColumn("until", F.lead("at").over(order)).where("on").select("list", "target", F.col("at").alias("since"), "until")


def filter_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """capture id, fetch time, host, lists (names of the lists that hold the capture at its fetch time, sorted,
    comma-joined), n_entries and blocked, a row per capture.

    A null or unparsable URL has host '' and is on no list; a null fetch time is on no list. Captures that repeat
    id, URL and time have a row each. Empty tables: no captures, no rows; no entries, nothing blocked.
    """
    rows = captures.select(F.col(id_col).alias("id"), host(F.col(url_col)).alias("host"), F.col(time_col).alias("at")) \
        .groupBy("id", "host", "at").agg(F.count(F.lit(1)).alias("times"))
    wanted = rows.select("id", "host", "at", F.explode(domains(F.col("host"))).alias("target"))
    held = wanted.join(intervals(entries), "target").where("since <= at AND (until IS NULL OR at < until)")
    hits = held.groupBy("id", "host", "at").agg(F.collect_set("list").alias("lists"), F.count(F.lit(1)).alias("n_entries"))
    hits = hits.select(F.col("id").alias("hid"), F.col("host").alias("hhost"), F.col("at").alias("hat"), "lists", "n_entries")
    same = F.col("id").eqNullSafe(F.col("hid")) & (F.col("host") == F.col("hhost")) & F.col("at").eqNullSafe(F.col("hat"))
    out = rows.join(hits, same, "left").select(
        F.col("id").alias(id_col), F.col("at").alias(time_col), "host", F.coalesce(F.array_join(F.array_sort("lists"), ","), F.lit("")).alias("lists"),
        F.coalesce("n_entries", F.lit(0)).cast("bigint").alias("n_entries"), F.col("n_entries").isNotNull().alias("blocked"), "times")
    return out.select("*", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "col")
