"""Repeated runs of lines, by hashes of all their windows (DataFrame functions only).

A document is the sequence of its non-blank lines, white space normalised. Every window of ``run``
consecutive lines is materialised with the 128-bit MD5 of its text, and windows are grouped by that
hash: all but the first occurrence of a window are repeats. Overlapping repeats together are the longest
repeated runs; their lines, and blank lines inside, are deleted. First means the smallest document id, then the
smallest position.

This is not winnowing with extension. Each window also carries the least line hash in it, and windows
whose least hash occurs once are left out before the grouping; equal windows share it, so this saves
work and decides nothing. No positions are joined and no match is extended: a run is found
by each of its windows, so the result is that of joining and extending, for a row per line instead
of one per fingerprint.

With ``words`` there are also windows measured by their content: the shortest run from a line on that holds so
many words, one line if it is long enough. The registered query does without, as its SQL does: there
a passage on one or two lines stays, however often it repeats.

Only rows of equal window text meet, by a partial aggregate and a join that Spark can
split, so a line that a third of all documents hold is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import integer_id, materialise

#: Lines of a run that is deleted when repeated.
RUN = 3
SPACE = r"[\x20\x09-\x0D]+"


def _lines(text):
    """Non-blank lines as (place among all lines, normalised line, hash with the place negated: least hash, rightmost)."""
    every = F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(i.alias("at"), F.trim(F.regexp_replace(line, SPACE, " ")).alias("line")))
    return F.filter(every, lambda x: x["line"] != "")


def mark_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, words: int | None = None) -> DataFrame:
    """doc_id, text, n_lines, removed (places of deleted lines, from 0) and kept_text, a row per input row.

    Null text is one empty line and keeps being null in ``text`` (kept_text is empty). Texts with fewer than ``run`` non-blank lines
    lose nothing, unless ``words`` is given and a line or a shorter run holds so many. Null ids come last in the order of occurrence; repeated rows are ordered among themselves,
    so one keeps its lines. An empty table gives no rows.
    """
    docs = materialise(docs.select(integer_id(docs, id_col).alias("id"), F.col(text_col).alias("text"))
                       .withColumn("rid", F.monotonically_increasing_id()), "lines")
    last = F.lit((1 << 63) - 1)
    seq = docs.select("rid", F.coalesce("id", last).alias("id"), _lines(F.coalesce("text", F.lit(""))).alias("seq")).where(F.size("seq") >= (1 if words else run))
    count = lambda line: [F.size(F.split(line, " ")).alias("c")] if words else []
    seq = seq.withColumn("h", F.transform("seq", lambda x, i: F.struct(F.xxhash64(x["line"]).alias("h"), (-i).alias("i"), *count(x["line"]))))

    if words:
        held = lambda s, n: F.aggregate(F.slice("h", s + 1, n), F.lit(0), lambda a, x: a + x["c"])
        least = lambda s, n: (held(s, n) >= words) & (held(s, n - 1) < words)
        lengths = lambda s: F.filter(F.sequence(F.lit(1), F.lit(run)), lambda n: (s + n <= F.size("seq")) & ((n == run) | least(s, n)))
        places = F.flatten(F.transform(F.sequence(F.lit(0), F.size("seq") - 1), lambda s: F.transform(lengths(s), lambda n: F.struct(s.alias("s"), n.alias("n")))))
    else:
        places = F.transform(F.sequence(F.lit(0), F.size("seq") - run), lambda s: F.struct(s.alias("s"), F.lit(run).alias("n")))
    windows = F.transform(places, lambda p: F.struct(
        F.array_min(F.slice("h", p["s"] + 1, p["n"])).getField("h").alias("f"), p["s"].alias("s"),
        F.unhex(F.md5(F.array_join(F.transform(F.slice("seq", p["s"] + 1, p["n"]), lambda x: x["line"]), "\n"))).alias("w"),
        F.element_at("seq", p["s"] + 1)["at"].alias("lo"), F.element_at("seq", p["s"] + p["n"])["at"].alias("hi")))
    rows = materialise(seq.select("rid", "id", F.explode(windows).alias("x")).select("rid", "id", "x.*"), "windows")
    # Windows whose least hash occurs once repeat nowhere: this saves work and decides nothing.
    repeated = rows.groupBy("f").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("f")
    near = rows.join(repeated, "f", "left_semi")
    least = near.groupBy("w", "id", "rid").agg(F.min("s").alias("s")).groupBy("w").agg(
        F.count(F.lit(1)).alias("places"), F.min(F.struct("id", "rid", "s")).alias("first"))
    found = near.join(least, "w").where(F.struct("id", "rid", "s") != F.col("first"))
    gone = found.select("rid", F.explode(F.sequence("lo", "hi")).alias("at")).groupBy("rid").agg(F.collect_set("at").alias("removed"))
    out = docs.join(gone, "rid", "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    # The lines enter as a lambda's variable, else the text would be split anew for every line.
    kept = F.element_at(F.transform(F.array(lines), lambda every: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(every) - 1), removed), lambda i: F.element_at(every, i + 1)), "\n")), 1)
    return out.select(F.col("id").alias("doc_id"), "text", F.size(lines).alias("n_lines"), F.array_sort(removed).alias("removed"),
                      F.when(F.size(removed) == 0, F.coalesce("text", F.lit(""))).otherwise(kept).alias("kept_text"))
