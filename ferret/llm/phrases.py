"""Phrase collocations by vertically partitioned, depth-truncated suffix trees (ERA style).

The suffixes of all pieces, cut at ``max_words`` words, form a forest by their first words. It
is built in three passes over the texts, each counting inside chunks of a task first:

1. single words (the roots);
2. pairs of words that occur often enough by themselves (the prefixes of the partition), sent as
   one row per first word and chunk;
3. suffixes whose successive pairs are all frequent, cut where one is not. A phrase is frequent
   only if all its pairs are, so nothing that counts is lost.

Prefixes are dealt to groups that hold about ``BUDGET`` suffixes each; the suffixes of a prefix
above the budget are dealt by all their words. A group's suffixes are sorted by words (Spark's sort, which
spills), and its subtrees are read off the sorted rows, batch by batch: a node's count is
the total of the leaves below it. Nodes that a batch or a heavy prefix cuts are emitted in parts and summed up.

What a task holds is bounded by a chunk or a batch, whatever the corpus is. Broadcast are two
filters of fixed size, fewer than ``MAX_COMMON`` first words, and fewer than ``MAX_GROUPS`` prefixes above the budget.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, prepare
from .vocabulary import FILTER_BITS, Numbering, pair_hashes, passes, word_filter, word_hashes

MAX_WORDS = 5
MIN_COUNT = 100
TOP = 2000
#: Words of a chunk, and suffixes of a group of prefixes.
CHUNK_WORDS, BUDGET = 2_000_000, 4_000_000
MAX_GROUPS = 1 << 16
#: A first word with more than this part of all words is heavy: the words after it are dealt to PARTS groups. There are fewer than MAX_COMMON.
MAX_COMMON, PARTS = 4096, 64
OUT_ROWS = 50_000

# FIXED VALUES: what ends a piece. Words are separated by spaces and tabs.
BREAKS = re.compile(rb"[.,;:!?\x0A-\x0D]+")
#: Stands for the end of a piece; no word holds a full stop.
END = b"."


def piece_words(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text, A-Z lower-cased, with END between pieces."""
    return BREAKS.sub(b" . ", text.lower()).split()


def _chunks(batches, size):
    """(language, distinct words, word numbers) of chunks of documents; number 0 ends a piece."""
    open_, held = {}, 0
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            if lang not in open_:
                open_[lang] = (Numbering({END: 0}), [])
            index, lists = open_[lang]
            words = piece_words(text)
            words.append(END)
            lists.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
            held += len(words)
            if held >= size:
                yield from ((k, list(i), np.concatenate(x)) for k, (i, x) in open_.items())
                open_, held = {}, 0
    yield from ((k, list(i), np.concatenate(x)) for k, (i, x) in open_.items())


def _batches(lang, words, columns, n, names):
    """Rows of word numbers (0: none) as strings, with their counts."""
    words = pa.array(words, pa.binary()).cast(pa.string())
    for lo in range(0, len(n), OUT_ROWS):
        part = [words.take(pa.array(c[lo:lo + OUT_ROWS], mask=c[lo:lo + OUT_ROWS] == 0)) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part[0]), pa.string()), *part, pa.array(n[lo:lo + OUT_ROWS])], names)


def _words(size):
    def run(batches):
        for lang, words, ids in _chunks(batches, size):
            n = np.bincount(ids, minlength=len(words))
            yield from _batches(lang, words, [np.arange(1, len(words))], n[1:], ["lang", "w1", "n"])
    return run


def _pairs(frequent, heavy, size):
    """Per first word (and part of a heavy one) the words that follow it in a chunk, in one row."""
    def run(batches):
        for lang, words, ids in _chunks(batches, size):
            h = word_hashes(words, lang)
            good = passes(frequent.value, h)
            good[0] = False
            parted = np.fromiter(((lang, w) in heavy.value for w in words), bool, len(words))
            at = np.flatnonzero(good[ids[:-1]] & good[ids[1:]])
            key, n = np.unique(ids[at] << 32 | ids[at + 1], return_counts=True)
            first, second = key >> 32, key & 0xFFFFFFFF
            part = np.where(parted[first], (h[second] >> np.uint64(20)).astype(np.int64) % PARTS, 0)
            order = np.lexsort((part, first))
            first, second, part, n = first[order], second[order], part[order], n[order]
            starts = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (part[1:] != part[:-1])])) if len(first) else np.zeros(0, np.int64)
            text = pa.array(words, pa.binary()).cast(pa.string())
            ends = np.append(starts[1:], len(first))
            for lo in range(0, len(starts), OUT_ROWS):
                row = slice(lo, lo + OUT_ROWS)
                at, to = starts[row], ends[row][-1]
                offsets = pa.array(np.append(at, to) - at[0], pa.int32())
                joined = pc.binary_join(pa.ListArray.from_arrays(offsets, text.take(pa.array(second[at[0]:to]))), " ")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), text.take(pa.array(first[at])), pa.array(part[at]), joined,
                     pa.ListArray.from_arrays(offsets, pa.array(n[at[0]:to], pa.int32()))], ["lang", "w1", "part", "followers", "counts"])
    return run


FOLLOWERS = "lang string, w1 string, part long, followers string, counts array<int>"


def _follower_counts(least):
    """Pair counts from rows sorted by first word and part; the pairs of rows that a batch cuts are emitted whatever their count."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            new = np.ones(b.num_rows, bool)
            new[1:] = False
            for c in ("lang", "w1", "part"):
                new[1:] |= pc.not_equal(b.column(c)[1:], b.column(c)[:-1]).to_numpy(zero_copy_only=False)
            run_of = np.cumsum(new) - 1
            lists = pc.split_pattern(b.column("followers"), " ")
            table = pa.table({"run": run_of[pc.list_parent_indices(lists).to_numpy()], "w2": pc.list_flatten(lists), "n": pc.list_flatten(b.column("counts")).cast(pa.int64())})
            sums = table.group_by(["run", "w2"]).aggregate([("n", "sum")])
            r, n = sums.column("run").to_numpy(), sums.column("n_sum").to_numpy()
            keep = (n >= least) | (r == 0) | (r == run_of[-1])
            at, rows = pa.array(np.flatnonzero(new)[r[keep]]), sums.filter(pa.array(keep))
            for part in pa.table([b.column("lang").take(at), b.column("w1").take(at), rows.column("w2"), rows.column("n_sum")], ["lang", "w1", "w2", "n"]).to_batches(OUT_ROWS):
                yield part
    return run


def _suffixes(frequent, depth, size):
    names = ["lang", *(f"w{i + 1}" for i in range(depth)), "n"]

    def run(batches):
        for lang, words, ids in _chunks(batches, size):
            h = word_hashes(words, lang)
            good = np.zeros(len(ids) + depth, bool)
            inside = np.flatnonzero((ids[:-1] != 0) & (ids[1:] != 0))
            good[inside] = passes(frequent.value, pair_hashes(h[ids[inside]], h[ids[inside + 1]]))
            at = np.flatnonzero(good[:-1] & good[1:])
            padded = np.concatenate([ids, np.zeros(depth, np.int64)])
            columns, on = [ids[at], padded[at + 1]], np.ones(len(at), bool)
            for i in range(2, depth):
                on = on & good[at + i - 1]
                columns.append(np.where(on, padded[at + i], 0))
            packed = [a << 32 | b for a, b in zip(columns[::2], [*columns[1::2], np.zeros(len(at), np.int64)], strict=False)]
            order = np.lexsort(packed[::-1])
            new = np.zeros(len(at), bool)
            new[:1] = True
            for p in packed:
                p = p[order]
                new[1:] |= p[1:] != p[:-1]
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(at)))
            yield from _batches(lang, words, [c[order][first] for c in columns], n, names)
    return run


def _subtrees(depth, least):
    """Node counts of depth 3 and more from suffixes sorted by words."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            cols = [pc.fill_null(b.column(f"w{i + 1}"), "") for i in range(depth)]
            n, split = b.column("n").to_numpy(), b.column("heavy").to_numpy(zero_copy_only=False)
            new = np.ones(b.num_rows, bool)
            new[1:] = pc.not_equal(b.column("lang")[1:], b.column("lang")[:-1]).to_numpy(zero_copy_only=False)
            for d in range(1, depth + 1):
                w = cols[d - 1]
                new = new.copy()
                new[1:] |= pc.not_equal(w[1:], w[:-1]).to_numpy(zero_copy_only=False)
                if d < 3:
                    continue
                starts = np.flatnonzero(new)
                total = np.add.reduceat(n, starts)
                parted = split[starts] & (d < depth)  # other groups hold more of the node
                parted[[0, -1]] = True  # other batches may
                keep = (pc.not_equal(w, "").to_numpy(zero_copy_only=False))[starts] & (parted | (total >= least))
                rows = pa.array(starts[keep])
                phrase = pc.binary_join_element_wise(*(c.take(rows) for c in cols[:d]), " ")
                yield pa.RecordBatch.from_arrays([b.column("lang").take(rows), phrase, pa.array(total[keep])], ["lang", "phrase", "n"])
    return run


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT,
                  budget: int = BUDGET, filter_bits: int = FILTER_BITS, chunk_words: int = CHUNK_WORDS) -> tuple[DataFrame, DataFrame]:
    """Two tables: (lang, phrase, words, n) of every phrase of 1 to ``max_words`` words (3 at least) that occurs
    ``min_count`` times or more, overlaps included, and (lang, total) of all word occurrences."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    every = materialise(rows.mapInArrow(_words(chunk_words), "lang string, w1 string, n long").groupBy("lang", "w1").agg(F.sum("n").alias("n")), "words")
    totals = every.groupBy("lang").agg(F.sum("n").alias("total"))
    roots = every.where(F.col("n") >= min_count)
    often = word_filter(roots.select(F.col("lang").alias("space"), "w1", F.lit(None).cast("string").alias("w2")), filter_bits)
    corpus = totals.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first()["n"]
    common = roots.where(F.col("n") > max(corpus // MAX_COMMON, min_count)).select("lang", F.col("w1").cast("binary")).collect()
    heavy_roots = spark.sparkContext.broadcast(frozenset((r[0], bytes(r[1])) for r in common))
    followers = rows.mapInArrow(_pairs(often, heavy_roots, chunk_words), FOLLOWERS).repartition("lang", "w1", "part").sortWithinPartitions("lang", "w1", "part")
    pairs = materialise(followers.mapInArrow(_follower_counts(min_count), "lang string, w1 string, w2 string, n long").groupBy("lang", "w1", "w2")
                        .agg(F.sum("n").alias("n")).where(F.col("n") >= min_count), "pairs")
    chained = word_filter(pairs.select(F.col("lang").alias("space"), "w1", "w2"), filter_bits)
    mass = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    room = max(budget, -(-mass // MAX_GROUPS))
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-mass // room))
    heavy = pairs.where(F.col("n") > room).select("lang", "w1", "w2", F.lit(True).alias("heavy"))
    names = [f"w{i + 1}" for i in range(max_words)]
    schema = ", ".join(["lang string", *(f"{c} string" for c in names), "n long"])
    leaves = rows.mapInArrow(_suffixes(chained, max_words, chunk_words), schema).join(F.broadcast(heavy), ["lang", "w1", "w2"], "left") \
        .withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    spread = F.when(F.col("heavy"), F.xxhash64(*names[2:])).otherwise(F.lit(0))
    nodes = leaves.withColumn("spread", spread).repartition(groups, "lang", "w1", "w2", "spread").sortWithinPartitions("lang", *names) \
        .select("lang", *names, "n", "heavy").mapInArrow(_subtrees(max_words, min_count), "lang string, phrase string, n long")
    deep = nodes.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    counts = roots.select("lang", F.col("w1").alias("phrase"), "n").unionByName(pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "n")).unionByName(deep)
    return materialise(counts.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "n"), "phrases"), totals


def mine_collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int = TOP,
                      budget: int = BUDGET, filter_bits: int = FILTER_BITS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of 2 to ``max_words`` words of each language.

    a is a phrase's count, n the language's word occurrences. Cut after its first k words, a
    phrase's parts occur l and r times; the cut with the lowest floor(1000 * a * n / (l * r)) counts,
    of equal ones the earliest. Phrases inside a longer one that occurs as often are left out. The order is
    score and a falling, then the phrase's bytes.

    Null text is empty, a null language is ``und``; empty texts add nothing. Repeated rows count each. A text of any length is read
    whole. An empty table gives no rows. Products are held in 38 digits.
    """
    counts, totals = phrase_counts(docs, lang_col, text_col, max_words, min_count, budget, filter_bits, chunk_words)
    found = counts.where("words >= 2")
    shorter = lambda at: F.array_join(F.slice(F.split("phrase", " "), at, F.col("words") - 1), " ").alias("phrase")
    longer = found.where("words >= 3")
    inside = longer.select("lang", shorter(1), "n").unionByName(longer.select("lang", shorter(2), "n")).distinct()
    left = found.join(inside, ["lang", "phrase", "n"], "left_anti")
    cuts = left.select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words")), " ").alias("rest"))
    known = lambda part, n: counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(n))
    cuts = cuts.join(known("first", "l"), ["lang", "first"]).join(known("rest", "r"), ["lang", "rest"]).join(totals.withColumnRenamed("total", "n"), "lang")
    big = lambda c: f"cast({c} as decimal(19,0))"
    score = F.expr(f"cast(cast(1000 as decimal(4,0)) * ({big('a')} * {big('n')}) as decimal(38,0)) div ({big('l')} * {big('r')})")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
