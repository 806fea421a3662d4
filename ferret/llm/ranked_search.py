"""Ranked lexical search by range maxima over posting lists.

One pass over the documents counts terms and keeps the postings of query terms, in blocks of
documents that one task reads together. From the postings come the document frequencies, and with
the numbers of all blocks the corpus statistics, so every impact (a term's share of a score) is final
before any search.

In each block a posting list, in the order of document ids, gets a sparse table of its impacts'
maxima. A query's search keeps intervals of documents by their bound: the sum over its terms
of the maximum impact in the interval. The interval with the highest bound is split at the document with the largest
single impact, which is scored; intervals of at most ``LEAF`` documents are scored whole. It ends
when no bound can still enter the block's best. The best of all blocks are merged by a window per query,
``size`` rows from a block.

A block's postings are bounded by its terms. Queries are broadcast; a table of more than
``QUERY_BYTES`` of text is searched in parts, each with its own pass, and every part's broadcast is below that size (or holds
one query).
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, materialise, prepare
from .vocabulary import Numbering, passes, word_filter, word_hashes

SIZE = 10
#: Terms and documents of a block; documents of an interval that is scored whole.
BLOCK_TERMS, BLOCK_DOCS = 1 << 20, 1 << 14
LEAF = 128
QUERY_BYTES = 8 << 20

# FIXED VALUES: bytes of terms (digits, letters, everything beyond ASCII) and the score's constants.
TERM_BYTES = frozenset([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
LENGTH_SHARE, SCALE = 75, 1_000_000_000
TERMS = bytes(b if b in TERM_BYTES else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, A-Z lower-cased."""
    return text.translate(TERMS).lower().split()


#: A block's row without a term holds its documents: id, null flag and number of terms of each.
POSTINGS = "block long, term binary, n_docs long, n_terms long, docs binary, counts binary"


def _postings(wanted, block_terms):
    def run(batches):
        block, index, docs, lists, held = TaskContext.get().partitionId() << 32, Numbering(), [], [], 0
        for b in batches:
            for doc, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                found = terms(text)
                if not found:
                    continue
                docs.append((doc or 0, doc is None, len(found)))
                lists.append(np.fromiter(map(index.__getitem__, found), np.int64, len(found)))
                held += len(found)
                if held >= block_terms or len(docs) == BLOCK_DOCS:
                    yield from _block(block, wanted, index, docs, lists)
                    block, index, docs, lists, held = block + 1, Numbering(), [], [], 0
        if docs:
            yield from _block(block, wanted, index, docs, lists)
    return run


def _block(block, wanted, index, docs, lists):
    words, names = list(index), ["block", "term", "n_docs", "n_terms", "docs", "counts"]
    asked = passes(wanted.value, word_hashes(words))
    ids, place = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    one = lambda values, kind: pa.array(values, kind)
    yield pa.RecordBatch.from_arrays([one([block], pa.int64()), one([None], pa.binary()), one([len(docs)], pa.int64()), one([len(ids)], pa.int64()),
                                      one([np.array(docs, "<i8").tobytes()], pa.binary()), one([None], pa.binary())], names)
    keep = asked[ids]
    key, tf = np.unique(ids[keep] << 32 | place[keep], return_counts=True)
    if not len(key):
        return
    cuts = np.flatnonzero(np.diff(key >> 32)) + 1
    starts = np.concatenate([[0], cuts])
    n = np.diff(np.append(starts, len(key)))
    parts = lambda x: pa.array([p.tobytes() for p in np.split(x, cuts)], pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), block)), pa.array([words[i] for i in key[starts] >> 32], pa.binary()), pa.array(n),
                                      pa.nulls(len(starts), pa.int64()), parts((key & 0xFFFFFFFF).astype("<u4")), parts(tf.astype("<u4"))], names)


class Block:
    """The posting lists of one block with range maxima. Documents are numbered in the order of their ids."""

    def __init__(self, ids, n_terms, lists, corpus_docs, corpus_terms, frequencies, leaf=LEAF):
        """lists: term -> (places of documents, counts); ids: sorted; frequencies: term -> documents of the corpus."""
        self.ids, self.leaf = ids, leaf
        self.size = len(ids)
        length = 100 - LENGTH_SHARE + LENGTH_SHARE * n_terms * corpus_docs // max(corpus_terms, 1)
        self.number, docs, impacts, ends = {}, [], [], [0]
        for term, (place, tf) in lists.items():
            weight = math.floor(1000 * math.log((2 * corpus_docs + 2) / (2 * frequencies[term] + 1)))
            order = np.argsort(place)
            place, tf = place[order].astype(np.int64), tf[order].astype(np.int64)
            self.number[term] = len(self.number)
            docs.append(place + self.size * len(docs))
            impacts.append(weight * (SCALE * tf // (1000 * tf + 8 * length[place])))
            ends.append(ends[-1] + len(place))
        self.keys = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        self.ends = np.array(ends)
        level = np.concatenate(impacts) if impacts else np.zeros(0, np.int64)
        # Level k holds the maxima of 2**k neighbours; lists lie end to end, and no range crosses one's end.
        self.levels, width = [level], 1
        longest = int(np.diff(self.ends).max(initial=1))
        while 2 * width <= longest:
            level = level.copy()
            level[:-width] = np.maximum(level[:-width], level[width:])
            self.levels.append(level)
            width *= 2
        self.levels = np.stack(self.levels)

    def maxima(self, lo, hi):
        """Largest impact of every range lo:hi (0 of an empty one)."""
        n = hi - lo
        full = n > 0
        k = np.frexp(np.maximum(n, 1))[1] - 1
        lo = np.where(full, lo, 0)
        out = np.maximum(self.levels[k, lo], self.levels[k, np.where(full, hi - (1 << k), 0)])
        return np.where(full, out, 0)

    def first_at(self, lo, hi, value):
        """The first place in lo:hi whose impact is ``value``, the range's maximum."""
        while hi - lo > 1:
            k = (hi - lo).bit_length() - 1
            width = 1 << k
            if width == hi - lo:
                width >>= 1
                k -= 1
            if self.levels[k, lo] == value:
                hi = lo + width
            else:
                lo += width
        return lo

    def best(self, query, size):
        """(score, place) of the ``size`` best documents of a query [(term, times)], equal scores by place."""
        known = [(self.number[t], n) for t, n in query if t in self.number]
        if not known:
            return []
        rows, times = np.array([r for r, _ in known]), np.array([n for _, n in known], np.int64)
        lo, hi, base, impact = self.ends[rows], self.ends[rows + 1], rows * self.size, self.levels[0]
        kept = []  # a heap of (score, -place): the worst on top

        def offer(score, place):
            if score > 0 and (len(kept) < size or (score, -place) > kept[0]):
                (heapq.heappush if len(kept) < size else heapq.heapreplace)(kept, (score, -place))

        def possible(bound, first):
            return bound > 0 and (len(kept) < size or (bound, -first) > kept[0])

        def push(a, b, lo, hi):
            if a < b:
                tops = times * self.maxima(lo, hi)
                bound = int(tops.sum())
                if possible(bound, a):
                    heapq.heappush(heap, (-bound, a, b, lo, hi, tops))

        heap = []
        push(0, self.size, lo, hi)
        while heap:
            bound, a, b, lo, hi, tops = heapq.heappop(heap)
            if not possible(-bound, a):
                if -bound < kept[0][0]:
                    break
                continue
            if b - a <= self.leaf:
                n = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                score = np.zeros(b - a, np.int64)
                np.add.at(score, self.keys[at] - np.repeat(base, n) - a, impact[at] * np.repeat(times, n))
                for i in np.argsort(-score, kind="stable")[:size]:
                    offer(int(score[i]), a + int(i))
                continue
            t = int(np.argmax(tops))
            place = int(self.keys[self.first_at(int(lo[t]), int(hi[t]), tops[t] // times[t])] - base[t])
            cut = np.searchsorted(self.keys, base + place)
            has = (cut < hi) & (self.keys[np.minimum(cut, len(self.keys) - 1)] == base + place)
            offer(int((times[has] * impact[cut[has]]).sum()), place)
            push(a, place, lo, cut)
            push(place + 1, b, cut + has, hi)
        return sorted(((s, -p) for s, p in kept), key=lambda x: (-x[0], x[1]))


def read_block(table, corpus_docs, corpus_terms, frequencies, leaf):
    """The rows of one block as a Block, and the ids of its documents (None: null, sorted last)."""
    head = table.filter(pc.is_null(table.column("term")))
    docs = np.frombuffer(head.column("docs")[0].as_py(), "<i8").reshape(-1, 3)
    order = np.lexsort((docs[:, 0], docs[:, 1]))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    lists = {}
    rows = table.filter(pc.is_valid(table.column("term")))
    for term, at, tf in zip(*(rows.column(c).to_pylist() for c in ("term", "docs", "counts")), strict=True):
        if term in frequencies:
            lists[term] = place[np.frombuffer(at, "<u4")], np.frombuffer(tf, "<u4")
    ids = [None if null else int(i) for i, null, _ in docs[order]]
    return Block(ids, docs[order, 2], lists, corpus_docs, corpus_terms, frequencies, leaf)


def _search(plan, size, leaf):
    schema = pa.schema([("query", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(table):
        queries, corpus_docs, corpus_terms, frequencies = plan.value
        block = read_block(table, corpus_docs, corpus_terms, frequencies, leaf)
        found = [(q, block.ids[place], score) for q, asked in queries for score, place in block.best(asked, size)]
        return pa.Table.from_arrays([pa.array([r[i] for r in found], pa.int64()) for i in range(3)], schema=schema)
    return run


def _search_part(rows: DataFrame, queries: list, size: int, block_terms: int, leaf: int) -> DataFrame:
    """query, doc_id, score: the best of every block for queries [(number, text)]."""
    spark = rows.sparkSession
    asked = []
    for number, text in queries:
        index = Numbering()
        found = terms((text or "").encode())
        times = np.bincount(np.fromiter(map(index.__getitem__, found), np.int64, len(found)), minlength=len(index))
        asked.append((number, list(zip(index, times.tolist(), strict=True))))
    wanted = sorted({t for _, q in asked for t, _ in q})
    names = spark.createDataFrame(pa.table({"space": pa.array([""] * len(wanted), pa.string()), "w1": pa.array([t.decode() for t in wanted], pa.string()),
                                            "w2": pa.nulls(len(wanted), pa.string())}))
    postings = materialise(rows.mapInArrow(_postings(word_filter(names), block_terms), POSTINGS), "postings")
    corpus = postings.where("term is null").agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("terms")).first()
    held = postings.where("term is not null").groupBy("term").agg(F.sum("n_docs").alias("n")) \
        .join(F.broadcast(names.select(F.col("w1").cast("binary").alias("term"))), "term", "left_semi").toArrow()  # a row per query term
    frequencies = dict(zip(held.column("term").to_pylist(), held.column("n").to_pylist(), strict=True))
    plan = spark.sparkContext.broadcast((asked, corpus["docs"], corpus["terms"], frequencies))
    # A partition for every block: by their bytes, many blocks would be one task's work.
    return postings.repartition(max(corpus["blocks"], 1), "block").groupBy("block").applyInArrow(_search(plan, size, leaf), "query long, doc_id long, score long")


def ranked_search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id",
                  query_text: str = "text", size: int = SIZE, query_bytes: int = QUERY_BYTES, block_terms: int = BLOCK_TERMS, leaf: int = LEAF) -> DataFrame:
    """The query's id, rank (from 1), doc_id and score: the ``size`` documents of highest score above 0 for every query.

    Equal scores are ordered by id, null ids last; repeated documents are ranked each. A repeated query is searched for
    each of its rows; a null query id stays null. Null, empty and term-less texts have no terms: such documents count nowhere, such
    queries find nothing. Without documents or queries there are no rows. Texts of any length are read whole.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = id_text(docs, id_col, text_col, binary=True)
    asked = materialise(queries.select(F.col(query_id).alias("name"), F.col(query_text).alias("text")).withColumn("query", F.monotonically_increasing_id()), "queries")
    sizes = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    total = asked.agg(F.coalesce(F.sum(sizes), F.lit(0)).alias("n")).first()["n"]
    parts = [None]
    if total > query_bytes:  # running sums of sizes, so every part stays within the bound
        by_size = Window.orderBy("query").rowsBetween(Window.unboundedPreceding, 0)
        share = asked.select("query", sizes.alias("n")).select("query", F.floor(F.sum("n").over(by_size) / query_bytes).alias("part"))
        asked = materialise(asked.join(share, "query"), "queries")
        parts = [r["part"] for r in asked.select("part").distinct().orderBy("part").collect()]
    found = None
    for part in parts:
        some = asked if part is None else asked.where(F.col("part") == part)
        hits = _search_part(rows, [(r["query"], r["text"]) for r in some.select("query", "text").collect()], size, block_terms, leaf)
        found = hits if found is None else found.unionByName(hits)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    return best.join(F.broadcast(asked.select("query", "name")) if len(parts) == 1 else asked.select("query", "name"), "query") \
        .select(F.col("name").alias(query_id), "rank", "doc_id", "score")
