"""BM25 sums of whole documents for a batch of queries, as an Arrow function inside a task.

A document is a list of its fields' tokens. Only query terms are looked at; a term's share in a field is worked out once and then
added to every query that has the term, so no row per (query, term, document) is made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (document, field, query) cells that are summed at a time.
CELLS = 300_000
#: Tokens that are looked up, postings that are weighed, and uses of a posting by a query that are summed at a time.
TOKENS, POSTINGS, USES = 500_000, 500_000, 2_000_000
#: Code of a field's own row among the counts of its terms.
WHOLE = -1


def packed(weights: DataFrame, fields: list, boosts: dict, codes: list | None = None) -> dict:
    """The weights (query_id, field, term, qtf, idf, avgdl) as arrays: a term's code (its place in ``codes``, where given) leads to its
    weight per field and to its queries."""
    rows = weights.collect()
    terms = {t: n for n, t in enumerate(sorted({r.term for r in rows}) if codes is None else codes)}
    ids = {q: n for n, q in enumerate(dict.fromkeys(r.query_id for r in rows))}
    idf, avgdl = np.zeros((len(fields), max(len(terms), 1))), np.ones(len(fields))
    uses = sorted({(terms[r.term], ids[r.query_id], r.qtf) for r in rows})
    for r in rows:
        idf[fields.index(r.field), terms[r.term]] = r.idf
        avgdl[fields.index(r.field)] = r.avgdl
    many = np.bincount([u[0] for u in uses], minlength=max(len(terms), 1)) if uses else np.zeros(1, "int64")
    return {"terms": list(terms), "ids": list(ids), "idf": idf, "avgdl": avgdl, "many": many, "start": np.cumsum(many) - many,
            "query": np.array([u[1] for u in uses], "int64"), "qtf": np.array([u[2] for u in uses], "float64"),
            "boosts": np.array([boosts.get(f, 1.0) for f in fields])}


def sums_of(w: dict, doc, field, code, share, n: int):
    """(documents x queries) scores of the best boosted field, from each posting's share; documents are numbered 0 to n - 1."""
    times = w["many"][code]
    at = np.repeat(w["start"][code] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    n_fields, n_queries = len(w["avgdl"]), len(w["ids"])
    cell = np.repeat((doc * n_fields + field) * n_queries, times) + w["query"][at]
    sums = np.bincount(cell, np.repeat(share, times) * w["qtf"][at], n * n_fields * n_queries).reshape(n, n_fields, n_queries)
    return (sums * w["boosts"][None, :, None]).max(axis=1)


def shares_of(w: dict, k1: float, b: float, parts: pa.Array):
    """(document, field, term's code, share) of each posting of documents as ``hits_of`` takes them."""
    size = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False)
    flat = parts.flatten()
    field, dl = (pc.struct_field(flat, c).to_numpy(zero_copy_only=False) for c in ("field", "dl"))
    row, code, tf = tokens_found(w["terms"], flat) if flat.type.get_field_index("tokens") >= 0 else counts_found(flat)
    f = field[row]
    return np.repeat(np.arange(len(parts)), size)[row], f, code, w["idf"][f, code] * (tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * dl[row] / w["avgdl"][f])))


def blocks_of(w: dict, k1: float, b: float, parts: pa.Array, step: int):
    """(first document, scores) of ``step`` documents at a time, at most. A document's postings are summed at once."""
    n = len(parts)
    some = max(1, n * POSTINGS // max(len(parts.flatten()), 1))
    step = min(step, some)
    some = some // step * step
    for top in range(0, n, some):
        doc, f, code, share = shares_of(w, k1, b, parts.slice(top, some))
        uses = np.cumsum(np.concatenate([[0], np.bincount(doc, w["many"][code], min(some, n - top))]))
        for first in range(0, len(uses) - 1, step):
            last, low, held = min(first + step, len(uses) - 1), first, []
            while low < last:
                high = min(last, max(low + 1, int(np.searchsorted(uses, uses[low] + USES, "right")) - 1))
                a, z = np.searchsorted(doc, [low, high])
                held.append(sums_of(w, doc[a:z] - low, f[a:z], code[a:z], share[a:z], high - low))
                low = high
            yield top + first, np.concatenate(held)


class Best:
    """Which scores may be among a query's ``limit`` best URLs (``per_url``) or records of all, by those of one batch alone.

    A record has its URL and, for each kind of filter, whether it passes; ``kinds`` says which of these each query asks for. A score is
    left out where the batch has ``limit`` that are better by more than rounding can move them, so what is left holds the best of all."""

    MARGIN = 2e-6

    def __init__(self, w: dict, records: pa.Array, limit: int, per_url: bool, kinds: dict):
        flat = records.flatten()
        size = pc.fill_null(pc.list_value_length(records), 0).to_numpy(zero_copy_only=False)
        self.doc = np.repeat(np.arange(len(records)), size)
        url = pc.struct_field(flat, "url").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) if per_url else np.arange(len(flat))
        self.url, self.limit, self.least = url, max(limit, 1), np.zeros(len(w["ids"]))
        passes = pc.struct_field(flat, "passes").flatten().to_numpy(zero_copy_only=False)
        n_kinds = len(passes) // max(len(flat), 1)
        self.passes = passes.astype("float32").reshape(len(flat), n_kinds)
        self.asked = np.zeros((n_kinds, len(w["ids"])), "float32")
        for n, q in enumerate(w["ids"]) if n_kinds else ():
            self.asked[list(kinds.get(q, ())), n] = 1

    def of(self, scores, low: int):
        """Of the documents from ``low`` on (documents x queries): whether a score is left."""
        a, z = np.searchsorted(self.doc, [low, low + len(scores)])
        left = np.zeros(scores.shape, bool)
        if a == z:
            return left
        doc, url = self.doc[a:z] - low, self.url[a:z]
        own = np.where(self.passes[a:z] @ self.asked > 0, scores[doc], 0)
        order = np.argsort(url, kind="stable")
        tops = np.maximum.reduceat(own[order], np.flatnonzero(np.concatenate([[True], np.diff(url[order]) != 0])), axis=0)
        if len(tops) >= self.limit:
            self.least = np.maximum(self.least, np.partition(tops, len(tops) - self.limit, axis=0)[len(tops) - self.limit])
        good = (own > 0) & (own >= self.least - self.MARGIN)
        starts = np.flatnonzero(np.concatenate([[True], np.diff(doc) != 0]))
        left[doc[starts]] = np.logical_or.reduceat(good, starts, axis=0)
        return left


def tokens_found(terms: list, parts: pa.Array):
    """(part, term's code, tf) of the terms in lists of tokens, some lists at a time."""
    tokens = pc.struct_field(parts, "tokens")
    known, n_terms = pa.array(terms, pa.string()), max(len(terms), 1)
    ends = np.cumsum(np.concatenate([[0], pc.list_value_length(tokens).to_numpy(zero_copy_only=False)]))
    rows, codes, counts = [np.zeros(0, "int64")], [np.zeros(0, "int64")], [np.zeros(0, "int64")]
    low = 0
    while low < len(parts):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + TOKENS, "right")) - 1)
        code = pc.index_in(tokens.slice(low, high - low).flatten(), value_set=known)
        at = np.flatnonzero(pc.is_valid(code).to_numpy(zero_copy_only=False))
        row = np.searchsorted(ends, at + ends[low], "right") - 1
        key, tf = np.unique(row * n_terms + pc.drop_null(code).to_numpy(zero_copy_only=False), return_counts=True)
        rows.append(key // n_terms), codes.append(key % n_terms), counts.append(tf)
        low = high
    return np.concatenate(rows), np.concatenate(codes), np.concatenate(counts)


def counts_found(parts: pa.Array):
    """The same of terms that were counted before (``counts_of``): a part is one term of a field."""
    code, tf = (pc.struct_field(parts, c).to_numpy(zero_copy_only=False) for c in ("code", "tf"))
    row = np.flatnonzero(code != WHOLE)
    return row, code[row], tf[row]


def counts_of(terms: list, parts: pa.Array) -> pa.Array:
    """Documents as lists of (field, dl, tokens) to lists of (field, dl, code, tf) of the terms, after a row of the code WHOLE for each field."""
    flat = parts.flatten()
    row, code, tf = tokens_found(terms, flat)
    row, code, tf = (np.concatenate(x) for x in ((np.arange(len(flat)), row), (np.full(len(flat), WHOLE), code), (np.ones(len(flat), "int64"), tf)))
    order = np.argsort(row, kind="stable")
    row = row[order]
    field, dl = (pc.struct_field(flat, c).to_numpy(zero_copy_only=False)[row] for c in ("field", "dl"))
    size = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False)
    ends = np.searchsorted(row, np.concatenate([[0], np.cumsum(size)]))
    each = [pa.array(x, pa.int32()) for x in (field, dl, code[order], tf[order])]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(each, ["field", "dl", "code", "tf"]))


def hits_of(w: dict, k1: float, b: float, kind: pa.DataType, parts: pa.Array, best: Best | None = None) -> pa.Array:
    """Documents as lists of (field, dl, tokens) or (field, dl, code, tf) to lists of (query_id, score)."""
    ids = pa.array(w["ids"], kind)
    held, queries, found = [], [pa.array([], kind)], [np.zeros(0)]
    for low, scores in blocks_of(w, k1, b, parts, max(1, CELLS // max(len(w["avgdl"]) * len(w["ids"]), 1))):
        d, q = np.nonzero(scores > 0 if best is None else best.of(scores, low))
        held.append(np.bincount(d, minlength=len(scores)))
        queries.append(ids.take(pa.array(q)))
        found.append(scores[d, q])
    ends = np.concatenate([[0], np.cumsum(np.concatenate(held))]) if held else np.zeros(1)
    hits = pa.StructArray.from_arrays([pa.concat_arrays(queries), pa.array(np.concatenate(found))], ["query_id", "score"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hits)


def shared_weights(weights: DataFrame, fields: list, boosts: dict, codes: list | None = None) -> tuple:
    """The weights (at most query terms x fields rows), collected and broadcast, with the type of query_id."""
    return weights.sparkSession.sparkContext.broadcast(packed(weights, fields, boosts, codes)), weights.schema["query_id"].dataType


def counts_column(spark: SparkSession, terms: list, parts: Column) -> Column:
    """``counts_of`` a document given as array<struct(field, dl, tokens)>, a term's code being its place in ``terms``."""
    from ..session import ship_package
    ship_package(spark)
    known = spark.sparkContext.broadcast(terms)

    def counts(p):
        return counts_of(known.value, p)

    counts.__annotations__ = {"p": pa.Array, "return": pa.Array}
    return F.arrow_udf(counts, "array<struct<field:int,dl:int,code:int,tf:int>>")(parts)


def hits_column(spark: SparkSession, shared: tuple, k1: float, b: float, parts: Column, records: Column | None = None, limit: int = 0, per_url: bool = False,
                kinds: dict | None = None) -> Column:
    """array<struct(query_id, score)> of a document given as array<struct(field, dl, tokens)> or array<struct(field, dl, code, tf)>, field a
    position in the fields of the ``shared_weights``. With ``records``, array<struct(url, passes)> of a document, scores are left out that
    cannot be among the ``limit`` best of a query (see ``Best``)."""
    from pyspark.sql.pandas.types import to_arrow_type

    from ..session import ship_package
    ship_package(spark)
    known, kind = shared
    arrow, kinds = to_arrow_type(kind), kinds or {}

    def hits(p):
        return hits_of(known.value, k1, b, arrow, p)

    def best_hits(p, r):
        return hits_of(known.value, k1, b, arrow, p, Best(known.value, r, limit, per_url, kinds))

    hits.__annotations__ = {"p": pa.Array, "return": pa.Array}
    best_hits.__annotations__ = {"p": pa.Array, "r": pa.Array, "return": pa.Array}
    out = f"array<struct<query_id:{kind.simpleString()},score:double>>"
    return F.arrow_udf(hits, out)(parts) if records is None else F.arrow_udf(best_hits, out)(parts, records)
