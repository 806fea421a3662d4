"""Token counts from pre-token frequencies.

Each task splits its documents into pre-tokens and emits, per chunk of documents, one row
per distinct pre-token: the documents of the chunk that hold it and how often. Rows are
dealt out by pre-token, so every distinct pre-token meets its frequencies in one place; it is
run through the merges once, and its piece count times each frequency goes back to the
documents as partial sums, packed per chunk. Token ids never exist. A pre-token held by hundreds of documents
of a chunk is salted by chunk, so a common word is spread over up to ``SALTS`` tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import bpe
from .common import id_text, prepare

#: A chunk is closed at so many pre-tokens; it bounds a task's memory. Documents in a chunk
#: are numbered in 16 bits.
CHUNK_TOKENS, CHUNK_DOCS = 3_000_000, 1 << 16
HOT_DOCS, SALTS = 512, 256
OUT_ROWS, HELD_SUMS = 50_000, 2_000_000

FREQUENCIES = "pretoken string, salt long, chunk long, postings binary"
PARTIALS = "chunk long, documents binary, sums binary"
COUNTS = "doc_id long, n_bytes long, n_tokens long"


class _Index(dict):
    def __missing__(self, key):
        self[key] = i = len(self)
        return i


def _frequencies(path):
    def run(batches):
        b = bpe(path)
        chunk = TaskContext.get().partitionId() << 16
        index, docs, lists, held = _Index(), [], [], 0
        for batch in batches:
            for doc, data in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = data.decode()
                if not b.spaced or not b.plain_specials:  # another kind of file: whole texts
                    docs.append((doc or 0, doc is None, len(data), len(b.tok.encode(text, add_special_tokens=False))))
                    lists.append(np.zeros(0, np.int64))
                else:
                    parts = [text]
                    for s in b.specials:
                        parts = [y for x in parts for y in x.split(s)]
                    found = [np.fromiter(map(index.__getitem__, p := b.pretokens(x)), np.int64, len(p)) for x in parts if x]
                    lists.append(np.concatenate(found) if found else np.zeros(0, np.int64))
                    docs.append((doc or 0, doc is None, len(data), len(parts) - 1))
                held += len(lists[-1])
                if held >= CHUNK_TOKENS or len(docs) == CHUNK_DOCS:
                    yield from _chunk(chunk, index, docs, lists)
                    index, docs, lists, held, chunk = _Index(), [], [], 0, chunk + 1
        if docs:
            yield from _chunk(chunk, index, docs, lists)
    return run


def _chunk(chunk, index, docs, lists):
    names = ["pretoken", "salt", "chunk", "postings"]
    yield pa.RecordBatch.from_arrays(
        [pa.array([None], pa.string()), pa.array([chunk]), pa.array([chunk]), pa.array([np.array(docs, "<i8").tobytes()], pa.binary())], names)
    if not index:
        return
    key = np.concatenate(lists) << 16 | np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    key, times = np.unique(key, return_counts=True)
    if times.max() > 0xFFFF:  # more than a posting holds: several postings
        n = -(-times // 0xFFFF)
        key, last = np.repeat(key, n), times - (n - 1) * 0xFFFF
        times = np.full(len(key), 0xFFFF)
        times[np.cumsum(n) - 1] = last
    pairs = np.empty((len(key), 2), "<u2")
    pairs[:, 0], pairs[:, 1] = key & 0xFFFF, times
    held = np.bincount(key >> 16, minlength=len(index))
    offsets = np.concatenate([[0], np.cumsum(held)])
    words = list(index)
    salt = np.where(held >= HOT_DOCS, chunk % SALTS, 0)
    for lo in range(0, len(words), OUT_ROWS):
        hi = min(len(words), lo + OUT_ROWS)
        at = ((offsets[lo:hi + 1] - offsets[lo]) * 4).astype(np.int32)
        data = pairs[offsets[lo]:offsets[hi]].tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array(words[lo:hi], pa.string()), pa.array(salt[lo:hi]), pa.array(np.full(hi - lo, chunk)),
             pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data)])], names)


def _pieces(path):
    def run(batches):
        b, known = bpe(path), {}
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        more: list = []
        for batch in batches:
            meta = batch.filter(batch.column("pretoken").is_null())
            if meta.num_rows:
                yield pa.RecordBatch.from_arrays([meta.column("chunk"), meta.column("postings"), pa.nulls(meta.num_rows, pa.binary())], ["chunk", "documents", "sums"])
            batch = batch.filter(batch.column("pretoken").is_valid())
            if not batch.num_rows:
                continue
            words = batch.column("pretoken").dictionary_encode()
            # rows are sorted by pre-token, so only the last batch's words can come again
            known = {w: known[w] if w in known else len(b.pieces(w)) for w in words.dictionary.to_pylist()}
            each = np.fromiter(known.values(), np.int64, len(known))[words.indices.to_numpy()]
            raw = pa.concat_arrays([batch.column("postings")])
            at = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset:raw.offset + len(raw) + 1]
            pairs = np.frombuffer(raw.buffers()[2], "<u2")[at[0] // 2:at[-1] // 2].reshape(-1, 2).astype(np.int64)
            held = np.diff(at) // 4
            more.append((np.repeat(batch.column("chunk").to_numpy() << 16, held) | pairs[:, 0], np.repeat(each, held) * pairs[:, 1]))
            if sum(len(k) for k, _ in more) >= HELD_SUMS:
                keys, sums = _reduce([(keys, sums), *more])
                more = []
                if len(keys) >= HELD_SUMS:
                    yield from _sums(keys, sums)
                    keys, sums = keys[:0], sums[:0]
        yield from _sums(*_reduce([(keys, sums), *more]))
    return run


def _reduce(found):
    keys, sums = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(keys):
        return keys, sums
    order = np.argsort(keys, kind="stable")
    keys, sums = keys[order], sums[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(sums, first)


def _sums(keys, sums):
    """One row per chunk: its documents' places and sums."""
    if len(keys):
        cuts = np.flatnonzero(np.diff(keys >> 16)) + 1
        chunks = (keys >> 16)[np.concatenate([[0], cuts])]
        packed = [np.stack([k & 0xFFFF, n], 1).astype("<i8").tobytes() for k, n in zip(np.split(keys, cuts), np.split(sums, cuts), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(chunks), pa.nulls(len(chunks), pa.binary()), pa.array(packed, pa.binary())], ["chunk", "documents", "sums"])


def _total(batches):
    """Documents with their counts, from rows sorted by chunk."""
    now, docs, total = None, None, None
    for b in batches:
        for chunk, meta, raw in zip(*(b.column(c).to_pylist() for c in ("chunk", "documents", "sums")), strict=True):
            if chunk != now:
                if now is not None:
                    yield _documents(docs, total)
                now, docs, total = chunk, None, np.zeros(CHUNK_DOCS, np.int64)
            if meta is not None:
                docs = np.frombuffer(meta, "<i8").reshape(-1, 4)
            else:
                pairs = np.frombuffer(raw, "<i8").reshape(-1, 2)
                total[pairs[:, 0]] += pairs[:, 1]
    if now is not None:
        yield _documents(docs, total)


def _documents(rows, total):
    return pa.RecordBatch.from_arrays([pa.array(rows[:, 0], mask=rows[:, 1] == 1), pa.array(rows[:, 2]), pa.array(rows[:, 3] + total[:len(rows)])],
                                      ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id",
                 text_col: str = "text", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit), a row per input row.

    Counts equal the library's for whole texts without added tokens; a special string
    inside a text counts as the one token the library makes of it. Null and empty texts have 0 bytes
    and 0 tokens, a null id stays null, repeated rows are counted each, an empty table gives
    no rows. The input has to be a table read (its tasks then see the same rows when they run again).
    """
    prepare(docs.sparkSession)
    rows = id_text(docs, id_col, text_col, binary=True).mapInArrow(_frequencies(tokenizer), FREQUENCIES)
    parts = rows.repartition("pretoken", "salt").sortWithinPartitions("pretoken").mapInArrow(_pieces(tokenizer), PARTIALS)
    counts = parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_total, COUNTS)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
