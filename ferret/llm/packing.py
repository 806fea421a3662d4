"""Packing by concatenate and cut.

Pass 1 tokenises every document once, in the task that reads it, and writes its ids with
their start inside the task's own id stream. One row per task then gives the task's total,
and a prefix sum over those totals gives each task's place in the one global stream. Pass 2
cuts the stream at fixed windows: a document that crosses a window's edge gets a boundary
record (a piece) on either side. No document is shuffled and no id is recomputed. Only
the totals (16 bytes per task of pass 1) are broadcast; the driver keeps more than that for
every task anyway, which bounds them.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import SPACELESS, bpe
from .common import id_text, materialise, prepare

SEQUENCE = 2048
END_ID = 1
#: Pre-tokens kept per worker; beyond that, new ones are encoded each time (same ids).
PRETOKENS_KEPT = 750_000
OUT_BYTES = 16 << 20


class _Ids(dict):
    """Pre-tokens to the bytes of their ids. Words that differ in case or punctuation share them."""

    def __init__(self, path):
        super().__init__()
        self.bpe = bpe(path)
        self.kind = np.dtype("<u2") if self.bpe.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")

    def __missing__(self, pretoken):
        ids = np.array([t.id for t in self.bpe.pieces(pretoken)], self.kind).tobytes()
        if len(self) < PRETOKENS_KEPT and len(pretoken) <= 48:
            self[pretoken] = ids
        return ids

    def text(self, text: str) -> bytes:
        if not self.bpe.spaceless:
            return self._whole(text)
        if self.bpe.known_split and self.bpe.plain(text):
            return b"".join(map(self.__getitem__, SPACELESS.findall(text.lower())))
        return b"".join(self._word(w) for w in text.split(" "))

    def _word(self, word):
        if self.bpe.known_split and self.bpe.plain(word):
            return b"".join(map(self.__getitem__, SPACELESS.findall(word.lower())))
        return self._whole(word)

    def _whole(self, text):
        return np.array(self.bpe.tok.encode(text, add_special_tokens=False).ids, self.kind).tobytes()


@lru_cache(maxsize=4)
def _ids(path):
    return _Ids(path)


def _encode(path, end_id):
    def run(batches):
        ids_of = _ids(path)
        kind, end = ids_of.kind, np.array([end_id], ids_of.kind).tobytes()
        at, part = 0, TaskContext.get().partitionId()
        for b in batches:
            out = [ids_of.text(data.decode()) + end for data in b.column("text").to_pylist()]
            n = np.fromiter(map(len, out), np.int64, len(out)) // kind.itemsize
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(np.full(len(n), part)), pa.array(ends - n), pa.array(n),
                 pa.array(np.full(len(n), kind.itemsize, np.int32)), pa.array(out, pa.binary())],
                ["id", "part", "local", "n", "width", "ids"])
            at = int(ends[-1]) if len(n) else at
    return run


ENCODED = "id long, part long, local long, n long, width int, ids binary"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _cut(size):
    def run(batches):
        for b in batches:
            rows, held = [], 0
            for doc, base, local, n, width, raw in zip(*(b.column(c).to_pylist() for c in ("id", "base", "local", "n", "width", "ids")), strict=True):
                ids, at = np.frombuffer(raw, f"<u{width}"), base + local
                for seq in range(at // size, (at + n - 1) // size + 1):
                    lo, hi = max(0, seq * size - at), min(n, (seq + 1) * size - at)
                    rows.append((doc, lo, hi - lo, ids[lo:hi].astype("<u4").tobytes(), n, seq, at + lo - seq * size))
                    held += 4 * (hi - lo) + 64
                    if held >= OUT_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
            if rows:
                yield _batch(rows)
    return run


def _batch(rows):
    kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)],
                                      ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", id_col: str = "doc_id",
                   text_col: str = "text", size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents in sequences of ``size`` ids; only the last one needs padding.

    doc_id, start (ids of the document before the piece), length, ids (little-endian
    unsigned 32-bit), doc_tokens (with the end id), sequence_id and offset (both from 0).
    A null or empty text is one piece that holds the end id; a null id stays null. Repeated
    rows are packed each on their own. A very long text spans as many sequences as it
    needs. An empty table gives no pieces. Documents lie in the order of their input
    partitions, which the written ids of pass 1 fix, so a repeated task cuts the same.
    """
    prepare(docs.sparkSession)
    encoded = materialise(id_text(docs, id_col, text_col, binary=True)
                          .mapInArrow(_encode(tokenizer, end_id), ENCODED), "pack")
    totals = encoded.groupBy("part").agg(F.max(F.col("local") + F.col("n")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return encoded.join(F.broadcast(bases), "part").mapInArrow(_cut(size), PIECES)


def pieces_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")
