"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard verification.

Signature. A shingle's 32-bit position on a circle is a first permutation (sigma); a second
one (pi) ranks positions. Coordinate k is the least rank after the circle is turned by k
steps: two permutations give all coordinates.

Candidates. Documents with equal shingle sets are one class. 32 bands of 4 coordinates find
a pair of similarity 0.85 with a chance of missing it of 6e-11 (0.8: 5e-8). Within a bucket:
1. every class is compared with the bucket's first class (a star, linear in the bucket);
2. after joining what those links connect, only pairs of different components remain; they
   are searched in cells of at most two blocks of ``BLOCK`` classes, blocks of one large
   component never against each other, by full signatures: a pair goes on if its coordinates
   agree as often as the threshold asks, less six standard deviations (a pair of similarity 0.85 is
   missed with a chance of 1.4e-8, 0.8: 9e-9). A pair is taken in its first common band only, by whole band keys.

Verification. Links are confirmed on whole shingle sets, recomputed for the classes that
share a bucket. No group is collected whole; no pair list of a group is emitted.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, materialise, prepare
from .components import components

WORDS, BANDS, ROWS = 5, 32, 4
COORDINATES = BANDS * ROWS
BLOCK = 1024
WORDS_KEPT = 250_000
OUT_BYTES = 16 << 20


class _Hashes(dict):
    def __missing__(self, word):
        import xxhash
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORDS_KEPT and len(word) <= 48:
            self[word] = h
        return h


@lru_cache(maxsize=1)
def _hashes():
    return _Hashes()


def _mix(x):
    """A bijection of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(data: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of UTF-8 text. ``lower`` and ``split`` of
    bytes fold A-Z and cut at space and 0x09-0x0D only."""
    w = data.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes().__getitem__, w), np.uint64, len(w))
    n = max(1, len(w) - words + 1)
    out = np.full(n, min(len(w), words), np.uint64)
    for k in range(min(words, len(w))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n])
    return np.unique(out)


TURNS = np.arange(COORDINATES, dtype=np.uint32) * np.uint32(0x9E3779B1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """All coordinates of the circulant MinHash of a non-empty set."""
    at = (shingles >> np.uint64(32)).astype(np.uint32)  # sigma: the set's places on the circle
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(at), 512):
        y = at[lo:lo + 512, None] + TURNS  # the circle turned
        y ^= y >> np.uint32(16)  # pi
        y *= np.uint32(0x85EBCA6B)
        y ^= y >> np.uint32(13)
        y *= np.uint32(0xC2B2AE35)
        y ^= y >> np.uint32(16)
        np.minimum(out, y.min(0), out=out)
    return out


BAND_SALT = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def band_keys(sig: np.ndarray) -> np.ndarray:
    s = sig.reshape(BANDS, ROWS).astype(np.uint64)
    out = BAND_SALT
    for k in range(ROWS):
        out = _mix(out + s[:, k])
    return out.view(np.int64)


SIGNED = "id long, th long, n long, sk binary, bands array<long>, sig binary"


def _sign(words):
    def run(batches):
        import xxhash
        for b in batches:
            n, sk, bands, sigs = [], [], [], []
            for data in b.column("text").to_pylist():
                s = shingle_set(data, words)
                n.append(len(s))
                sk.append(xxhash.xxh3_128_digest(s.tobytes()))
                if len(s):
                    sig = signature(s)
                    bands.append(band_keys(sig))
                    sigs.append(sig.astype("<u2").tobytes())
                else:
                    bands.append(None)
                    sigs.append(None)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("th"), pa.array(n, pa.int64()), pa.array(sk, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                ["id", "th", "n", "sk", "bands", "sig"])
    return run


def _sets(words):
    def run(batches):
        import xxhash
        for b in batches:
            vs, sets, held = [], [], 0
            for v, sk, data in zip(*(b.column(c).to_pylist() for c in ("v", "sk", "text")), strict=True):
                raw = shingle_set(data, words).tobytes()
                if xxhash.xxh3_128_digest(raw) == sk:  # a repeated id can have other texts
                    vs.append(v)
                    sets.append(raw)
                    held += len(raw)
                if held >= OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(vs, pa.int64()), pa.array(sets, pa.binary())], ["v", "set"])
                    vs, sets, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(vs, pa.int64()), pa.array(sets, pa.binary())], ["v", "set"])
    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(percent):
    def run(batches):
        for b in batches:
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                  for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True)]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("u").filter(keep), b.column("v").filter(keep)], ["u", "v"])
    return run


def _cells(batches):
    """The rows of each cell, from batches sorted by cell."""
    held: list = []
    for b in batches:
        if not b.num_rows:
            continue
        cell = b.column("cell").to_numpy()
        cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
        if held and held[-1].column("cell")[0].as_py() != cell[0]:
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(b.slice(lo, hi - lo))
            if hi < len(cell):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


CANDIDATES = "cell long, v long, comp long, partners array<long>"


def _agreeing(percent):
    t = percent / 100
    least = math.floor(COORDINATES * t - 6 * math.sqrt(COORDINATES * t * (1 - t)))

    def run(batches):
        for cell in _cells(batches):
            v, first = np.unique(cell.column("v").to_numpy(), return_index=True)
            comp, n, rep, band = (cell.column(c).to_numpy()[first] for c in ("comp", "n", "r", "band"))
            sig = np.frombuffer(b"".join(cell.column("sig").take(pa.array(first)).to_pylist()), "<u2").reshape(-1, COORDINATES)
            keys = cell.column("bands").take(pa.array(first)).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
            partners: dict = {}
            for q in range(len(v) - 1):
                o = np.flatnonzero((comp[q + 1:] != comp[q]) & (rep[q + 1:] != v[q]) & (rep[q] != v[q + 1:])
                                   & (100 * np.minimum(n[q + 1:], n[q]) >= percent * np.maximum(n[q + 1:], n[q]))) + q + 1
                if not len(o):
                    continue
                good = (sig[o] == sig[q]).sum(1) >= least
                if band[q]:  # whole keys, as buckets are made of them: the signature's coordinates are cut to 16 bits
                    good &= ~(keys[o, :band[q]] == keys[q, :band[q]]).any(1)
                if good.any():
                    partners.setdefault(q, []).extend(v[o[good]].tolist())
                    for x in o[good]:
                        partners.setdefault(int(x), [])
            if partners:
                at = sorted(partners)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), cell.column("cell")[0].as_py())), pa.array(v[at]), pa.array(comp[at]), pa.array([partners[x] for x in at], pa.list_(pa.int64()))],
                    ["cell", "v", "comp", "partners"])
    return run


def _verify_cells(percent):
    """Links of a cell's candidate pairs, one for each two components that meet."""
    def run(batches):
        for cell in _cells(batches):
            sets = {v: np.frombuffer(s, np.uint64) for v, s in zip(cell.column("v").to_pylist(), cell.column("set").to_pylist(), strict=True)}
            comp = dict(zip(cell.column("v").to_pylist(), cell.column("comp").to_pylist(), strict=True))
            met: dict = {}

            def root(x, met=met):
                while met.get(x, x) != x:
                    x = met[x]
                return x

            u, w = [], []
            for x, partners in zip(cell.column("v").to_pylist(), cell.column("partners").to_pylist(), strict=True):
                for y in partners:
                    a, b = root(comp[x]), root(comp[y])
                    if a != b and similar(sets[x], sets[y], percent):
                        met[max(a, b)] = min(a, b)
                        u.append(comp[x])
                        w.append(comp[y])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(w, pa.int64())], ["u", "v"])
    return run


def _residual(shared: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components that share a bucket (u, v: component labels)."""
    members = shared.where("c > 2").join(labels, "v", "left").withColumn("comp", F.coalesce("label", "v")).drop("label", "c")
    per = members.groupBy("bk", "comp").agg(F.count(F.lit(1)).alias("m"))
    many = per.groupBy("bk").agg(F.count(F.lit(1)).alias("comps"), F.sum(F.when(F.col("m") < BLOCK, F.col("m"))).alias("pool")).where("comps > 1")
    large = F.col("m") >= BLOCK
    members = members.join(per, ["bk", "comp"]).join(many, "bk").select(
        "bk", "band", "v", "comp", "r", F.when(large, F.col("comp")).alias("big"),
        F.when(large, F.concat(F.lit("c"), "comp", F.lit("/"), F.pmod(F.xxhash64("v"), F.ceil(F.col("m") / BLOCK))))
        .otherwise(F.concat(F.lit("p"), F.pmod(F.xxhash64("comp"), F.ceil(F.col("pool") / BLOCK)))).alias("block"))
    members = materialise(members, "members")
    blocks = members.select("bk", "block", "big").distinct()
    cells = blocks.alias("x").join(blocks.alias("y"), F.expr("x.bk = y.bk AND x.block <= y.block AND (x.big IS NULL OR y.big IS NULL OR x.big != y.big)")).select(
        F.col("x.bk").alias("bk"), F.col("x.block").alias("one"), F.col("y.block").alias("two"))
    cells = cells.withColumn("cell", F.xxhash64("bk", "one", "two"))
    ends = cells.select("bk", F.col("one").alias("block"), "cell").unionByName(
        cells.where("one != two").select("bk", F.col("two").alias("block"), "cell"))
    rows = members.join(ends, ["bk", "block"]).join(classes.select("v", "n", "sig", "bands"), "v").select("cell", "band", "v", "comp", "r", "n", "sig", "bands")
    found = rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_agreeing(percent), CANDIDATES)
    return found.join(sets, "v").repartition("cell").sortWithinPartitions("cell").mapInArrow(_verify_cells(percent), "u long, v long")


def mark_near_duplicates(docs: DataFrame, percent: int = 80, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component_id and kept, a row per input row.

    Documents are linked when 100 * intersection >= percent * union of their distinct word
    shingles; component_id is the smallest id reachable. Texts with fewer words have their
    whole word sequence as one shingle. Null, empty and blank texts have none and are linked
    with nothing (component_id is their own id). Null ids count only where a component has no
    other. Repeated rows are each their own row of one class: rows that repeat the smallest id are
    all kept. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    texts = id_text(docs, id_col, text_col, binary=True)
    signed = materialise(texts.select("id", F.xxhash64("text").alias("th"), "text").mapInArrow(_sign(words), SIGNED), "signed")
    classes = materialise(signed.where("n > 0").groupBy("sk").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
        .select("sk", F.col("first.id").alias("cid"), F.col("first.th").alias("cth"), "n", "bands", "sig").withColumn("v", F.monotonically_increasing_id()), "classes")
    buckets = classes.select("v", F.posexplode("bands").alias("band", "bk"))
    reps = buckets.groupBy("bk").agg(F.min("v").alias("r"), F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = materialise(buckets.join(reps, "bk"), "buckets")
    wanted = classes.join(shared.select("v").distinct(), "v", "left_semi").select("v", "sk", "cid", "cth")
    # By id and text: null and repeated ids of other texts would meet every such class.
    known = texts.withColumn("th", F.xxhash64("text"))
    sets = materialise(known.join(wanted, known["id"].eqNullSafe(wanted["cid"]) & (known["th"] == wanted["cth"])).select("v", "sk", "text").mapInArrow(_sets(words), "v long, set binary"), "sets")
    stars = shared.where("v != r").select(F.col("r").alias("u"), "v").distinct()
    sizes = classes.select(F.col("v").alias("w"), F.col("n").alias("m"))
    stars = stars.join(sizes, F.col("u") == F.col("w")).select("u", "v", F.col("m").alias("nu")).join(sizes, F.col("v") == F.col("w")) \
        .where(f"100 * least(m, nu) >= {percent} * greatest(m, nu)").select("u", "v")
    pairs = stars.join(sets.select(F.col("v").alias("u"), F.col("set").alias("a")), "u").join(sets.select("v", F.col("set").alias("b")), "v")
    labels = components(pairs.mapInArrow(_verify(percent), "u long, v long"))
    labels = materialise(labels, "labels")
    merged = components(_residual(shared, labels, classes, sets, percent)).select(F.col("v").alias("label"), F.col("label").alias("whole"))
    final = classes.select("v", "sk", "cid").join(labels, "v", "left").withColumn("label", F.coalesce("label", "v")) \
        .join(merged, "label", "left").withColumn("label", F.coalesce("whole", "label"))
    least = final.groupBy("label").agg(F.min("cid").alias("component_id"))
    by_class = final.select("sk", "label").join(least, "label").select("sk", "component_id")
    some = signed.where("n > 0").select("id", "th", "n", "sk").join(by_class, "sk").select("id", "th", "n", "component_id")
    none = signed.where("n = 0").select("id", "th", "n", F.col("id").alias("component_id"))
    return some.unionByName(none).select(F.col("id").alias("doc_id"), "th", F.col("n").alias("n_shingles"), "component_id",
                                         F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group (the kept rows of ``mark_near_duplicates``) with all its columns.
    Where that row repeats with the same id and text, one of the repeats stays."""
    marks = materialise(mark_near_duplicates(docs, percent, words, id_col, text_col).groupBy("doc_id", "th").agg(
        F.max("kept").alias("kept"), F.count(F.lit(1)).alias("times")).where("NOT kept OR times > 1"), "marks")
    th = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("bigint").alias("id"), th.alias("h"), F.monotonically_increasing_id().alias("place"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("th"))
    again = rows.join(marks.where("kept"), same).groupBy("doc_id", "th").agg(F.min_by("row", "place").alias("row")).select("row")
    return rows.join(marks, same, "left_anti").select("row").unionByName(again).select("row.*")
