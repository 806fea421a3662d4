"""Benchmark decontamination by template canonicalisation.

A text's words become template tokens: numbers, names (title-case words inside a sentence)
and units (after a number) become typed placeholders, whose words are the slots; other words
are lower-cased and stripped of punctuation. Windows of ``WINDOW`` template tokens are hash-joined with
those of the benchmark (an item with fewer tokens is one window). An item's window with too few
literals is looked for by its words as they are, and lengthened until it holds enough literals to be
looked for as a template. An item's first word is never a placeholder for a name or unit, as nothing is before it; a
document's windows that begin with one are also looked for with that word as it is, by the first windows. Windows that
match at the same distance belong together. A window whose words equal the item's is a verbatim copy and counts
whatever other windows hold. In the other windows the item's slot words must map to the document's one way (each
item word always to the same document word), else these are dropped; they show a re-parameterised question.

Tasks get a filter of fixed size over the benchmark's window hashes, so few other windows leave a
task; the join decides.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, materialise, prepare
from .vocabulary import hash_filter, passes

WINDOW = 8
#: Words of a template window that must not be placeholders.
LITERALS = 5
#: An item with fewer template tokens is too general to look for.
LEAST_TOKENS = 4
WORDS_KEPT = 150_000

# Units of measure that a number is followed by.
UNITS = frozenset("""mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs oz ton tons tonnes
ml l liter liters litre litres s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks
month months year years hz khz mhz ghz b kb mb gb tb v w kw mw j kj cal kcal pa kpa percent degrees dollars cents euros
pounds meters metres grams kilograms kilometers kilometres mph kmh""".split())
NUMBER = re.compile(r"[+-]?[0-9][0-9.,:/]*%?")
NAME, NUM, UNIT = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


TITLE, IS_NUM, IS_UNIT, END, REAL = (np.uint64(1 << k) for k in range(5))
LITERAL = np.uint64((1 << 64) - (1 << 5))
AS_IS, BASE = np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x9E6C63D0876A9A47)


class _Tokens(dict):
    """A raw word to one number: a hash of its literal, and in the low bits whether it is title-case,
    a number, a unit, ends a sentence, has letters or digits."""

    def __missing__(self, raw):
        import xxhash
        word = raw.decode()
        core = word.strip("\"'`()[]{}<>.,;:!?…“”‘’«»¿¡*_#-–—/\\|~=+&@^$")
        low = core.lower()
        flags = (core[:1].isupper() and core[1:].islower(), NUMBER.fullmatch(core), low in UNITS,
                 word.rstrip("\"')]}”’»").endswith((".", "!", "?", "…")), core)
        found = xxhash.xxh3_64_intdigest(low.encode()) & int(LITERAL) | sum(bool(f) << k for k, f in enumerate(flags))
        if len(self) < WORDS_KEPT and len(raw) <= 48:
            self[raw] = found
        return found


@lru_cache(maxsize=1)
def _tokens():
    return _Tokens()


def template(data: bytes):
    """(raw words, template hashes, slot flags, hashes of the words as they are) of UTF-8 text."""
    words = data.split()
    code = np.fromiter(map(_tokens().__getitem__, words), np.uint64, len(words))
    num, end, real = code & IS_NUM != 0, code & END != 0, code & REAL != 0
    name, unit = code & TITLE != 0, code & IS_UNIT != 0
    if len(words):
        name[0] = unit[0] = False
    name[1:] &= ~end[:-1]
    unit[1:] &= num[:-1]
    plain = code & LITERAL
    out = plain.copy()
    out[name], out[unit], out[num] = NAME, UNIT, NUM
    slot = num | unit | name
    if not real.all():  # words of punctuation alone
        words = [w for w, r in zip(words, real.tolist(), strict=True) if r]
        out, slot, plain = out[real], slot[real], plain[real]
    return words, out, slot, plain


def window_hashes(tokens: np.ndarray, size: int) -> np.ndarray:
    if WINDOW < size <= len(tokens):
        return _long_hashes(tokens, size)
    h = np.full(max(0, len(tokens) - size + 1), size, np.uint64)
    for k in range(size if len(h) else 0):
        h = (h ^ tokens[k:k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _spread(tokens):
    t = (tokens ^ (tokens >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return t ^ (t >> np.uint64(29))


def _long_hashes(tokens, size, first=None):
    """Hashes of long windows from running sums: the work does not grow with the size."""
    t = _spread(tokens)
    power = np.full(len(t), BASE, np.uint64)
    power[0] = 1
    sums = np.zeros(len(t) + 1, np.uint64)
    np.cumsum(t * np.cumprod(power), out=sums[1:])
    back = np.full(len(t) - size + 1, pow(int(BASE), -1, 1 << 64), np.uint64)
    back[0] = 1
    h = (sums[size:] - sums[:-size]) * np.cumprod(back)
    if first is not None:
        h += _spread(first[:len(h)]) - t[:len(h)]
    h = (h ^ np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def lead_hashes(tokens: np.ndarray, plain: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
    """Hashes of the windows at some places, their first word as it is."""
    if size > WINDOW:
        return _long_hashes(tokens, size, plain)[at]
    h = np.full(len(at), size, np.uint64)
    for k in range(size):
        h = (h ^ (tokens[at + k] if k else plain[at])) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _hashes_of(form, tokens, plain):
    """Window hashes of a form: (size, whether words are taken as they are)."""
    size, as_is = form
    return window_hashes(plain, size) ^ AS_IS if as_is else window_hashes(tokens, size)


def _slots(words, slot, at, size):
    core = "\"'`()[]{}<>.,;:!?"
    return [words[i].decode().strip(core) for i in range(at, at + size) if slot[i]]


def item_windows(slot: np.ndarray, window: int, literals: int, least: int):
    """(place, size, whether words are taken as they are) of the windows by which an item is looked for."""
    n = len(slot)
    size = min(window, n)
    if size < least:
        return
    need = min(literals, size - 1)
    before = np.concatenate([[0], np.cumsum(~slot)])  # literals before a place
    for at in range(n - size + 1):
        if before[at + size] - before[at] >= need:
            yield at, size, False
        else:
            yield at, size, True
            end = int(np.searchsorted(before, before[at] + need))
            if end <= n:
                yield at, end - at, False


BENCH = "h long, item_id long, ipos int, size int, as_is boolean, islots array<string>"


def _bench(window, literals, least):
    def run(batches):
        for b in batches:
            rows = []
            for item, data in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words, tokens, slot, plain = template(data)
                hashes: dict = {}
                for at, *form in item_windows(slot, window, literals, least):
                    size, as_is = form = tuple(form)
                    if form not in hashes:
                        hashes[form] = _hashes_of(form, tokens, plain).view(np.int64)
                    rows.append((int(hashes[form][at]), item, at, size, as_is, [] if as_is else _slots(words, slot, at, size)))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["h", "item_id", "ipos", "size", "as_is", "islots"])
    return run


def _limits(window, literals, least):
    def run(batches):
        for b in batches:
            rows = []
            for item, data in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                slot = template(data)[2]
                forms = [as_is for _, _, as_is in item_windows(slot, window, literals, least)]
                if all(forms):
                    rows.append((item, len(slot), "verbatim only" if forms else "never"))
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int32(), pa.string()], strict=True)], ["item_id", "tokens", "found"])
    return run


def limited_items(benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, literals: int = LITERALS,
                  least: int = LEAST_TOKENS) -> DataFrame:
    """item_id, tokens and found: the items that are never looked for (too few tokens), and those found verbatim only (too few literals)."""
    prepare(benchmark.sparkSession)
    return id_text(benchmark, item_id, item_text, binary=True).mapInArrow(_limits(window, literals, least), "item_id long, tokens int, found string")


HITS = "rid long, id long, th long, h long, dpos int, lead boolean, dslots array<string>"


def _windows(forms, sent):
    """forms: sizes, whether words are taken as they are, and whether templates at an item's start have the size;
    sent: a broadcast filter of the hashes to look for."""
    def run(batches):
        rid = TaskContext.get().partitionId() << 33

        def sought(hashes):
            return np.flatnonzero(passes(sent.value, hashes)).tolist()

        for b in batches:
            rows = []
            for doc, th, data in zip(*(b.column(c).to_pylist() for c in ("id", "th", "text")), strict=True):
                words, tokens, slot, plain = template(data)
                leads = np.flatnonzero((tokens == NAME) | (tokens == UNIT))
                rid += 1
                for size, as_is, starts in forms:
                    hashes = _hashes_of((size, as_is), tokens, plain)
                    for i in sought(hashes):
                        rows.append((rid, doc, th, int(hashes[i].view(np.int64)), i, False, [] if as_is else _slots(words, slot, i, size)))
                    at = leads[leads <= len(tokens) - size] if starts else leads[:0]
                    if len(at):
                        hashes = lead_hashes(tokens, plain, size, at)
                        for k in sought(hashes):
                            i = int(at[k])
                            rows.append((rid, doc, th, int(hashes[k].view(np.int64)), i, True, _slots(words, slot, i + 1, size - 1)))
                    if len(rows) >= 20_000:
                        yield _hits(rows)
                        rows = []
            if rows:
                yield _hits(rows)
    return run


def _hits(rows):
    kinds = [pa.int64()] * 4 + [pa.int32(), pa.bool_(), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      ["rid", "id", "th", "h", "dpos", "lead", "dslots"])


def find_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                      item_text: str = "text", window: int = WINDOW, literals: int = LITERALS, least: int = LEAST_TOKENS) -> DataFrame:
    """doc_id, th (hash of the text), item_id, windows (matched) and kind, a row per document row and item found in it.

    Null and empty texts match nothing; items with under ``least`` template tokens are not looked for (see ``limited_items``); null
    ids stay null; repeated rows are found each; an empty benchmark or table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    bench = materialise(id_text(benchmark, item_id, item_text, binary=True).mapInArrow(_bench(window, literals, least), BENCH), "items")
    forms = [tuple(r) for r in bench.groupBy("size", "as_is").agg(F.max(F.expr("ipos = 0 AND NOT as_is"))).collect()]  # at most twice the longest item's tokens
    sent = hash_filter(bench.select("h"))
    texts = id_text(docs, id_col, text_col, binary=True).select("id", F.xxhash64("text").alias("th"), "text")
    hits = texts.mapInArrow(_windows(forms, sent), HITS)
    found = materialise(hits.join(bench, "h").where("NOT lead OR ipos = 0").withColumn("apart", F.col("dpos") - F.col("ipos")), "matches")
    one = ["rid", "id", "th", "item_id", "apart"]
    found = found.withColumn("same", F.col("as_is") | (F.col("islots") == F.col("dslots")))
    pairs = found.where("NOT same").select(*one, F.explode(F.arrays_zip(F.col("islots").alias("i"), F.col("dslots").alias("d"))).alias("p"))
    words = pairs.groupBy(*one, F.col("p.i").alias("word")).agg(F.min("p.d").alias("low"), F.max("p.d").alias("high"))
    torn = words.where("low != high").select("rid", "item_id", "apart").distinct()
    others = found.where("NOT same").join(torn, ["rid", "item_id", "apart"], "left_anti")
    kept = found.where("same").unionByName(others, allowMissingColumns=True).groupBy("rid", "id", "th", "item_id")
    return kept.agg(F.count_distinct("apart", "ipos").alias("windows"), F.bool_and("same").alias("same")).select(
        F.col("id").alias("doc_id"), "th", "item_id", "windows", F.when(F.col("same"), "verbatim").otherwise("re-parameterised").alias("kind"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents in which no benchmark item is found, with all their columns."""
    found = find_contaminated(docs, benchmark, id_col, text_col, **options).select(F.col("doc_id").alias("id"), "th").distinct()
    th = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("bigint").alias("id"), th.alias("th"))
    hit = rows["id"].eqNullSafe(found["id"]) & (rows["th"] == found["th"])
    return rows.join(found, hit, "left_anti").select("row.*")
