"""Secret scanning (DataFrame functions only).

Fixed patterns give the base spans. Beside them, candidate strings (runs of token characters)
are searched by sliding-window Shannon entropy, each by its character class: hexadecimal, or
mixed letters and digits. A window's entropy is log2(w) - sum(c * log2(c)) / w over the counts c of its
characters; moving it by one character changes two counts, so the sum is kept by incremental
counts. Where windows reach the class's limit, the stretch they cover is a span of kind ``entropy``,
unless a base span overlaps it. The allow-list: windows that overlap a string that says it is an
example are left out (the pieces between such strings are searched), and so are pieces that are a UUID, digits
and marks, or words joined by marks. Words have no digit and few changes of case; a key of letters of one
case looks like them and is not found.

Offsets are code points, ends exclusive. A pattern's offsets come from the lengths of the
pieces between its matches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FIXED VALUES: the base patterns; the second number is the least length of the group.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16

CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
WINDOW = 20
#: Least entropy (bits a character) of a window, by character class.
LIMITS = {"hex": 3.0, "mixed": 3.7}
#: Strings that say they are examples, and pieces that are no secrets: UUIDs, digits and marks.
EXAMPLES = r"(?i)example|sample|placeholder|dummy|x{4,}|0123456789|abcdefgh"
ALLOW = (r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", r"^[0-9+/=_-]+$")
#: A word's letter before a change of case, as in getHTTPCode.
CHANGE = r"[a-z](?=[A-Z])|[A-Z](?=[A-Z][a-z])"
#: Words have at least so many letters for each change of case (one change is always allowed).
LETTERS = 5
KINDS = ("assign", "access", "hex", "entropy")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once: inside a lambda Spark computes an outer expression anew for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, text). The text between two
    matches and the matches themselves, taken in turn, give the offsets.

    Offsets are sums over the pieces before a match, taken first over blocks of about the
    square root of the matches, so a long text with many of them stays cheap."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, e: a + e)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(s):
        ends = F.zip_with(F.slice(s["gaps"], 1, F.size(s["found"])), s["found"], lambda g, m: F.length(g) + F.length(m))
        return bound(F.struct(s["found"].alias("found"), ends.alias("ends"), F.ceil(F.sqrt(F.size(s["found"]))).cast("int").alias("b")), based)

    def based(s):
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(s["ends"]) - 1) / s["b"]).cast("int")), lambda j: total(F.slice(s["ends"], j * s["b"] + 1, s["b"])))
        return bound(sums, lambda x: bound(F.struct(s["found"].alias("found"), s["ends"].alias("ends"), s["b"].alias("b"), F.transform(
            x, lambda _, j: total(F.slice(x, 1, j))).alias("bases")), started))

    def started(s):
        def start(m, i):
            block = F.floor(i / s["b"]).cast("int")
            inside = total(F.slice(s["ends"], block * s["b"] + 1, i - block * s["b"] + 1))
            return F.struct((F.element_at(s["bases"], block + 1) + inside - F.length(m)).alias("start"), m.alias("text"))
        return F.transform(s["found"], start)

    none = F.array().cast("array<struct<start:int,text:string>>")
    return bound(found, lambda f: F.when(F.size(f) == 0, none).otherwise(
        bound(F.struct(f.alias("found"), F.split(text, pattern, -1).alias("gaps")), placed)))


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (x["start"] + F.length(x["text"])).alias("end")))


NO_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _where(text: Column, test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(F.array().cast(NO_SPANS))


def base_spans(text: Column) -> list[Column]:
    """Span arrays of the fixed patterns: assign, access, hex. Matches below a least length are dropped.
    For the last two a run that is long enough is found directly: it is the same run."""
    assign = F.filter(matches(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["text"], ASSIGN, 2)) >= ASSIGN_LEAST)
    access = matches(text, f"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}")
    hexes = matches(text, f"[0-9a-f]{{{HEX_LEAST},}}")
    return [_where(text, text.rlike(ASSIGN), _spans(assign, "assign")),
            _where(text, text.contains("AKIA"), _spans(access, "access")),
            _where(text, text.rlike(f"[0-9a-f]{{{HEX_LEAST}}}"), _spans(hexes, "hex"))]


def _term(count: Column) -> Column:
    """count * log2(count), 0 for 0, for counts up to WINDOW."""
    return F.element_at(F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)]), count + 1)


def dense_stretch(text: Column) -> Column:
    """struct(first, last): the first window start and the last window end (in the string, from 0)
    at which entropy reaches the class's limit; null where no window does."""
    limit = F.when(text.rlike("^[0-9a-fA-F]+$"), LIMITS["hex"]).otherwise(LIMITS["mixed"])
    most = (math.log2(WINDOW) - limit) * WINDOW  # the sum of terms must not exceed this
    codes = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0.0).alias("sum"),
                    F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def step(at, s, i):
        new, old = F.element_at(at, i), F.when(i > WINDOW, F.element_at(at, i - WINDOW)).otherwise(F.lit(-1))
        # counts after the old character left; then the new one enters
        c_old, c_new = F.element_at(s["counts"], F.greatest(old, F.lit(1))), F.element_at(s["counts"], new)
        c_mid = c_new - (old == new).cast("int")
        total = s["sum"] + F.when(old > 0, _term(c_old - 1) - _term(c_old)).otherwise(0.0) + _term(c_mid + 1) - _term(c_mid)
        counts = F.transform(s["counts"], lambda c, j: c + (j + 1 == new).cast("int") - (j + 1 == old).cast("int"))
        hit = (i >= WINDOW) & (total <= most + 1e-9)
        return F.struct(counts.alias("counts"), total.alias("sum"), F.when(hit, F.coalesce(s["first"], i - WINDOW)).otherwise(s["first"]).alias("first"),
                        F.when(hit, i).otherwise(s["last"]).alias("last"))

    return bound(codes, lambda at: F.aggregate(F.sequence(F.lit(1), F.length(text)), zero, lambda s, i: step(at, s, i), lambda s: F.when(
        s["first"].isNotNull(), F.struct(s["first"].alias("first"), s["last"].alias("last")))))


def _pieces(run: Column) -> Column:
    """The parts of a candidate (start, text) between the strings that say they are examples."""
    def cut(marks):
        after = lambda i: F.element_at(marks, i)["start"] + F.length(F.element_at(marks, i)["text"])
        return F.transform(F.split(run["text"], EXAMPLES, -1), lambda gap, i: F.struct(
            (run["start"] + F.when(i == 0, 0).otherwise(after(i))).alias("start"), gap.alias("text")))
    return F.when(run["text"].rlike(EXAMPLES), bound(matches(run["text"], EXAMPLES), cut)).otherwise(F.array(run))


def are_words(text: Column) -> Column:
    """Whether a string is words joined by marks: no digit, and few changes of case in every word and in all."""
    changes = lambda x: F.regexp_count(x, F.lit(CHANGE))
    few = lambda x: changes(x) * LETTERS <= F.length(x)
    each = F.forall(F.split(text, "[+/=_-]+", -1), lambda x: (changes(x) <= 1) | few(x))
    return ~text.rlike("[0-9]") & few(F.regexp_replace(text, "[+/=_-]+", " ")) & each


def entropy_spans(text: Column) -> Column:
    """Span arrays of kind entropy, before base spans suppress any."""
    def allowed(x):
        out = are_words(x)
        for p in ALLOW:
            out = out | x.rlike(p)
        return out

    pieces = F.flatten(F.transform(matches(text, CANDIDATE), _pieces))
    found = F.filter(pieces, lambda x: (F.length(x["text"]) >= WINDOW) & ~allowed(x["text"]))
    dense = F.filter(F.transform(found, lambda x: F.struct(x["start"].alias("start"), dense_stretch(x["text"]).alias("d"))), lambda x: x["d"].isNotNull())
    spans = F.transform(dense, lambda x: F.struct((x["start"] + x["d"]["first"]).alias("start"), F.lit(KINDS.index("entropy")).alias("kind"), (x["start"] + x["d"]["last"]).alias("end")))
    return _where(text, text.rlike(CANDIDATE), spans)


def _joined(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _apart(spans: Column, base: Column) -> Column:
    """The spans that overlap none of the base spans (sorted by start, not empty). Base spans are held in blocks
    of about the square root of their number; only blocks that reach a span are looked into."""
    width = F.ceil(F.sqrt(F.size(base))).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(base) - 1) / width).cast("int")), lambda j: F.slice(base, j * width + 1, width))
    blocks = F.transform(parts, lambda p: F.struct(p.alias("part"), F.element_at(p, 1)["start"].alias("start"), F.array_max(F.transform(p, lambda x: x["end"])).alias("end")))
    meets = lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"])
    return bound(blocks, lambda every: F.filter(spans, lambda s: ~F.exists(every, lambda k: meets(k, s) & F.exists(k["part"], lambda x: meets(x, s)))))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans, a row per input row.

    spans: every span as kind:start:end, by start, then kind in the order of ``KINDS``, comma-joined;
    base_sha256: SHA-256 of that string for the base kinds alone. Null and empty texts have no
    spans (the SHA-256 of the empty string); null ids stay null, repeated rows are scanned each, an
    empty table gives no rows. A very long text is scanned whole.
    """
    assign, access, hexes = base_spans(F.col("t"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).select(
        "doc_id", assign.alias("a"), access.alias("k"), hexes.alias("h"), entropy_spans(F.col("t")).alias("e"))
    base = F.array_sort(F.concat("a", "k", "h"))
    rows = rows.withColumn("base", base)
    rows = rows.withColumn("more", F.when((F.size("base") == 0) | (F.size("e") == 0), F.col("e")).otherwise(_apart(F.col("e"), F.col("base"))))
    more = F.col("more")
    return rows.select("doc_id", F.size("a").cast("bigint").alias("n_assign"), F.size("k").cast("bigint").alias("n_access"), F.size("h").cast("bigint").alias("n_hex"),
                       F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", more))).alias("spans"))
