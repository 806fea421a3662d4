"""Text expressions. All return Spark Columns and stay inside whole-stage codegen."""

from __future__ import annotations

from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python's str.split()/str.isspace() treat as whitespace. Java's and
# RE2's \s are ASCII-only (and RE2's even lacks \x0B), so the class is spelled out
# and shared with the DuckDB oracle.
WS_CLASS = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
WS_RUN = WS_CLASS + "+"

# Word tokens of the "standard tokenizer + lowercase" analyzer, approximated as
# runs of letters, digits and underscore.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+"

# HTML character references: decimal, hexadecimal, and names from the standard library's table.
REFERENCE_PATTERN = r"&(?:#[0-9]{1,6}|#[xX][0-9a-fA-F]{1,5}|[A-Za-z][A-Za-z0-9]{1,9});"
REFERENCE_NAMES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}

NETLOC_PATTERN = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze_ws(c) -> Column:
    """' '.join(x.split()): whitespace runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(col_(c), WS_RUN, " "))


def clean_text(c) -> Column:
    """Whitespace squeeze first, then tag strip; NULL or empty becomes ''."""
    squeezed = F.trim(F.regexp_replace(col_(c), WS_RUN, " "))
    return F.coalesce(F.regexp_replace(squeezed, r"<[^>]+>", ""), F.lit(""))


def _referenced(ref: Column) -> Column:
    """The character of one reference; an unknown name stays as written."""
    code = F.when(F.lower(F.substring(ref, 3, 1)) == "x", F.conv(F.substring(ref, F.lit(4), F.length(ref) - 4), 16, 10)) \
        .otherwise(F.substring(ref, F.lit(3), F.length(ref) - 3)).cast("int")
    names = F.str_to_map(F.lit("\n".join(f"{k}={v}" for k, v in REFERENCE_NAMES.items())), F.lit("\n"), F.lit("="))
    named = F.element_at(names, F.substring(ref, F.lit(2), F.length(ref) - 2))
    return F.when(F.substring(ref, 2, 1) == "#", F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")) \
        .otherwise(F.coalesce(named, ref))


def html_unescape(c) -> Column:
    """HTML character references decoded, each once ("&amp;lt;" becomes "&lt;")."""
    text = col_(c)

    def decode(t):
        found = F.struct(F.regexp_extract_all(t, F.lit(REFERENCE_PATTERN), 0).alias("refs"),
                         F.split(t, REFERENCE_PATTERN, -1).alias("pieces"))
        return bind_once(found, lambda f: F.concat(F.element_at(f["pieces"], 1), F.array_join(F.zip_with(
            f["refs"], F.slice(f["pieces"], 2, F.size(f["refs"])), lambda r, p: F.concat(_referenced(r), p)), "")))

    return bind_once(text, lambda t: F.when(t.contains("&"), decode(t)).otherwise(t))


def count_occurrences(text, term) -> Column:
    """Non-overlapping occurrences of a non-empty ``term`` in ``text``."""
    t, s = col_(text), col_(term) if not isinstance(term, str) else F.lit(term)
    return F.when(F.length(s) > 0,
                  ((F.length(t) - F.length(F.replace(t, s, F.lit("")))) / F.length(s))
                  .cast("long"))


# Lists longer than this are matched with a JVM higher-order function over a literal
# array instead of an unrolled expression, which keeps generated code under 64 KB.
UNROLL_LIMIT = 12


def word_array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def bind_once(t: Column, fn) -> Column:
    """Evaluate ``t`` once per row and apply ``fn`` to the value (a 'let' binding).

    A lambda over a word list re-evaluates any expression it references for every list
    entry, and Catalyst may inline a column expression referenced once into such a
    lambda. Passing the text through a one-element array binds it to a lambda variable,
    so it is computed a single time."""
    return F.element_at(F.transform(F.array(t), fn), 1)


def contains_any(text, words) -> Column:
    """True when ``text`` contains any of ``words`` (plain substrings)."""
    t = col_(text)
    if not words:
        return F.lit(False)
    if len(words) > UNROLL_LIMIT:
        arr = word_array(words)
        return bind_once(t, lambda x: F.exists(arr, lambda w: x.contains(w)))
    return reduce(lambda a, b: a | b, [t.contains(F.lit(w)) for w in words])


def ordered_matches(text, words) -> Column:
    """The ``words`` found in ``text``, in list order."""
    t = col_(text)
    if not words:
        return F.array().cast("array<string>")
    if len(words) > UNROLL_LIMIT:
        arr = word_array(words)
        return bind_once(t, lambda x: F.filter(arr, lambda w: x.contains(w)))
    return F.array_compact(F.array(*[F.when(t.contains(F.lit(w)), F.lit(w)) for w in words]))


def netloc(url) -> Column:
    """urlparse(url).netloc: keeps port and user info, unlike parse_url HOST."""
    return F.regexp_extract(col_(url), NETLOC_PATTERN, 1)


def url_hash(url) -> Column:
    return F.md5(col_(url))


def analyze(c) -> Column:
    """Lower-cased word tokens of a text."""
    return F.regexp_extract_all(F.lower(col_(c)), F.lit(TOKEN_PATTERN), 0)


def has_token(c) -> Column:
    """Whether a text has a token; it is read up to its first one only."""
    return F.regexp_like(F.lower(col_(c)), F.lit(TOKEN_PATTERN))


def nullif_empty(c) -> Column:
    c = col_(c)
    return F.when(c != "", c)
