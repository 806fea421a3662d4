"""Quality rules, lines first (DataFrame functions only).

Every line is judged by itself: *punctuation* (symbols or exclamation marks instead of text, or no
mark that ends or divides a sentence), *navigation* (words strung together by menu separators) and *boilerplate* (a
short line with a phrase of page furniture, or a line that the text already held). Failing lines are
removed, and a text that loses more than ``most_lost`` percent of its characters is rejected.

Beside that stand counts over the whole text, and a base verdict from them: too few words, or too
many of them in runs of eight words that come again. Runs are compared by 64-bit hashes inside their own
text; positions are sorted, so the work is n log n in a text's words whatever repeats. Each row is decided by itself: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .secret_scan import bound

WORD = r"[^\x20\x09-\x0D]+"
RUN = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Characters lost by removed lines (percent) beyond which a text is rejected.
MOST_LOST = 50

# FIXED VALUES: marks and phrases of the line rules.
SYMBOLS = "#*$%&|<>"
SEPARATORS = ("|", "»", "«", ">", "<", "•", "·", "::", "/", "→")
ENDS = r"[.!?…:;,。！？]"
PHRASES = (
    "cookie policy", "use cookies", "accept cookies", "privacy policy", "terms of use", "terms of service", "terms and conditions", "all rights reserved",
    "sign in", "sign up", "log in", "subscribe to", "newsletter", "click here", "read more", "share this", "skip to content", "enable javascript",
    "powered by", "back to top", "lorem ipsum", "alle rechte vorbehalten", "datenschutzerkl", "impressum", "tous droits r", "mentions l",
    "politique de confidentialit", "todos los derechos reservados", "aviso legal",
)
#: A line with a phrase of page furniture fails if it has at most so many words.
PHRASE_WORDS = 25
#: Menu separators: so many at least, and one for so many words.
MENU_LEAST, MENU_SHARE = 3, 8
#: Symbols fail a line at one for so many characters, exclamation marks at one for so many words (from five on).
SYMBOL_SHARE, SHOUT_SHARE = 10, 2
#: A line of so many words needs a mark that ends or divides sentences.
MARK_WORDS = 8
RULES = ("punctuation", "navigation", "boilerplate")


def repeated_words(words: Column) -> Column:
    """Words inside windows of eight words that the array holds twice or more."""
    # A slice per window would copy the whole array each time: hashes of 2, 4 and 8 words are built from those of half the length.
    def joined(h, width):
        return bound(h, lambda a: F.zip_with(a, F.slice(a, width + 1, F.size(a)), lambda x, y: F.xxhash64(x, y)))

    def windows(h):
        return bound(joined(joined(joined(h, 1), 2), 4), lambda a: F.slice(a, 1, F.size(a) - (RUN - 1)))

    def covered(at):  # sorted starts: each covers up to the next one
        steps = F.transform(at, lambda p, i: F.least(F.lit(RUN), F.coalesce(F.get(at, i + 1) - p, F.lit(RUN))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def again(s):  # windows in the order of their hashes: equal ones are neighbours
        same = lambda x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
        return F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"])

    def found(w):
        placed = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(bound(bound(placed, lambda s: F.sort_array(again(s))), covered))

    return F.when(F.size(words) <= RUN, F.lit(0)).otherwise(
        bound(bound(F.transform(words, lambda w: F.xxhash64(w)), windows), found)).cast("bigint")


def _line(text: Column, at: Column) -> Column:
    """A line with its place, words, and the code points of its words."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return bound(words, lambda w: F.struct(text.alias("line"), at.alias("at"), w.alias("words"), F.size(w).alias("n"),
                                           F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)).alias("chars"), _symbols(text).alias("symbols")))


def _symbols(text: Column) -> Column:
    return F.when(text.rlike(f"[{SYMBOLS}]"), F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]", ""))).otherwise(F.lit(0))


def line_rule(x: Column, seen_before: Column) -> Column:
    """The first rule a line with words fails, else null."""
    line, n = x["line"], x["n"]
    shouts = F.length(line) - F.length(F.replace(line, F.lit("!"), F.lit("")))
    punctuation = (x["symbols"] * SYMBOL_SHARE >= x["chars"]) | ((n >= 5) & (shouts * SHOUT_SHARE >= n)) | ((n >= MARK_WORDS) & ~line.rlike(ENDS))
    parts = F.size(F.filter(x["words"], lambda w: w.isin(*SEPARATORS)))
    navigation = line.rlike(f"[{''.join(SEPARATORS)}]") & (parts >= MENU_LEAST) & (parts * MENU_SHARE >= n)
    boilerplate = ((n <= PHRASE_WORDS) & F.lower(line).rlike("|".join(PHRASES))) | seen_before
    return F.when(navigation, "navigation").when(punctuation, "punctuation").when(boilerplate, "boilerplate")


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_lost: int = MOST_LOST, least_words: int = LEAST_WORDS,
                most_repeated: int = MOST_REPEATED) -> DataFrame:
    """doc_id, text, clean_text, removed (array of struct(at, rule), places from 0), the counts n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, and lost (percent), base_failed, kept: a row per input row.

    clean_text holds the lines that fail no rule; blank lines stay. Null and empty texts have no words, fail the base
    verdict and lose nothing. Null ids stay null, repeated rows are judged each, an empty table gives no rows, and very
    long texts are judged whole. Of equal lines the first is judged by the other rules, the later ones fail.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1).alias("lines"))
    rows = rows.withColumn("lines", F.transform("lines", _line))

    def later(s):  # places of lines equal to an earlier one
        return F.transform(F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["line"] == x["line"], F.lit(False))), lambda x: x["at"])

    worded = F.transform(F.filter("lines", lambda x: x["n"] > 0), lambda x: F.struct(x["line"].alias("line"), x["at"].alias("at")))
    repeats = bound(worded, lambda w: F.when(F.size(F.array_distinct(F.transform(w, lambda x: x["line"]))) == F.size(w), F.array().cast("array<int>"))
                    .otherwise(bound(F.sort_array(w), later)))
    rows = rows.withColumn("repeats", repeats)
    # Places as a map's keys would be searched one by one, so the repeated ones are marked by one pass over a flag per line.
    flags = F.when(F.size("repeats") == 0, F.array().cast("array<boolean>")).otherwise(_marks(F.col("repeats"), F.size("lines")))
    judged = bound(F.struct(F.col("lines").alias("l"), flags.alias("f")), lambda s: F.transform(s["l"], lambda x, i: F.struct(
        x["line"].alias("line"), x["at"].alias("at"),
        F.when(x["n"] > 0, line_rule(x, F.coalesce(F.get(s["f"], i), F.lit(False)))).alias("rule"))))
    rows = rows.withColumn("judged", judged)
    gone = F.filter("judged", lambda x: x["rule"].isNotNull())
    size = lambda lines: F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x["line"]))
    total = lambda name: F.aggregate("lines", F.lit(0), lambda a, x: a + x[name]).cast("bigint").alias(name)
    rows = rows.select(
        "doc_id", "text", F.array_join(F.transform(F.filter("judged", lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n").alias("clean_text"),
        F.transform(gone, lambda x: F.struct(x["at"].alias("at"), x["rule"].alias("rule"))).alias("removed"),
        total("n").alias("n_words"), total("chars").alias("word_chars"), total("symbols").alias("n_symbols"),
        F.size("repeats").cast("bigint").alias("n_dup_lines"), repeated_words(F.flatten(F.transform("lines", lambda x: x["words"]))).alias("n_repeat_words"),
        size(gone).alias("cut"), size(F.col("judged")).alias("all"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return rows.withColumn("lost", F.when(F.col("all") > 0, 100 * F.col("cut").cast("double") / F.col("all")).otherwise(F.lit(0.0))) \
        .withColumn("base_failed", failed).withColumn("kept", ~failed & (100 * F.col("cut").cast("bigint") <= most_lost * F.col("all"))).drop("cut", "all")


def _marks(places: Column, n: Column) -> Column:
    """An array of n flags, true at the given places (ascending after sorting): gaps between neighbours become runs of false."""
    def build(at):
        runs = F.transform(at, lambda p, i: F.concat(F.array_repeat(F.lit(False), p - F.when(i > 0, F.get(at, i - 1) + 1).otherwise(0)), F.array(F.lit(True))))
        return F.concat(F.flatten(runs), F.array_repeat(F.lit(False), n - 1 - F.element_at(at, -1)))
    return bound(F.sort_array(places), build)
