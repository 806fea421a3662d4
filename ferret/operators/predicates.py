"""Filters and predicates (C1-C10) as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from ..functions.elements import signal_name
from ..functions.text import WS_RUN, col_, contains_any, count_occurrences, netloc


def should_follow_broad(url, query: str | None = None) -> Column:
    """The ordered cascade of the standalone crawler; NULL/empty URL gives false."""
    u = col_(url)
    lu = F.lower(u)
    c = F.when(u.isNull() | ~(u.startswith("http://") | u.startswith("https://")), F.lit(False))
    c = c.when(reduce(lambda a, b: a | b, [lu.endswith(e) for e in rules.ARCHIVE_EXTENSIONS]),
               F.lit(False))
    if query:
        c = c.when(lu.contains(query.lower()), F.lit(True))
    c = c.when(contains_any(netloc(u), rules.FOLLOW_PRIORITY_DOMAINS), F.lit(True))
    c = c.when(contains_any(lu, rules.PROGRAMMING_PATHS), F.lit(True))
    c = c.when(contains_any(lu, rules.IRRELEVANT_PATTERNS), F.lit(False))
    return c.otherwise(F.lit(True))


def should_follow_narrow(url, allowed_domains=None) -> Column:
    """A relevant pattern (ignore case) AND the netloc contains an allowed domain.
    The shipped allowed list is empty, which makes the rule always false."""
    allowed = rules.ALLOWED_DOMAINS if allowed_domains is None else allowed_domains
    u = F.coalesce(col_(url), F.lit(""))
    pattern = "(?i)(" + "|".join(rules.RELEVANT_URL_PATTERNS) + ")"
    return u.rlike(pattern) & contains_any(netloc(u), allowed)


def url_has_valuable_word(url) -> Column:
    """C3b."""
    return contains_any(F.lower(F.coalesce(col_(url), F.lit(""))), rules.VALUABLE_URL_PATTERNS)


def meta_has_tech_word(meta_keywords, meta_description) -> Column:
    """Meta keywords or description contains a tech keyword."""
    k = F.lower(F.coalesce(col_(meta_keywords), F.lit("")))
    d = F.lower(F.coalesce(col_(meta_description), F.lit("")))
    return contains_any(k, rules.TECH_KEYWORDS) | contains_any(d, rules.TECH_KEYWORDS)


def query_in_headings(title, h1_text, h2_text, query: str | None) -> Column:
    """C3d: the query (ignore case) in the first title text, the h1 texts or the h2 texts."""
    if not query:
        return F.lit(False)
    q = query.lower()
    return (F.lower(F.coalesce(col_(title), F.lit(""))).contains(q)
            | F.lower(F.coalesce(col_(h1_text), F.lit(""))).contains(q)
            | F.lower(F.coalesce(col_(h2_text), F.lit(""))).contains(q))


def legacy_dense(body_lower, query: str | None) -> Column:
    """C3e: a legacy query occurring at least twice in the body text."""
    if not query or query.lower() not in rules.LEGACY_DENSE_QUERIES:
        return F.lit(False)
    return F.coalesce(count_occurrences(col_(body_lower), query.lower()) >= 2, F.lit(False))


def legacy_vocabulary(body_lower, query: str | None) -> Column:
    """C3f: at least three words of the query's own vocabulary in the body text."""
    if not query or query.lower() not in rules.LEGACY_VOCABULARY:
        return F.lit(False)
    b = F.coalesce(col_(body_lower), F.lit(""))
    hits = [F.when(b.contains(w), 1).otherwise(0) for w in rules.LEGACY_VOCABULARY[query.lower()]]
    return reduce(lambda a, c: a + c, hits) >= 3


def has_signal(signals, names) -> Column:
    return F.arrays_overlap(col_(signals), F.array(*[F.lit(n) for n in names]))


def is_resource_page_broad(url, signals, meta_keywords, meta_description, title, h1_text,
                           h2_text, body_lower, query: str | None = None) -> Column:
    """OR of structure signals, URL words, meta words, query in headings and the two
    legacy tests."""
    names = [signal_name(k, v) for k, v in rules.STRUCTURE_SIGNALS_BROAD]
    return (legacy_dense(body_lower, query)
            | F.coalesce(has_signal(signals, names), F.lit(False))
            | url_has_valuable_word(url)
            | meta_has_tech_word(meta_keywords, meta_description)
            | query_in_headings(title, h1_text, h2_text, query)
            | legacy_vocabulary(body_lower, query))


def is_resource_page_narrow(title, signals) -> Column:
    """C4: a programming word in the title, or one of ten structure signals."""
    names = [signal_name(k, v) for k, v in rules.STRUCTURE_SIGNALS_NARROW]
    t = F.lower(F.coalesce(col_(title), F.lit("")))
    return contains_any(t, rules.PROGRAMMING_TITLE_KEYWORDS) | \
        F.coalesce(has_signal(signals, names), F.lit(False))


def relevance_gate_broad(title, description, body_lower, query: str | None) -> Column:
    """Keep when the query is in title+description or in the body text (legacy names with
    three or more mentions pass too, which the body test already covers)."""
    if not query:
        return F.lit(True)
    q = query.lower()
    head = F.lower(F.concat_ws(" ", col_(title), col_(description)))
    return head.contains(q) | F.coalesce(col_(body_lower), F.lit("")).contains(q)


def relevance_gate_narrow(title, description, query: str | None) -> Column:
    """The query must be in title+description."""
    if not query:
        return F.lit(True)
    return F.lower(F.concat_ws(" ", col_(title), col_(description))).contains(query.lower())


def term_filter(field, value: str | None) -> Column:
    """Exact match; an empty value means no filter."""
    if not value:
        return F.lit(True)
    return F.coalesce(col_(field) == F.lit(value), F.lit(False))


def language_filter(value: str | None, language="language", languages="languages") -> Column:
    """Exact on ``language`` or member of ``languages``."""
    if not value:
        return F.lit(True)
    return F.coalesce((col_(language) == F.lit(value)) |
                      F.array_contains(col_(languages), F.lit(value)), F.lit(False))


def live_filter(language, type_, f_language: str | None, f_type: str | None) -> Column:
    """Case-insensitive equality on the first language and the type (live feed).
    A NULL language is a non-match."""
    c = F.lit(True)
    if f_language:
        c = c & (F.lower(F.coalesce(col_(language), F.lit(""))) == F.lit(f_language.lower()))
    if f_type:
        c = c & (F.lower(F.coalesce(col_(type_), F.lit(""))) == F.lit(f_type.lower()))
    return c


def query_words(query_col) -> Column:
    """str.split() of the lower-cased query: whitespace-separated, no empty words."""
    return F.array_remove(F.split(F.lower(col_(query_col)), WS_RUN, -1), "")


def all_terms(text_lower, query_col) -> Column:
    """Every whitespace-separated word of the (lower-cased) query occurs in the text."""
    terms = query_words(query_col)
    return F.forall(terms, lambda t: col_(text_lower).contains(t))


def term_count_score(text_lower, query_col) -> Column:
    """H3 score: sum over query words of non-overlapping occurrences."""
    terms = query_words(query_col)
    t = col_(text_lower)
    counts = F.transform(terms, lambda s: F.when(F.length(s) > 0,
                                                 ((F.length(t) - F.length(F.replace(t, s, F.lit(""))))
                                                  / F.length(s)).cast("long")).otherwise(F.lit(0)))
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b)
