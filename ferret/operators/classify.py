"""Classification and scoring (D1-D13): pure Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import clean_text, col_, contains_any, ordered_matches


def _lower_query(query: str | None) -> str | None:
    return query.lower() if query else None


def detect_languages_broad(title, description, body_lower, query: str | None = None,
                           languages=None) -> Column:
    """Names found in title+description (list order), else in the body; then the query
    is moved first (legacy names) or appended when missing.

    Single-expression form; over whole tables prefer ``with_languages_broad``, which stages
    the intermediate lists as columns so each is evaluated once per row."""
    languages = languages or rules.LANGUAGES_BROAD
    head = F.lower(F.concat_ws(" ", col_(title), col_(description)))
    found = ordered_matches(head, [l.lower() for l in languages])
    in_body = ordered_matches(col_(body_lower), [l.lower() for l in languages])
    langs = F.when(F.size(found) > 0, found).otherwise(in_body)
    q = _lower_query(query)
    if q is None:
        return langs
    if q in rules.LEGACY_FIRST_QUERIES:
        langs = F.concat(F.array(F.lit(q)), F.array_remove(langs, q))
    return F.when(F.array_contains(langs, q), langs).otherwise(F.concat(langs, F.array(F.lit(q))))


def with_languages_broad(df: DataFrame, title, description, body_lower, query: str | None = None,
                         out: str = "languages", languages=None) -> DataFrame:
    """D1 as staged columns: the lower-cased head text and each intermediate list are
    computed once per row (a lambda would otherwise re-evaluate them per list entry)."""
    languages = [l.lower() for l in (languages or rules.LANGUAGES_BROAD)]
    df = df.withColumn("_head", F.lower(F.concat_ws(" ", col_(title), col_(description))))
    df = df.withColumn("_found", ordered_matches(F.col("_head"), languages))
    df = df.withColumn("_langs", F.when(F.size("_found") > 0, F.col("_found"))
                       .otherwise(ordered_matches(col_(body_lower), languages)))
    langs = F.col("_langs")
    q = _lower_query(query)
    if q is not None:
        if q in rules.LEGACY_FIRST_QUERIES:
            df = df.withColumn("_langs", F.concat(F.array(F.lit(q)), F.array_remove(langs, q)))
        langs = F.when(F.array_contains(F.col("_langs"), q), F.col("_langs")) \
            .otherwise(F.concat(F.col("_langs"), F.array(F.lit(q))))
    return df.withColumn(out, langs).drop("_found", "_langs")


def detect_languages_narrow(title, description, languages=None) -> Column:
    """The narrow list, title+description only."""
    languages = languages or rules.LANGUAGES_NARROW
    head = F.lower(F.concat_ws(" ", col_(title), col_(description)))
    return ordered_matches(head, languages)


def detect_language(url, title, description, tags, snippets, groups=None) -> Column:
    """D3: first group with a keyword in url+title+description+tags, else the first snippet
    (in order) matching a group, else 'unknown'."""
    groups = groups or rules.LANGUAGE_GROUPS
    tag_text = F.coalesce(F.array_join(F.split(col_(tags), ",", -1), " "), F.lit(""))
    text = F.lower(F.concat_ws(" ", F.coalesce(col_(url), F.lit("")),
                               F.coalesce(col_(title), F.lit("")),
                               F.coalesce(col_(description), F.lit("")), tag_text))

    def first_group(t: Column) -> Column:
        out = None
        for name, kws in groups:
            cond = contains_any(t, kws)
            out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
        return out

    per_snippet = F.transform(F.coalesce(col_(snippets), F.array().cast("array<string>")),
                              lambda s: first_group(F.lower(s)))
    from_snippets = F.try_element_at(F.array_compact(per_snippet), F.lit(1))
    return F.coalesce(first_group(text), from_snippets, F.lit("unknown"))


def resource_type(title, domain, url, broad: bool = True) -> Column:
    """D4 (broad) / D5 (narrow): type cascade over title, domain and URL; default article."""
    t, d, u = F.lower(col_(title)), col_(domain), col_(url)
    c = F.when(t.contains("tutorial") | t.contains("guide"), F.lit("tutorial")) \
        .when(t.contains("video") | d.contains("youtube"), F.lit("video")) \
        .when(t.contains("documentation") | d.contains("docs"), F.lit("documentation"))
    if broad:
        c = c.when(t.contains("reference") | t.contains("manual"), F.lit("documentation"))
    c = c.when(u.contains("/github.com/"), F.lit("repository")) \
        .when(contains_any(u, ["docs", "documentation", "reference"]), F.lit("documentation")) \
        .when(contains_any(u, ["tutorial", "guide", "how-to"]), F.lit("tutorial"))
    return c.otherwise(F.lit("article"))


def quality_processor(content, snippets, description, url) -> Column:
    """Content length 3/2/1, min(snippets, 3), description 2/1, reputation +3; /10, cap 1."""
    ln = F.coalesce(F.length(col_(content)), F.lit(0))
    s = (F.when(ln > 5000, 3).when(ln > 1000, 2).when(ln > 500, 1).otherwise(0)
         + F.least(F.coalesce(F.size(col_(snippets)), F.lit(0)), F.lit(3))
         + F.when(F.length(col_(description)) > 100, 2)
         .when(F.length(col_(description)) > 50, 1).otherwise(0)
         + F.when(contains_any(F.coalesce(col_(url), F.lit("")), rules.REPUTATION_SITES), 3)
         .otherwise(0))
    return F.least(s.cast("double") / F.lit(10.0), F.lit(1.0))


def quality_broad(domain, snippets, content, query: str | None = None) -> Column:
    """0.5 base; +0.2 priority domain; +0.3 domain for the query; snippets up to +0.2;
    +0.15 / +0.1 for content longer than 5000 / 2000; cap 1.0."""
    d = F.coalesce(col_(domain), F.lit(""))
    n = F.coalesce(F.size(col_(snippets)), F.lit(0))
    ln = F.coalesce(F.length(col_(content)), F.lit(0))
    q = _lower_query(query)
    qdom = rules.QUERY_PRIORITY_DOMAINS.get(q, []) if q else []
    score = (F.lit(0.5)
             + F.when(contains_any(d, rules.QUALITY_PRIORITY_DOMAINS), F.lit(0.2)).otherwise(0.0)
             + F.when(contains_any(d, qdom), F.lit(0.3)).otherwise(0.0)
             + F.when(n > 0, F.least(F.lit(0.2), n * F.lit(0.05))).otherwise(0.0)
             + F.when(ln > 5000, F.lit(0.15)).when(ln > 2000, F.lit(0.1)).otherwise(0.0))
    return F.least(F.lit(1.0), score)


def quality_narrow(snippets, description, tags, url) -> Column:
    """Mean of has_code, min(1, len(description)/500), has_tags, 0.5 for an authority URL."""
    has_code = F.when(F.coalesce(F.size(col_(snippets)), F.lit(0)) > 0, 1.0).otherwise(0.0)
    length = F.least(F.lit(1.0), F.coalesce(F.length(col_(description)), F.lit(0)) / F.lit(500.0))
    has_tags = F.when(F.coalesce(col_(tags), F.lit("")) != "", 1.0).otherwise(0.0)
    auth = F.when(contains_any(F.coalesce(col_(url), F.lit("")), rules.AUTHORITY_URL_PARTS),
                  0.5).otherwise(0.0)
    return (has_code + length + has_tags + auth) / F.lit(4.0)


def primary_language(language="language", languages="languages") -> Column:
    """D9."""
    return F.coalesce(col_(language), F.try_element_at(col_(languages), F.lit(1)))


def default_quality(q="quality_score") -> Column:
    """D10."""
    return F.coalesce(col_(q), F.lit(rules.DEFAULT_QUALITY))


def stamp(at: str | None = None) -> Column:
    """Processing time, or a fixed instant (tests, reproducible reruns)."""
    return F.to_timestamp(F.lit(at)) if at else F.current_timestamp()


def resource_id(url="url") -> Column:
    """D12."""
    return F.md5(col_(url))


def enrich_resources(resources: DataFrame, at: str | None = None) -> DataFrame:
    """Clean content (B12) -> language (D3) -> quality (D6) -> indexed_date."""
    r = resources.withColumn("content", clean_text("content"))
    r = r.withColumn("language", detect_language("url", "title", "description", "tags",
                                                 "code_snippets"))
    r = r.withColumn("quality_score", quality_processor("content", "code_snippets",
                                                        "description", "url"))
    return r.withColumn("indexed_date", stamp(at)).withColumn("resource_id", resource_id("url"))
