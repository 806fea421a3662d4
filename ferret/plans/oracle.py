"""SQL building blocks for the DuckDB oracle.

Each block mirrors one adapter or operator of the Spark side expression by
expression. The driver registers the test tables as views; blocks here are CTEs.
Literals are cast to DOUBLE so DuckDB never switches to DECIMAL arithmetic.
"""

from __future__ import annotations

from .. import rules
from ..functions.text import REFERENCE_NAMES, REFERENCE_PATTERN, TOKEN_PATTERN, WS_RUN
from ..sources.adapters import ADAPTER_TYPES, ODD_MARKUP, REPEAT_EVERY
from ..operators.search import B, K1


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def contains_any(expr: str, words) -> str:
    if not words:
        return "FALSE"
    return "(" + " OR ".join(f"contains({expr}, {lit(w)})" for w in words) + ")"


def ordered_matches(expr: str, words) -> str:
    items = ", ".join(f"CASE WHEN contains({expr}, {lit(w)}) THEN {lit(w)} END" for w in words)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


NAMED = "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in REFERENCE_NAMES.items()) + "}"


def unescape(expr: str) -> str:
    pattern = lit(REFERENCE_PATTERN)
    one = (f"CASE WHEN regexp_matches(z[1], '^&#[xX]') THEN chr(CAST('0x' || substr(z[1], 4, length(z[1]) - 4) AS INTEGER)) "
           f"WHEN starts_with(z[1], '&#') THEN chr(CAST(substr(z[1], 3, length(z[1]) - 3) AS INTEGER)) "
           f"ELSE coalesce({NAMED}[substr(z[1], 2, length(z[1]) - 2)], z[1]) END")
    return (f"list_transform([{expr}], lambda e: CASE WHEN contains(e, '&') THEN regexp_split_to_array(e, {pattern})[1] || "
            f"array_to_string(list_transform(list_zip(regexp_extract_all(e, {pattern}), regexp_split_to_array(e, {pattern})[2:]), "
            f"lambda z: {one} || z[2]), '') ELSE e END)[1]")


def squeeze(expr: str) -> str:
    return f"trim(regexp_replace({expr}, {lit(WS_RUN)}, ' ', 'g'))"


def tokens(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), {lit(TOKEN_PATTERN)}, 0)"


def D(x) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def doc_url(alias: str = "") -> str:
    a = f"{alias}." if alias else ""
    return (f"'https://www.example.com/' || CAST({a}doc_id - "
            f"CASE WHEN {a}doc_id % {REPEAT_EVERY} = {REPEAT_EVERY - 1} THEN 1 ELSE 0 END AS VARCHAR)")


RESOURCES = f"""
res0 AS (
  SELECT d.*, {doc_url('d')} AS url, split_part(d.text, chr(10), 1) AS title0
  FROM documents d
),
res AS (
  SELECT doc_id, md5(url) AS resource_id, url, title0 AS title,
         nullif(substr(text, length(title0) + 2), '') AS description,
         text AS content, CAST([] AS VARCHAR[]) AS code_snippets, CAST(NULL AS VARCHAR) AS tags,
         source AS domain, {lst(ADAPTER_TYPES)}[doc_id % 5 + 1] AS type,
         [lang] AS languages, CAST(NULL AS VARCHAR) AS language,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS BIGINT)) AS timestamp,
         CAST(NULL AS DOUBLE) AS quality_score,
         coalesce(CAST(NULL AS VARCHAR), lang) AS plang
  FROM res0
)"""


def queries(type_=None, language=None, page=0, size=10) -> str:
    t = "CAST(NULL AS VARCHAR)" if type_ is None else lit(type_)
    lg = "CAST(NULL AS VARCHAR)" if language is None else lit(language)
    return f"""
qry AS (
  SELECT item_id AS query_id, text AS q,
         {t} AS type, {lg} AS language, {page} AS page, {size} AS size
  FROM benchmark
)"""


def index(fields=None) -> str:
    fields = fields or rules.SEARCH_FIELDS
    parts = []
    for f in fields:
        expr = "array_to_string(code_snippets, ' ')" if f == "code_snippets" else f
        parts.append(f"SELECT doc_id, '{f}' AS field, {expr} AS text FROM res WHERE {expr} IS NOT NULL")
    union = "\n    UNION ALL ".join(parts)
    return f"""
ftext AS (
    {union}
),
tok AS (
  SELECT doc_id, field, toks, len(toks) AS dl
  FROM (SELECT doc_id, field, {tokens('text')} AS toks FROM ftext)
  WHERE len(toks) > 0
),
postings AS (
  SELECT field, term, doc_id, dl, count(*) AS tf
  FROM (SELECT field, doc_id, dl, unnest(toks) AS term FROM tok)
  GROUP BY field, term, doc_id, dl
),
term_stats AS (SELECT field, term, count(*) AS df FROM postings GROUP BY field, term),
field_stats AS (SELECT field, count(*) AS n_docs, avg(dl) AS avgdl FROM tok GROUP BY field)"""


QTERMS = f"""
qterms AS (
  SELECT query_id, term, count(*) AS qtf
  FROM (SELECT query_id, unnest({tokens('q')}) AS term FROM qry)
  GROUP BY query_id, term
)"""


def term_scores(fields=None) -> str:
    fields = fields or rules.SEARCH_FIELDS
    flist = ", ".join(lit(f) for f in fields)
    return f"""
weights AS (
  SELECT qt.query_id, ts.field, ts.term, qt.qtf,
         ln({D(1.0)} + (fs.n_docs - ts.df + {D(0.5)}) / (ts.df + {D(0.5)})) AS idf, fs.avgdl
  FROM term_stats ts JOIN qterms qt ON ts.term = qt.term JOIN field_stats fs ON ts.field = fs.field
  WHERE ts.field IN ({flist})
),
tscores AS (
  SELECT w.query_id, p.doc_id, p.field, p.term, p.tf, p.dl, w.idf, w.avgdl,
         w.qtf * w.idf * (p.tf * {D(K1 + 1)} / (p.tf + {D(K1)} * ({D(1 - B)} + {D(B)} * p.dl / w.avgdl))) AS score
  FROM postings p JOIN weights w ON p.field = w.field AND p.term = w.term
)"""


def match_scores(fields=None, boosts=None) -> str:
    fields = fields or rules.SEARCH_FIELDS
    boosts = boosts or rules.FIELD_BOOSTS
    sums = ", ".join(f"sum(CASE WHEN field = '{f}' THEN score END) AS s_{f}" for f in fields)
    if len(fields) > 1:
        best = "greatest(" + ", ".join(
            f"{D(boosts.get(f, 1.0))} * coalesce(s_{f}, {D(0.0)})" for f in fields) + ")"
    else:
        best = f"{D(boosts.get(fields[0], 1.0))} * s_{fields[0]}"
    return term_scores(fields) + f""",
sagg AS (SELECT query_id, doc_id, {sums} FROM tscores GROUP BY query_id, doc_id),
scores AS (SELECT query_id, doc_id, {best} AS score FROM sagg)"""


MATCHES = """
matches AS (
  SELECT s.query_id, s.doc_id, s.score, round(s.score, 6) AS rscore, r.url, r.type, r.plang,
         r.timestamp
  FROM scores s JOIN res r ON s.doc_id = r.doc_id JOIN qry q ON s.query_id = q.query_id
  WHERE (coalesce(q.type, '') = '' OR coalesce(r.type = q.type, FALSE))
    AND (coalesce(q.language, '') = '' OR
         coalesce(r.language = q.language OR list_contains(r.languages, q.language), FALSE))
)"""

ORDER = "rscore DESC, url ASC NULLS FIRST, doc_id"

COLLAPSED = """
collapsed AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY rscore DESC, doc_id) AS _r
    FROM matches) WHERE _r = 1
)"""

PAGE = f"""
page_hits AS (
  SELECT c.* FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {ORDER}) AS rank FROM collapsed) c
  JOIN qry q ON c.query_id = q.query_id
  WHERE q.page >= 0 AND q.size BETWEEN 1 AND {rules.MAX_PAGE_SIZE}
    AND c.rank > q.page * q.size AND c.rank <= (q.page + 1) * q.size
)"""

FORMAT_HITS = f"""
SELECT h.query_id, h.rank, h.doc_id AS id, round(h.score, 6) AS score, r.url, r.title,
       r.description, r.type, r.plang AS language,
       coalesce(r.quality_score, {D(rules.DEFAULT_QUALITY)}) AS quality_score
FROM page_hits h JOIN res r ON h.doc_id = r.doc_id"""


def with_(*blocks: str) -> str:
    return "WITH " + ",".join(b.strip("\n") for b in blocks)


# ------------------------------------------------------------------ pages (B)

from ..functions import elements as E  # noqa: E402
from ..functions import html as H  # noqa: E402
from ..functions.text import NETLOC_PATTERN, UNROLL_LIMIT  # noqa: E402


def first_tag_text(html: str, tag: str) -> str:
    return f"nullif({unescape(f'regexp_extract({html}, {lit(H.first_text_of(tag))}, 1)')}, '')"


def own_text(html: str, tag: str) -> str:
    left = f"regexp_replace(x, {lit(H.VOID_PATTERN)}, chr(1), 'g')"
    for _ in range(H.NESTING):
        left = f"regexp_replace({left}, {lit(H.CHILD_PATTERN)}, chr(1), 'g')"
    found = f"regexp_extract_all({html}, {lit(H.element_pattern(tag))}, 1)"
    texts = f"flatten(list_transform({found}, lambda x: regexp_split_to_array({left}, {lit(H.OWN_TEXT_SPLIT)})))"
    return unescape(f"list_filter({texts}, lambda y: y <> '')[1]")


def unquoted(value: str) -> str:
    return f"(CASE WHEN regexp_matches({value}, '^[\"'']') THEN substr({value}, 2, length({value}) - 2) ELSE {value} END)"


def meta_content(html: str, name: str) -> str:
    tag = f"regexp_extract({html}, {lit(H.meta_tag_pattern(name))}, 0)"
    value = f"nullif(regexp_extract({tag}, {lit(H.CONTENT_ATTR)}, 1), '')"
    return unescape(f"list_transform([{value}], lambda v: {unquoted('v')})[1]")


def body_text(html: str) -> str:
    rest = f"regexp_replace(regexp_replace({html}, {lit(H.HEAD_PATTERN)}, ''), {lit(H.TITLE_PATTERN)}, '', 'g')"
    body = f"CASE WHEN regexp_matches({html}, {lit(H.HAS_BODY_PATTERN)}) THEN regexp_extract({html}, {lit(H.BODY_PATTERN)}, 1) ELSE {rest} END"
    pieces = f"list_filter(regexp_split_to_array({body}, {lit(H.TAG_RUN_PATTERN)}), lambda x: x <> '')"
    return f"lower({unescape(f'array_to_string({pieces}, {lit(chr(32))})')})"


def title(html: str) -> str:
    return f"coalesce({first_tag_text(html, 'title')}, {own_text(html, 'h1')})"


def netloc(url: str) -> str:
    return f"regexp_extract({url}, {lit(NETLOC_PATTERN)}, 1)"


def attribute(raw: str, name: str) -> str:
    found = f"list_filter(regexp_extract_all({raw}, {lit(E.ATTRIBUTE)}, 0), lambda a: regexp_matches(a, {lit(rf'(?i)^{name}[[:space:]]*=')}))[1]"
    value = f"regexp_extract({found}, {lit('(?s)=[[:space:]]*(.*)$')}, 1)"
    bare = f"list_transform([{value}], lambda v: {unquoted('v')})[1]"
    guard = lit(rf"(?i)[\s\"'/]{name}\s*=")
    return f"CASE WHEN regexp_matches({raw}, {guard}) THEN {unescape(bare)} END"


def token_list(html: str) -> str:
    return f"list_filter(regexp_extract_all(coalesce({html}, ''), {lit(E.TOKEN)}, 0), lambda x: NOT regexp_matches(x, {lit(E.SKIPPED)}))"


def hrefs(html: str) -> str:
    tags = f"list_filter({token_list(html)}, lambda t: lower(regexp_extract(t, {lit(E.NAME)}, 1)) = 'a' AND NOT starts_with(t, '</'))"
    return f"list_filter(list_transform({tags}, lambda t: {attribute('t', 'href')}), lambda v: coalesce(v, '') <> '')"


def _values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else lit(v) for v in r) + ")" for r in rows)


def _signal_rules():
    seen, out = set(), []
    for kind, value in rules.STRUCTURE_SIGNALS_BROAD + rules.STRUCTURE_SIGNALS_NARROW:
        name = E.signal_name(kind, value)
        if name not in seen:
            seen.add(name)
            out.append((len(out), name, kind, *(value if isinstance(value, tuple) else ("", ""))))
    return out


def _content_of(name: str, selectors) -> str:
    return f"""
{name}_sel AS (SELECT * FROM ({_values([(i, E.selector_key(x)) for i, x in enumerate(selectors)])}) v(ord, key)),
{name}_hit AS (SELECT DISTINCT t.page_id, t.i, t.text, s.ord FROM texts t JOIN keys k ON k.page_id = t.page_id AND k.i = t.parent JOIN {name}_sel s ON s.key = k.key),
{name} AS (SELECT page_id, string_agg(text, ' ' ORDER BY i) AS content FROM {name}_hit h
           WHERE ord = (SELECT min(ord) FROM {name}_hit x WHERE x.page_id = h.page_id) GROUP BY page_id)"""


def tree(pages: str = "wpages") -> str:
    """Tokens, the stack of open elements step by step (a recursive query), texts with their element, and the fields made of them."""
    cut = lambda c, tag: f"w.{c}[list_position(w.tags, {tag}) + 1:]"
    ended = lambda c: f"CASE WHEN t.kind IN ('open', 'void') AND list_contains({lst(E.CLOSES_P)}, t.tag) AND list_contains(w.tags, 'p') THEN {cut(c, lit('p'))} ELSE w.{c} END"
    return f"""
tokn AS (SELECT page_id, unnest(range(len(ts))) AS i, unnest(ts) AS raw FROM (SELECT page_id, {token_list('html')} AS ts FROM {pages})),
tok AS (
  SELECT page_id, i, raw, tag, CASE WHEN tag = '' THEN 'text' WHEN starts_with(raw, '</') THEN 'close'
         WHEN list_contains({lst(E.VOID)}, tag) OR ends_with(raw, '/>') THEN 'void' ELSE 'open' END AS kind
  FROM (SELECT *, lower(regexp_extract(raw, {lit(E.NAME)}, 1)) AS tag FROM tokn)),
walk AS (
  SELECT page_id, CAST(-1 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS tags, CAST([] AS BIGINT[]) AS ids, CAST(NULL AS BIGINT) AS parent, FALSE AS in_pre FROM {pages}
  UNION ALL
  SELECT page_id, i, CASE kind WHEN 'open' THEN list_concat([tag], btags) WHEN 'void' THEN btags WHEN 'close' THEN ctags ELSE tags END,
         CASE kind WHEN 'open' THEN list_concat([i], bids) WHEN 'void' THEN bids WHEN 'close' THEN cids ELSE ids END,
         CASE WHEN kind = 'text' AND len(tags) > 0 THEN ids[1] END, list_contains(tags[2:], 'pre')
  FROM (SELECT t.page_id, t.i, t.tag, t.kind, w.tags, w.ids, {ended('tags')} AS btags, {ended('ids')} AS bids,
               CASE WHEN list_contains(w.tags, t.tag) THEN {cut('tags', 't.tag')} ELSE w.tags END AS ctags,
               CASE WHEN list_contains(w.tags, t.tag) THEN {cut('ids', 't.tag')} ELSE w.ids END AS cids
        FROM walk w JOIN tok t ON t.page_id = w.page_id AND t.i = w.i + 1)),
texts AS (
  SELECT w.page_id, w.i, w.parent, w.in_pre, p.tag, {unescape('t.raw')} AS text
  FROM walk w JOIN tok t ON t.page_id = w.page_id AND t.i = w.i JOIN tok p ON p.page_id = w.page_id AND p.i = w.parent),
els AS (SELECT page_id, i, tag, {attribute('raw', 'class')} AS cls, {attribute('raw', 'id')} AS id FROM tok WHERE kind IN ('open', 'void')),
keys AS (
  SELECT page_id, i, 'tag:' || tag AS key FROM els UNION ALL SELECT page_id, i, 'id:' || id FROM els WHERE id IS NOT NULL
  UNION ALL SELECT page_id, i, 'class:' || c FROM (SELECT page_id, i, unnest(regexp_split_to_array(cls, '[ \\t\\n\\f\\r]+')) AS c FROM els WHERE cls IS NOT NULL) WHERE c <> ''),
rule AS (SELECT * FROM ({_values(_signal_rules())}) v(ord, name, kind, a, b)),
heads AS (SELECT page_id, tag, text FROM texts WHERE tag IN ('h1', 'h2') QUALIFY row_number() OVER (PARTITION BY page_id, parent ORDER BY i) = 1),
found AS (
  SELECT k.page_id, r.ord, r.name FROM keys k JOIN rule r ON r.kind IN ('tag', 'class', 'id') AND r.name = k.key
  UNION SELECT h.page_id, r.ord, r.name FROM heads h JOIN rule r ON r.a = h.tag AND (r.kind = 'heading' AND contains(lower(h.text), r.b) OR r.kind = 'heading_cs' AND contains(h.text, r.b))
  UNION SELECT e.page_id, r.ord, r.name FROM els e JOIN rule r ON r.kind = 'class_has' AND r.a = e.tag AND contains(e.cls, r.b)),
sigs AS (SELECT page_id, list(name ORDER BY ord) AS signals FROM found GROUP BY page_id),
lists AS (
  SELECT page_id, list(text ORDER BY i) FILTER (WHERE tag = 'p') AS p_texts, string_agg(text, ' ' ORDER BY i) FILTER (WHERE tag = 'h1') AS h1,
         string_agg(text, ' ' ORDER BY i) FILTER (WHERE tag = 'h2') AS h2, list(text ORDER BY i) FILTER (WHERE tag = 'pre') AS pre_texts,
         list(text ORDER BY i) FILTER (WHERE tag = 'code' AND in_pre) AS pre_code
  FROM texts GROUP BY page_id),""" + _content_of("broad", rules.CONTENT_SELECTORS_BROAD) + "," + _content_of("narrow", rules.CONTENT_SELECTORS_NARROW) + f""",
pf AS (
  SELECT p.page_id, p.url, coalesce(l.p_texts, []) AS p_texts, coalesce(l.h1, '') AS h1, coalesce(l.h2, '') AS h2, coalesce(l.pre_code, []) AS pre_code,
         coalesce(l.pre_texts, []) AS pre_texts, b.content AS content_broad, n.content AS content_narrow, coalesce(s.signals, []) AS signals,
         {title('p.html')} AS title_raw, coalesce({first_tag_text('p.html', 'title')}, '') AS title_only, {meta_content('p.html', 'description')} AS md,
         {meta_content('p.html', 'keywords')} AS tags, {body_text('p.html')} AS body, {netloc('p.url')} AS domain
  FROM {pages} p LEFT JOIN lists l ON l.page_id = p.page_id LEFT JOIN broad b ON b.page_id = p.page_id LEFT JOIN narrow n ON n.page_id = p.page_id
  LEFT JOIN sigs s ON s.page_id = p.page_id),
pd AS (SELECT *, CASE WHEN coalesce(md, '') <> '' THEN md ELSE array_to_string(p_texts[1:3], ' ') END AS desc_raw FROM pf)"""


def with_tree(*blocks: str) -> str:
    return "WITH RECURSIVE " + ",".join(b.strip("\n") for b in blocks)


def has_signal(lists) -> str:
    return f"list_has_any(signals, {lst([E.signal_name(k, v) for k, v in lists])})"


def is_resource_page_broad(query: str | None) -> str:
    parts = [has_signal(rules.STRUCTURE_SIGNALS_BROAD), contains_any_hof("lower(coalesce(url, ''))", rules.VALUABLE_URL_PATTERNS),
             contains_any_hof("lower(coalesce(tags, ''))", rules.TECH_KEYWORDS), contains_any_hof("lower(coalesce(md, ''))", rules.TECH_KEYWORDS)]
    if query:
        q = lit(query.lower())
        parts += [f"contains(lower(title_only), {q})", f"contains(lower(h1), {q})", f"contains(lower(h2), {q})"]
        if query.lower() in rules.LEGACY_DENSE_QUERIES:
            parts.append(f"coalesce({count_occ('body', q)} >= 2, FALSE)")
        if query.lower() in rules.LEGACY_VOCABULARY:
            parts.append("(" + " + ".join(f"CASE WHEN contains(coalesce(body, ''), {lit(w)}) THEN 1 ELSE 0 END" for w in rules.LEGACY_VOCABULARY[query.lower()]) + ") >= 3")
    return "(" + " OR ".join(parts) + ")"


def is_resource_page_narrow() -> str:
    return f"({contains_any('lower(title_only)', rules.PROGRAMMING_TITLE_KEYWORDS)} OR {has_signal(rules.STRUCTURE_SIGNALS_NARROW)})"


USABLE = "coalesce(title_raw, '') <> '' AND coalesce(desc_raw, '') <> ''"


def extraction(query: str | None, mode: str) -> str:
    """B13 over pd, as the resource view of its queries."""
    broad = mode == "broad"
    q = query.lower() if query else None
    page_ok = is_resource_page_broad(query) if broad else is_resource_page_narrow()
    langs = detect_languages_broad("title", "description", "body", query) if broad else detect_languages_narrow("title", "description")
    head = "lower(concat_ws(' ', title, description))"
    gate = "TRUE" if not q else f"(contains({head}, {lit(q)}) OR contains(coalesce(body, ''), {lit(q)}))" if broad else f"contains({head}, {lit(q)})"
    snippets = "pre_code"
    if broad and q in rules.LEGACY_PRE_QUERIES:
        snippets = f"CASE WHEN len(pre_code) = 0 THEN list_filter(pre_texts, lambda x: contains(lower(x), {lit(q)})) ELSE pre_code END"
    content = "content_broad" if broad else "content_narrow"
    quality = quality_broad("domain", "snippets", content, query) if broad else quality_narrow("snippets", "description", "tags", "url")
    return f"""
ok AS (SELECT *, {squeeze('title_raw')} AS title, {squeeze('desc_raw')} AS description, {snippets} AS snippets FROM pd WHERE {page_ok} AND {USABLE}),
lng AS (SELECT *, {langs} AS languages FROM ok WHERE {gate})
SELECT page_id AS doc_id, url, title, description, {resource_type('title', 'domain', 'url', broad)} AS type, array_to_string(languages, ',') AS languages,
       round({quality}, 6) AS quality_score, len(snippets) AS n_snippets, length({content}) AS content_len, tags, domain
FROM lng"""


def contains_any_hof(expr: str, words) -> str:
    if len(words) > UNROLL_LIMIT:
        return f"len(list_filter({lst(words)}, lambda w: contains({expr}, w))) > 0"
    return contains_any(expr, words)


def ordered(expr: str, words) -> str:
    if len(words) > UNROLL_LIMIT:
        return f"list_filter({lst(words)}, lambda w: contains({expr}, w))"
    return ordered_matches(expr, words)


WIDE_PAGES = f"""
wpages AS (
  SELECT page_id,
         url || CASE page_id % 5 WHEN 1 THEN '/tutorial' WHEN 2 THEN '/docs/reference'
                 WHEN 3 THEN '/file.zip' WHEN 4 THEN '/checkout' ELSE '' END AS url,
         html || CASE page_id % 4 WHEN 1 THEN '<pre><code>print(1)</code></pre>'
                 WHEN 2 THEN '<meta name="keywords" content="python,code">'
                 WHEN 3 THEN '<h2>Introduction</h2><a href="https://github.com/x">x</a>'
                 ELSE '' END
              || CASE WHEN page_id % 6 = 5
                 THEN '<meta name="description" content="A guide to cobol">' ELSE '' END
              || CASE WHEN page_id % 7 = 3 THEN {lit(ODD_MARKUP)} ELSE '' END AS html
  FROM pages
)"""


#: Pages whose articles became sections, or that have a main element, so pages without signals and other selectors exist.
VARIED_PAGES = WIDE_PAGES + """,
vpages AS (
  SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN regexp_replace(html, '(</?)article', '\\1section', 'g') ELSE html END
         || CASE WHEN page_id % 6 = 0 THEN '<main>main ' || page_id || '</main>' WHEN page_id % 6 = 1 THEN '<div class="post content">posted ' || page_id || '</div>' ELSE '' END AS html
  FROM wpages)"""


def resolve_url(base: str, href: str) -> str:
    h = f"trim({href})"
    scheme = f"regexp_extract({base}, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)"
    origin = f"regexp_extract({base}, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1)"
    no_frag = f"regexp_extract({base}, '^([^#]*)', 1)"
    no_query = f"regexp_extract({base}, '^([^?#]*)', 1)"
    path = f"regexp_extract({base}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    dir_ = f"regexp_extract({path}, '^(.*/)', 1)"
    return f"""(CASE WHEN regexp_matches({h}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN {h}
      WHEN starts_with({h}, '//') THEN {scheme} || ':' || {h}
      WHEN starts_with({h}, '/') THEN {origin} || {h}
      WHEN {h} = '' THEN {no_frag}
      WHEN starts_with({h}, '#') THEN {no_frag} || {h}
      WHEN starts_with({h}, '?') THEN {no_query} || {h}
      ELSE {origin} || CASE WHEN {dir_} = '' THEN '/' ELSE {dir_} END || {h} END)"""


def clean_text(expr: str) -> str:
    return f"coalesce(regexp_replace({squeeze(expr)}, '<[^>]+>', '', 'g'), '')"


# ------------------------------------------------------- classify (D) / predicates (C)

def detect_languages_broad(title: str, desc: str, body: str, query: str | None) -> str:
    words = [w.lower() for w in rules.LANGUAGES_BROAD]
    head = f"lower(concat_ws(' ', {title}, {desc}))"
    found, in_body = ordered(head, words), ordered(body, words)
    langs = f"(CASE WHEN len({found}) > 0 THEN {found} ELSE {in_body} END)"
    if not query:
        return langs
    q = query.lower()
    if q in rules.LEGACY_FIRST_QUERIES:
        langs = f"list_concat([{lit(q)}], list_filter({langs}, lambda x: x <> {lit(q)}))"
    return f"(CASE WHEN list_contains({langs}, {lit(q)}) THEN {langs} ELSE list_append({langs}, {lit(q)}) END)"


def detect_languages_narrow(title: str, desc: str) -> str:
    return ordered(f"lower(concat_ws(' ', {title}, {desc}))", rules.LANGUAGES_NARROW)


def _first_group(t: str) -> str:
    whens = " ".join(f"WHEN {contains_any(t, kws)} THEN {lit(name)}"
                     for name, kws in rules.LANGUAGE_GROUPS)
    return f"(CASE {whens} END)"


def detect_language(url: str, title: str, desc: str, tags: str, snippets: str) -> str:
    tag_text = f"coalesce(array_to_string(string_split({tags}, ','), ' '), '')"
    text = (f"lower(concat_ws(' ', coalesce({url}, ''), coalesce({title}, ''), "
            f"coalesce({desc}, ''), {tag_text}))")
    per = f"list_filter(list_transform(coalesce({snippets}, []), lambda s: {_first_group('lower(s)')}), lambda x: x IS NOT NULL)"
    return f"coalesce({_first_group(text)}, {per}[1], 'unknown')"


def resource_type(title: str, domain: str, url: str, broad: bool = True) -> str:
    t = f"lower({title})"
    parts = [f"WHEN contains({t}, 'tutorial') OR contains({t}, 'guide') THEN 'tutorial'",
             f"WHEN contains({t}, 'video') OR contains({domain}, 'youtube') THEN 'video'",
             f"WHEN contains({t}, 'documentation') OR contains({domain}, 'docs') THEN 'documentation'"]
    if broad:
        parts.append(f"WHEN contains({t}, 'reference') OR contains({t}, 'manual') THEN 'documentation'")
    parts += [f"WHEN contains({url}, '/github.com/') THEN 'repository'",
              f"WHEN {contains_any(url, ['docs', 'documentation', 'reference'])} THEN 'documentation'",
              f"WHEN {contains_any(url, ['tutorial', 'guide', 'how-to'])} THEN 'tutorial'"]
    return "(CASE " + " ".join(parts) + " ELSE 'article' END)"


def quality_processor(content: str, snippets: str, desc: str, url: str) -> str:
    ln = f"coalesce(length({content}), 0)"
    dl = f"length({desc})"
    return (f"least(CAST((CASE WHEN {ln} > 5000 THEN 3 WHEN {ln} > 1000 THEN 2 WHEN {ln} > 500 THEN 1 ELSE 0 END"
            f" + least(coalesce(len({snippets}), 0), 3)"
            f" + CASE WHEN {dl} > 100 THEN 2 WHEN {dl} > 50 THEN 1 ELSE 0 END"
            f" + CASE WHEN {contains_any(f'coalesce({url}, {lit(chr(39)*0)})', rules.REPUTATION_SITES)} THEN 3 ELSE 0 END)"
            f" AS DOUBLE) / {D(10.0)}, {D(1.0)})")


def quality_broad(domain: str, snippets: str, content: str, query: str | None) -> str:
    d = f"coalesce({domain}, '')"
    n = f"coalesce(len({snippets}), 0)"
    ln = f"coalesce(length({content}), 0)"
    q = query.lower() if query else None
    qdom = rules.QUERY_PRIORITY_DOMAINS.get(q, []) if q else []
    return (f"least({D(1.0)}, {D(0.5)}"
            f" + CASE WHEN {contains_any(d, rules.QUALITY_PRIORITY_DOMAINS)} THEN {D(0.2)} ELSE {D(0.0)} END"
            f" + CASE WHEN {contains_any(d, qdom)} THEN {D(0.3)} ELSE {D(0.0)} END"
            f" + CASE WHEN {n} > 0 THEN least({D(0.2)}, {n} * {D(0.05)}) ELSE {D(0.0)} END"
            f" + CASE WHEN {ln} > 5000 THEN {D(0.15)} WHEN {ln} > 2000 THEN {D(0.1)} ELSE {D(0.0)} END)")


def quality_narrow(snippets: str, desc: str, tags: str, url: str) -> str:
    return (f"((CASE WHEN coalesce(len({snippets}), 0) > 0 THEN {D(1.0)} ELSE {D(0.0)} END"
            f" + least({D(1.0)}, coalesce(length({desc}), 0) / {D(500.0)})"
            f" + CASE WHEN coalesce({tags}, '') <> '' THEN {D(1.0)} ELSE {D(0.0)} END"
            f" + CASE WHEN {contains_any(f'coalesce({url}, {lit(chr(39)*0)})', rules.AUTHORITY_URL_PARTS)}"
            f" THEN {D(0.5)} ELSE {D(0.0)} END) / {D(4.0)})")


def should_follow_broad(url: str, query: str | None) -> str:
    lu = f"lower({url})"
    exts = " OR ".join(f"ends_with({lu}, {lit(e)})" for e in rules.ARCHIVE_EXTENSIONS)
    parts = [f"WHEN {url} IS NULL OR NOT (starts_with({url}, 'http://') OR starts_with({url}, 'https://')) THEN FALSE",
             f"WHEN {exts} THEN FALSE"]
    if query:
        parts.append(f"WHEN contains({lu}, {lit(query.lower())}) THEN TRUE")
    parts += [f"WHEN {contains_any_hof(netloc(url), rules.FOLLOW_PRIORITY_DOMAINS)} THEN TRUE",
              f"WHEN {contains_any_hof(lu, rules.PROGRAMMING_PATHS)} THEN TRUE",
              f"WHEN {contains_any(lu, rules.IRRELEVANT_PATTERNS)} THEN FALSE"]
    return "(CASE " + " ".join(parts) + " ELSE TRUE END)"


def should_follow_narrow(url: str, allowed) -> str:
    u = f"coalesce({url}, '')"
    pattern = "(?i)(" + "|".join(rules.RELEVANT_URL_PATTERNS) + ")"
    return f"(regexp_matches({u}, {lit(pattern)}) AND {contains_any(netloc(u), allowed)})"


def count_occ(text: str, term: str) -> str:
    return f"CAST((length({text}) - length(replace({text}, {term}, ''))) / length({term}) AS BIGINT)"


def query_words(q: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({q}), {lit(WS_RUN)}), lambda x: x <> '')"
