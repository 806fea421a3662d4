"""The operators as registered queries: name -> (builder, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import decontaminate, exact_dedup, line_dedup, line_quality, minhash, packing, phrases, ranked_search, secret_scan, sharding, token_counts, toxicity, url_filter

QUERIES: dict = {}
SQL: dict = {}

SHARDS = 40


def query(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


@query("op1_packing")
def op1_packing(spark, sf_dir):
    return packing.pieces_digest(packing.pack_documents(read_table(spark, sf_dir, "documents")))


@query("op2_sharding")
def op2_sharding(spark, sf_dir):
    placed = sharding.assign_shards(read_table(spark, sf_dir, "documents"), [1.0] * SHARDS)
    return placed.withColumn("law", F.lit("key"))


@query("op3_exact_dedup", r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)""")
def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.mark_duplicates(read_table(spark, sf_dir, "documents"))


@query("op6_token_counts")
def op6_token_counts(spark, sf_dir):
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"))


@query("op5_minhash")
def op5_minhash(spark, sf_dir):
    return minhash.mark_near_duplicates(read_table(spark, sf_dir, "documents"), percent=85).drop("th")


@query("op4_toxicity")
def op4_toxicity(spark, sf_dir):
    return toxicity.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op10_decontamination")
def op10_decontamination(spark, sf_dir):
    found = decontaminate.find_contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.drop("th")


#: Captures and dated lists that both derive from the pages table: a capture's fetch time follows its id,
#: and every host and site gets entries at times that follow its first page.
ENTRIES_SQL = """
  SELECT {list} AS list, target, 'add' AS action, first + 60 * (length(target) % 7) AS moment FROM t
  UNION ALL SELECT {list}, target, 'remove', first + 60 * (length(target) % 7) + 600 * (1 + n % 11) FROM t
  UNION ALL SELECT {list}, target, 'add', first + 60 * (length(target) % 7) + 600 * (2 + n % 13) FROM t WHERE n % 2 = 0
"""
LIST_SQL = "CASE length(target) % 3 WHEN 0 THEN 'adult' WHEN 1 THEN 'malware' ELSE 'spam' END"


@query("op7_url_filter", r"""
WITH p AS (
  SELECT page_id, page_id * 60 AS fetched,
         lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\.$', '')) AS host
  FROM pages),
d AS (SELECT *, string_split(host, '.') AS labels FROM p),
w AS (
  SELECT DISTINCT page_id, fetched, host, array_to_string(labels[i:len(labels)], '.') AS target
  FROM (SELECT *, unnest(range(1, greatest(len(labels) - 1, 1) + 1)) AS i FROM d WHERE host <> '')),
t AS (SELECT target, min(fetched) AS first, count(*) AS n FROM w GROUP BY target),
e AS (""" + ENTRIES_SQL.format(list=LIST_SQL) + r"""),
o AS (SELECT list, target, moment, bool_and(action = 'add') AS is_on FROM e GROUP BY list, target, moment),
c AS (SELECT * FROM (SELECT *, coalesce(lag(is_on) OVER (PARTITION BY list, target ORDER BY moment), false) AS was FROM o) WHERE is_on <> was),
v AS (SELECT list, target, moment AS since, is_on, lead(moment) OVER (PARTITION BY list, target ORDER BY moment) AS until FROM c),
h AS (
  SELECT page_id, array_to_string(list_sort(list_distinct(list(v.list))), ',') AS lists, count(*) AS n_entries
  FROM w JOIN v ON w.target = v.target AND v.is_on AND v.since <= fetched AND (until IS NULL OR fetched < until)
  GROUP BY page_id)
SELECT p.page_id, p.fetched, p.host, coalesce(h.lists, '') AS lists, coalesce(h.n_entries, 0) AS n_entries, h.page_id IS NOT NULL AS blocked
FROM p LEFT JOIN h ON p.page_id = h.page_id""")
def op7_url_filter(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", (F.col("page_id") * 60).alias("fetched"))
    hosts = pages.select("fetched", F.explode(url_filter.domains(url_filter.host(F.col("url")))).alias("target"))
    t = hosts.groupBy("target").agg(F.min("fetched").alias("first"), F.count(F.lit(1)).alias("n"))
    start, kind = F.expr("first + 60 * (length(target) % 7)"), F.expr(LIST_SQL).alias("list")
    entries = t.select(kind, "target", F.lit("add").alias("action"), start.alias("at")) \
        .unionByName(t.select(kind, "target", F.lit("remove").alias("action"), (start + F.expr("600 * (1 + n % 11)")).alias("at"))) \
        .unionByName(t.where("n % 2 = 0").select(kind, "target", F.lit("add").alias("action"), (start + F.expr("600 * (2 + n % 13)")).alias("at")))
    return url_filter.filter_captures(pages, entries)


@query("op8_secret_scan")
def op8_secret_scan(spark, sf_dir):
    return secret_scan.scan_secrets(read_table(spark, sf_dir, "documents"))


@query("op9_line_dedup", r"""
WITH l AS (
  SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS raw, len(parts) AS n_lines
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
c AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS s, line
  FROM (SELECT doc_id, pos, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM l) WHERE line <> ''),
w AS (
  SELECT doc_id, s, pos AS lo, lead(pos, 2) OVER d AS hi, line || chr(10) || lead(line, 1) OVER d || chr(10) || lead(line, 2) OVER d AS words
  FROM c WINDOW d AS (PARTITION BY doc_id ORDER BY s)),
r AS (SELECT *, row_number() OVER (PARTITION BY words ORDER BY doc_id, s) AS k FROM w WHERE words IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS pos FROM r WHERE k > 1)
SELECT l.doc_id, any_value(l.n_lines) AS n_lines, count(g.pos) AS n_removed,
       sha256(coalesce(string_agg(l.raw, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id""")
def op9_line_dedup(spark, sf_dir):
    marked = line_dedup.mark_repeated_lines(read_table(spark, sf_dir, "documents"))
    return marked.select("doc_id", F.col("n_lines").cast("bigint").alias("n_lines"), F.size("removed").cast("bigint").alias("n_removed"),
                         F.sha2("kept_text", 256).alias("kept_sha256"))


def _any(marks):
    return ", ".join("'" + m + "'" for m in marks)


@query("op11_quality_rules", rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
l AS (
  SELECT rid, unnest(range(len(parts))) AS pos, unnest(parts) AS line FROM (SELECT rid, string_split(t, chr(10)) AS parts FROM d)),
w AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws, regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g') AS dense FROM l),
j AS (
  SELECT *, len(ws) AS n, row_number() OVER (PARTITION BY rid, line ORDER BY pos) > 1 AS again,
         length(dense) - length(translate(dense, '{line_quality.SYMBOLS}', '')) AS symbols, length(line) - length(replace(line, '!', '')) AS shouts,
         len(list_filter(ws, lambda x: x IN ({_any(line_quality.SEPARATORS)}))) AS seps
  FROM w),
v AS (
  SELECT rid, sum(length(line)) AS total, count(*) FILTER (WHERE again AND n > 0) AS n_dup_lines,
         coalesce(sum(length(line)) FILTER (WHERE n > 0 AND (
           (seps >= {line_quality.MENU_LEAST} AND seps * {line_quality.MENU_SHARE} >= n)
           OR symbols * {line_quality.SYMBOL_SHARE} >= length(dense) OR (n >= 5 AND shouts * {line_quality.SHOUT_SHARE} >= n)
           OR (n >= {line_quality.MARK_WORDS} AND NOT regexp_matches(line, '{line_quality.ENDS}'))
           OR (n <= {line_quality.PHRASE_WORDS} AND regexp_matches(lower(line), '{"|".join(line_quality.PHRASES)}')) OR again)), 0) AS cut
  FROM j GROUP BY rid),
k AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
x AS (SELECT rid, unnest(range(1, len(ws) - 6)) AS s, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS run FROM k WHERE len(ws) >= 8),
r AS (SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY rid, run) AS c FROM x) WHERE c > 1),
g AS (SELECT rid, sum(least(8, coalesce(after - s, 8))) AS n FROM (SELECT rid, s, lead(s) OVER (PARTITION BY rid ORDER BY s) AS after FROM r) GROUP BY rid),
o AS (
  SELECT d.doc_id, len(k.ws) AS n_words, length(regexp_replace(d.t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(d.t) - length(translate(d.t, '{line_quality.SYMBOLS}', '')) AS n_symbols, v.n_dup_lines, coalesce(g.n, 0)::BIGINT AS n_repeat_words, v.cut, v.total
  FROM d JOIN k USING (rid) JOIN v USING (rid) LEFT JOIN g USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * cut <= {line_quality.MOST_LOST} * total AS kept
FROM o""")
def op11_quality_rules(spark, sf_dir):
    judged = line_quality.clean_lines(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op12_collocations", r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(pieces) AS piece FROM p)),
s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
c AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS n
  FROM s, (SELECT unnest(range(1, 6)) AS k) AS z WHERE i + k - 1 <= len(ws) GROUP BY ALL),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM c WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS ws FROM c WHERE k >= 2 AND n >= 100),
inside AS (
  SELECT lang, array_to_string(ws[1:k - 1], ' ') AS phrase, a FROM f WHERE k >= 3
  UNION SELECT lang, array_to_string(ws[2:k], ' '), a FROM f WHERE k >= 3),
b AS (SELECT f.*, unnest(range(1, k)) AS j FROM f ANTI JOIN inside USING (lang, phrase, a)),
e AS (
  SELECT b.lang, b.phrase, b.a, j, l.n AS l, r.n AS r, t.n, ((1000::HUGEINT * b.a * t.n) // (l.n::HUGEINT * r.n))::BIGINT AS score
  FROM b JOIN t ON b.lang = t.lang
  JOIN c l ON l.lang = b.lang AND l.phrase = array_to_string(ws[1:j], ' ') AND l.k = j
  JOIN c r ON r.lang = b.lang AND r.phrase = array_to_string(ws[j + 1:b.k], ' ') AND r.k = b.k - j),
m AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM m QUALIFY rank <= 2000""")
def op12_collocations(spark, sf_dir):
    return phrases.mine_collocations(read_table(spark, sf_dir, "documents"))


@query("op13_ranked_search", r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
b AS (
  SELECT row_number() OVER () AS qid, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS ws FROM benchmark),
q AS (SELECT qid, item_id, term, count(*) AS times FROM (SELECT qid, item_id, unnest(ws) AS term FROM b) GROUP BY ALL),
s AS (SELECT count(*) AS docs, sum(len(ws))::BIGINT AS terms FROM d WHERE len(ws) > 0),
p AS (
  SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(ws) AS n, unnest(ws) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
i AS (SELECT rid, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))) AS impact FROM p JOIN f USING (term), s),
h AS (SELECT qid, item_id, rid, doc_id, sum(times * impact)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, rid)::INT AS rank, doc_id, score
FROM h WHERE score > 0 QUALIFY rank <= 10""")
def op13_ranked_search(spark, sf_dir):
    return ranked_search.ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
