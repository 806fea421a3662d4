"""Quality rules, collocations and ranked search against plain Python on small tables with nulls, empty, long, equal and repeated rows."""

import math
import random
import re
from collections import Counter

import pytest

from ferret.llm import line_quality, phrases, ranked_search

SCHEMA = "doc_id long, text string, lang string, id long, line string, n long, query long, block long, w1 string, score double"
R = random.Random(5)
COMMON = ["the", "of", "a", "Ünder", "x-1", "new", "york", "city"]


def sentence(n):
    return " ".join(R.choice(COMMON) if R.random() < 0.7 else f"w{R.randrange(40)}" for _ in range(n))


TEXTS = [
    (1, ". ".join(sentence(12) for _ in range(8)) + ".", "en"), (2, "Home | News | Sport | Cars | Jobs\nAbout | Help | Mail | Shop", "en"), (3, None, None), (4, "", "en"),
    (5, " \t\n\x0b ", "en"), (6, "new york city, new york city\nnew york; york new\r\nthe the the the the the", "en"), (7, "q " * 9000, "de"), (None, "null id the of a", None),
    (8, "a b c d e f g h i " * 4, "en"), (8, "a b c d e f g h i " * 4, "en"), (9, "One line that stays, with words enough to pass the base rule of twenty words, I should say, and more besides these.\n" * 2 + "Read more", "en"),
    (10, "## ** %% $$ && ||\n" * 3 + "A sentence that is clean and long enough to be judged by all the rules which there are in this file.", "en"),
    (11, "naïve café 北京 NAÏVE x y z\x01 z", "fr"), (12, "THE OF! A NEW? york:city; x-1", "en"), (13, "the of a new york city", "en"), (14, "the of a new york city", "en"),
    (15, "WOW!! SO!! BIG!! AND!! LOUD!! HERE!!", "en"), (16, "no mark at the end of this line of many words which goes on and on\nshort\nEnds well.", "en"),
] + [(100 + i, sentence(R.randrange(1, 60)), R.choice(["en", "en", "de", None])) for i in range(60)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, "l", 2, 3, 4, "w", 0.5) for i, t, g in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TEXTS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rule(line, seen):
    words = WORD.findall(line)
    n, chars = len(words), sum(map(len, words))
    symbols = sum(c in line_quality.SYMBOLS for c in line)
    parts = sum(w in line_quality.SEPARATORS for w in words)
    if not n:
        return None
    if parts >= 3 and parts * 8 >= n:
        return "navigation"
    if symbols * 10 >= chars or (n >= 5 and line.count("!") * 2 >= n) or (n >= 8 and not re.search(line_quality.ENDS, line)):
        return "punctuation"
    return "boilerplate" if line in seen or (n <= 25 and any(p in line.lower() for p in line_quality.PHRASES)) else None


def judge(i, text):
    t = text or ""
    words, lines, seen, removed, dup = WORD.findall(t), t.split("\n"), set(), [], 0
    for at, line in enumerate(lines):
        if r := rule(line, seen):
            removed.append((at, r))
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(words[s:s + 8]) for s in range(len(words) - 7))
    again = {p for s in range(len(words) - 7) if runs[tuple(words[s:s + 8])] > 1 for p in range(s, s + 8)}
    gone, cut = {a for a, _ in removed}, sum(len(lines[a]) for a, _ in removed)
    failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
    clean = "\n".join(x for a, x in enumerate(lines) if a not in gone)
    return (i, text, clean, tuple(removed), len(words), sum(map(len, words)), sum(c in line_quality.SYMBOLS for c in t), dup, len(again), failed,
            not failed and 100 * cut <= 50 * sum(map(len, lines)))


def test_line_quality_brute_force(docs, empty):
    got = line_quality.clean_lines(docs).collect()
    have = [(r.doc_id, r.text, r.clean_text, tuple(map(tuple, r.removed)), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got]
    assert sorted(have, key=repr) == sorted((judge(i, t) for i, t, _ in TEXTS), key=repr)
    found = {r for x in have for _, r in x[3]}
    assert found == set(line_quality.RULES)
    assert line_quality.clean_lines(empty).count() == 0


def test_line_quality_has_no_python_node(docs):
    plan = line_quality.clean_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def collocations(rows, least, top):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                f.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    often = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in often.items():
        if any(len(q) > len(p) and g == lang and b >= a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (g, q), b in often.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), left, right))
    out.sort()
    rank = Counter()
    result = []
    for lang, score, a, p, left, right in out:
        rank[lang] += 1
        if rank[lang] <= top:
            result.append((lang, rank[lang], p.decode(), -a, left, right, n[lang], -score))
    return result


@pytest.mark.parametrize("budget, bits", [(4_000_000, 1 << 20), (10, 64)])  # with 10 most prefixes are heavy; 64 bits let nearly every word through
def test_collocations_brute_force(docs, budget, bits):
    got = phrases.mine_collocations(docs, min_count=4, top=30, budget=budget, filter_bits=bits, chunk_words=300)
    assert sorted(map(tuple, got.collect())) == sorted(collocations(TEXTS, 4, 30))


def test_collocations_edges(spark, empty):
    assert phrases.mine_collocations(empty).count() == 0
    same = table(spark, [(1, "p q r. p q", "en")] * 150)
    assert sorted(map(tuple, phrases.mine_collocations(same).collect())) == sorted(collocations([(1, "p q r. p q", "en")] * 150, 100, 2000))
    none = table(spark, [(1, None, "en"), (2, "", None)])
    assert phrases.mine_collocations(none, min_count=1).count() == 0


def test_collocation_products_beyond_64_bits(spark):
    rows = [(i, "m n " * 400, "en") for i in range(40)]
    got = phrases.mine_collocations(table(spark, rows), min_count=100).collect()
    assert sorted(map(tuple, got)) == sorted(collocations(rows, 100, 2000))
    big = spark.sql("select cast(cast(1000 as decimal(4,0)) * (cast(9000000000000 as decimal(19,0)) * cast(8000000000000 as decimal(19,0))) as decimal(38,0))"
                    " div (cast(3000000000 as decimal(19,0)) * cast(70000000000 as decimal(19,0))) as x").first().x
    assert big == 1000 * 9000000000000 * 8000000000000 // (3000000000 * 70000000000)


def ranking(rows, queries, size):
    term = re.compile(rb"[0-9a-zA-Z\x80-\xff]+")
    held = [(i, Counter(term.findall((t or "").encode().lower()))) for i, t, _ in rows]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in queries:
        asked = Counter(term.findall((text or "").encode().lower()))
        scored = []
        for i, c in held:
            m = 25 + 75 * c.total() * n_docs // n_terms if c else 0
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, k in asked.items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:size])]
    return out


QUERIES = [(1, "new york city"), (2, "the the of w3 w3 w3"), (3, None), (4, "—!"), (5, "unheard"), (None, "café naïve 北京"), (1, "new york city"), (6, "a b c d e f g h i"), (7, "Q x 1 ünder W1 w2")]


@pytest.mark.parametrize("leaf, block", [(128, 1 << 20), (1, 1 << 20), (2, 200)])
def test_ranked_search_brute_force(spark, docs, leaf, block):
    asked = spark.createDataFrame([(i, t, 1) for i, t in QUERIES], "item_id long, text string, doc_id long")
    got = ranked_search.ranked_search(docs, asked, block_terms=block, leaf=leaf).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(ranking(TEXTS, QUERIES, 10), key=repr)


def test_ranked_search_in_parts_and_edges(spark, docs, empty):
    asked = spark.createDataFrame(QUERIES, "item_id long, text string")
    got = ranked_search.ranked_search(docs, asked, size=3, query_bytes=150).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(ranking(TEXTS, QUERIES, 3), key=repr)
    assert ranked_search.ranked_search(empty, asked).count() == 0
    assert ranked_search.ranked_search(docs, asked.limit(0)).count() == 0


def test_block_search_equals_scoring_everything():
    import numpy as np
    rng = np.random.default_rng(3)
    for _ in range(40):
        size, n_lists = int(rng.integers(1, 400)), int(rng.integers(1, 6))
        n_terms = rng.integers(1, 50, size)
        lists = {}
        for t in range(n_lists):
            place = np.sort(rng.choice(size, int(rng.integers(1, size + 1)), replace=False))
            lists[t] = (place, rng.integers(1, 3, len(place)))
        block = ranked_search.Block(list(range(size)), n_terms, lists, 1000, 30000, {t: len(p) for t, (p, _) in lists.items()})
        query = [(t, int(rng.integers(1, 3))) for t in range(n_lists)]
        score = np.zeros(size, np.int64)
        for t, k in query:
            lo, hi = block.ends[block.number[t]], block.ends[block.number[t] + 1]
            score[block.keys[lo:hi] - block.number[t] * size] += k * block.levels[0][lo:hi]
        want = [(int(score[i]), int(i)) for i in np.argsort(-score, kind="stable")[:10] if score[i] > 0]
        assert block.best(query, 10) == want
