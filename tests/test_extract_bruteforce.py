"""B13 (no SQL oracle) against a plain-Python rendering of the crawler rules on the widened
sf0.001 pages. Native fields use Python's own string semantics (str.split, `in`,
str.count); tree fields come from the same walk helper."""

import html as htmllib
import re
from html.parser import HTMLParser
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from ferret import rules
from tests.html_walk import signal_name, walk_one
from ferret.operators import extract as X
from ferret.sources.adapters import widen_pages
from ferret.sources.tables import read_table
from tests.conftest import SF001


def first_text(h, tag):
    m = re.search(rf"(?i)<{tag}(?:\s[^>]*)?>([^<]*)", h)
    v = htmllib.unescape(m.group(1)) if m else ""
    return v or None


class Metas(HTMLParser):
    """The attributes of every meta element."""

    def __init__(self, h):
        super().__init__()
        self.found = []
        self.feed(h)

    def handle_starttag(self, tag, attrs):
        if tag == "meta":
            self.found.append(dict(attrs))


def meta(h, name):
    return next((m.get("content") for m in Metas(h).found if m.get("name") == name), None)


def body_text(h):
    m = re.search(r"(?is)<body(?:\s[^>]*)?>(.*)$", h)
    b = m.group(1) if m else ""
    pieces = [p for p in re.split(r"(?s)(?:<!--.*?-->|<[^>]*>)+", b) if p]
    return htmllib.unescape(" ".join(pieces)).lower()


def py_extract(url, h, query=None, mode="broad"):
    w = walk_one(h)
    title_only = first_text(h, "title")
    title = title_only or first_text(h, "h1")
    md = meta(h, "description")
    desc = md if md else " ".join(w["p_texts"][:3])
    tags = meta(h, "keywords")
    body = body_text(h)
    domain = urlparse(url).netloc
    q = query.lower() if query else None
    if mode == "broad":
        names = {signal_name(k, v) for k, v in rules.STRUCTURE_SIGNALS_BROAD}
        ok = bool(names & set(w["signals"]))
        ok |= any(p in url.lower() for p in rules.VALUABLE_URL_PATTERNS)
        ok |= any(k in (tags or "").lower() for k in rules.TECH_KEYWORDS) or \
            any(k in (md or "").lower() for k in rules.TECH_KEYWORDS)
        if q:
            ok |= q in (title_only or "").lower() or q in " ".join(w["h1_texts"]).lower() or \
                q in " ".join(w["h2_texts"]).lower()
            if q in rules.LEGACY_DENSE_QUERIES and body.count(q) >= 2:
                ok = True
            if q in rules.LEGACY_VOCABULARY and sum(t in body for t in rules.LEGACY_VOCABULARY[q]) >= 3:
                ok = True
    else:
        names = {signal_name(k, v) for k, v in rules.STRUCTURE_SIGNALS_NARROW}
        ok = any(k in (title_only or "").lower() for k in rules.PROGRAMMING_TITLE_KEYWORDS) or \
            bool(names & set(w["signals"]))
    if not ok or not title or not desc:
        return None
    title, desc = " ".join(title.split()), " ".join(desc.split())
    head = (title + " " + desc).lower()
    if mode == "broad":
        langs = [l for l in rules.LANGUAGES_BROAD if l in head] or \
            [l for l in rules.LANGUAGES_BROAD if l in body]
        if q:
            if q in rules.LEGACY_FIRST_QUERIES:
                langs = [q] + [l for l in langs if l != q]
            if q not in langs:
                langs.append(q)
            if q not in head and q not in body:
                return None
        content, snippets = w["content_broad"], list(w["pre_code"])
        if not snippets and q in rules.LEGACY_PRE_QUERIES:
            snippets = [p for p in w["pre_texts"] if q in p.lower()]
    else:
        langs = [l for l in rules.LANGUAGES_NARROW if l in head]
        if q and q not in head:
            return None
        content, snippets = w["content_narrow"], list(w["pre_code"])
    t = title.lower()
    if "tutorial" in t or "guide" in t:
        rtype = "tutorial"
    elif "video" in t or "youtube" in domain:
        rtype = "video"
    elif "documentation" in t or "docs" in domain:
        rtype = "documentation"
    elif mode == "broad" and ("reference" in t or "manual" in t):
        rtype = "documentation"
    elif "/github.com/" in url:
        rtype = "repository"
    elif any(d in url for d in ["docs", "documentation", "reference"]):
        rtype = "documentation"
    elif any(d in url for d in ["tutorial", "guide", "how-to"]):
        rtype = "tutorial"
    else:
        rtype = "article"
    if mode == "broad":
        qs = 0.5 + (0.2 if any(p in domain for p in rules.QUALITY_PRIORITY_DOMAINS) else 0)
        if q in rules.QUERY_PRIORITY_DOMAINS and any(p in domain for p in rules.QUERY_PRIORITY_DOMAINS[q]):
            qs += 0.3
        if snippets:
            qs += min(0.2, len(snippets) * 0.05)
        if content:
            qs += 0.15 if len(content) > 5000 else (0.1 if len(content) > 2000 else 0)
        qs = min(1.0, qs)
    else:
        qs = ((1 if snippets else 0) + min(1.0, len(desc) / 500) + (1 if tags else 0) +
              (0.5 if any(d in url for d in rules.AUTHORITY_URL_PARTS) else 0)) / 4
    return dict(title=title, description=desc, content=content, code_snippets=snippets, tags=tags,
                domain=domain, type=rtype, languages=langs, quality_score=qs)


@pytest.mark.parametrize("query,mode", [("the", "broad"), ("cobol", "broad"), (None, "narrow")])
def test_extract_matches_python_rules(spark, query, mode):
    pages = widen_pages(read_table(spark, SF001, "pages"))
    rows = pages.select("page_id", "url", "html").collect()
    expect = {}
    for r in rows:
        e = py_extract(r.url, r.html, query, mode)
        if e is not None:
            expect[r.page_id] = e
    got = {r.doc_id: r for r in X.extract_resources(pages, query=query, mode=mode).collect()}
    assert set(got) == set(expect) and len(got) > 0
    for pid, e in expect.items():
        g = got[pid]
        for k, v in e.items():
            gv = getattr(g, k)
            if k == "quality_score":
                assert gv == pytest.approx(v, abs=1e-9), (pid, k)
            else:
                assert (list(gv) if isinstance(gv, list) else gv) == v, (pid, k, gv, v)
