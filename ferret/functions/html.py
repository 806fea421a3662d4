"""Native (regex) HTML field extraction.

These cover fields that a single tag or attribute determines; tree-dependent
fields go through ``functions.walk``. Patterns stay in the Java/RE2 common subset, and loop
over single characters only, so a broken page cannot exhaust the matcher's stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind_once, col_, html_unescape, nullif_empty


def open_tag(tag: str) -> str:
    return rf"<{tag}(?:\s[^>]*)?>"


def first_text_of(tag: str) -> str:
    """Pattern whose group 1 is the first text run of the first <tag>."""
    return rf"(?i){open_tag(tag)}([^<]*)"


def first_tag_text(html, tag: str) -> Column:
    """``tag::text`` first value, for tags that hold text only; NULL when it is empty."""
    return nullif_empty(html_unescape(F.regexp_extract(col_(html), first_text_of(tag), 1)))


#: Children of a heading become MARK, innermost first; what is left is its own text.
MARK = "\x01"
VOID_PATTERN = r"(?is)<!--.*?-->|<(?:br|hr|img|input|wbr)(?:[\s/][^>]*)?>"
CHILD_PATTERN = r"<[a-zA-Z][^>]*>[^<]*</[a-zA-Z0-9]+\s*>"
NESTING = 3
OWN_TEXT_SPLIT = r"(?:<[^>]*>|\x01)+"


def element_pattern(tag: str) -> str:
    """Pattern whose group 1 is the inside of an element that cannot hold itself."""
    return rf"(?is){open_tag(tag)}(.*?)(?:</{tag}\s*>|\z)"


def own_text(html, tag: str) -> Column:
    """``tag::text`` first value: the first text that is a direct child of such an element
    (children nested up to NESTING deep are skipped); NULL when there is none."""
    def texts(inner):
        left = F.regexp_replace(inner, VOID_PATTERN, MARK)
        for _ in range(NESTING):
            left = F.regexp_replace(left, CHILD_PATTERN, MARK)
        return F.array_remove(F.split(left, OWN_TEXT_SPLIT), "")
    found = F.regexp_extract_all(col_(html), F.lit(element_pattern(tag)), 1)
    return html_unescape(F.try_element_at(F.flatten(F.transform(found, texts)), F.lit(1)))


VALUE = r"(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"


def attribute_pattern(name: str) -> str:
    """Pattern whose group 1 is the value of the attribute in an open tag, with its quotes."""
    return rf"(?i)\s{name}\s*=\s*{VALUE}"


def unquoted(value: Column) -> Column:
    return F.when(value.rlike("^[\"']"), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def meta_tag_pattern(name: str) -> str:
    return rf"(?i)<meta\s(?:[^>]*\s)?name\s*=\s*(?:\"{name}\"|'{name}'|{name}\b)[^>]*>"


CONTENT_ATTR = attribute_pattern("content")


def meta_content(html, name: str) -> Column:
    """``meta[name=<name>]::attr(content)`` of the first such tag, else NULL."""
    tag = F.regexp_extract(col_(html), meta_tag_pattern(name), 0)
    return bind_once(F.regexp_extract(tag, CONTENT_ATTR, 1),
                     lambda v: F.when(v != "", html_unescape(unquoted(v))))


PRE_CODE_PATTERN = r"(?i)<pre(?:\s[^>]*)?>\s*<code(?:\s[^>]*)?>([^<]*)"
PRE_PATTERN = r"(?i)<pre(?:\s[^>]*)?>([^<]+)"
COMMENT_PATTERN = r"(?s)<!--.*?-->"
LINK_TAG_PATTERN = r"(?i)<a\s[^>]*>"
HREF_ATTR = attribute_pattern("href")
HAS_BODY_PATTERN = r"(?i)<body[\s>]"
BODY_PATTERN = r"(?is)<body(?:\s[^>]*)?>(.*)$"
HEAD_PATTERN = r"(?is)^.*</head\s*>"
TITLE_PATTERN = r"(?is)<title(?:\s[^>]*)?>.*?</title\s*>"
TAG_RUN_PATTERN = r"(?s)(?:<!--.*?-->|<[^>]*>)+"


def pre_code_texts(html) -> Column:
    """``pre code::text`` for simple ``<pre><code>text</code></pre>`` blocks."""
    return F.transform(F.regexp_extract_all(col_(html), F.lit(PRE_CODE_PATTERN), 1),
                       html_unescape)


def pre_texts(html) -> Column:
    return F.transform(F.regexp_extract_all(col_(html), F.lit(PRE_PATTERN), 1), html_unescape)


def hrefs(html) -> Column:
    """Every ``a::attr(href)`` value in document order: in double, single or no quotes,
    outside comments."""
    tags = F.regexp_extract_all(F.regexp_replace(col_(html), COMMENT_PATTERN, ""), F.lit(LINK_TAG_PATTERN), 0)
    values = F.transform(tags, lambda t: F.regexp_extract(t, HREF_ATTR, 1))
    return F.transform(F.filter(values, lambda v: v != ""), lambda v: html_unescape(unquoted(v)))


def body_text(html) -> Column:
    """``' '.join(body ::text)`` lower-cased: text nodes below <body>, script text included. A
    page without that tag has everything after its head as its body."""
    page = col_(html)
    rest = F.regexp_replace(F.regexp_replace(page, HEAD_PATTERN, ""), TITLE_PATTERN, "")
    body = F.when(page.rlike(HAS_BODY_PATTERN), F.regexp_extract(page, BODY_PATTERN, 1)).otherwise(rest)
    pieces = F.array_remove(F.split(body, TAG_RUN_PATTERN), "")
    return F.lower(html_unescape(F.array_join(pieces, " ")))
