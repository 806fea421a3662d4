"""The element tree of a page as Column expressions: tokens by one regular expression, open elements by a fold.

A page is cut into tokens (tags with their quoted attribute values, comments, whole script and style elements, texts).
``aggregate`` carries the stack of open elements over the tokens and notes for every text which element holds it. All fields
that depend on the tree are array functions over these texts and elements; nothing leaves the JVM.

The tree is kept as far as the rules read it: an end tag closes the nearest open element of its name, void elements
and ``<x/>`` hold nothing, a block's start tag closes an open ``<p>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from .text import bind_once, col_, html_unescape

# FIXED VALUES: elements without an end tag, and start tags that end a paragraph (HTML's rules).
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
CLOSES_P = ["address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main",
            "nav", "ol", "p", "pre", "section", "table", "ul", "li", "dd", "dt"]

#: So many quoted values of a tag may hold ">". Java's matcher takes stack for every repetition of a group, so it has a bound.
QUOTED_VALUES = 100
QUOTED = rf"[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*){{0,{QUOTED_VALUES}}}"
#: A tag with more of them, or with a quote that nothing closes, ends at the first ">".
TAG = rf"</?[a-z]{QUOTED}>|</?[a-z][^>]*>"
TOKEN = rf"(?is)<!--.*?(?:-->|\z)|<script(?:[\s/][^>]*)?>.*?(?:</script\s*>|\z)|<style(?:[\s/][^>]*)?>.*?(?:</style\s*>|\z)|<[!?][^>]*>|{TAG}|[^<]+|<"
SKIPPED = r"(?i)^<(?:[!?]|(?:script|style)[\s/>])"
NAME = r"^</?([a-zA-Z][^\s/>]*)"
#: In a tag: its name, then attribute by attribute, so a value is never searched for another attribute.
ATTRIBUTE = r"[^\s\"'<>/=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?"
#: Tokens that one inner fold takes; its results are gathered block by block, so appending does not grow with the page.
BLOCK = 256

NODES = "array<struct<at:int,parent:int,in_pre:boolean>>"


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name, else NULL."""
    def value(found):
        first = F.try_element_at(F.filter(found, lambda a: a.rlike(rf"(?i)^{name}\s*=")), F.lit(1))
        raw = F.regexp_extract(first, r"(?s)=\s*(.*)$", 1)
        return F.when(raw.rlike("^[\"']"), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    return F.when(tag.rlike(rf"(?i)[\s\"'/]{name}\s*="), html_unescape(value(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)))))


def tokens(html) -> Column:
    """array<struct(at, kind, tag, raw)>: kind is open, void (holds nothing), close or text."""
    def token(x, i):
        name = F.lower(F.regexp_extract(x, NAME, 1))
        kind = F.when(name == "", "text").when(x.startswith("</"), "close").when(name.isin(*VOID) | x.endswith("/>"), "void").otherwise("open")
        return bind_once(F.struct(i.alias("at"), name.alias("tag"), kind.alias("kind"), x.alias("raw")), lambda t: t)
    raw = F.regexp_extract_all(F.coalesce(col_(html), F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.transform(F.filter(raw, lambda x: ~x.rlike(SKIPPED)), token)


def text_nodes(toks: Column) -> Column:
    """array<struct(at, parent, in_pre)>: for every text inside an element, its token, the token of the element that
    holds it, and whether an outer element is a <pre>."""
    none = F.array().cast(NODES)

    def state(tags, ids, out):
        return F.struct(tags.alias("tags"), ids.alias("ids"), out.alias("out"))

    def cut(s, n):  # without the n innermost elements
        return F.slice(s["tags"], n + 1, F.size(s["tags"])), F.slice(s["ids"], n + 1, F.size(s["ids"]))

    def step(s, t):
        at = F.struct(t["at"].alias("at"), F.get(s["ids"], 0).alias("parent"), F.array_contains(F.slice(s["tags"], 2, F.size(s["tags"])), "pre").alias("in_pre"))
        text = F.when(F.size(s["tags"]) == 0, s).otherwise(state(s["tags"], s["ids"], F.concat(s["out"], F.array(at))))
        closed = state(*cut(s, F.array_position(s["tags"], t["tag"]).cast("int")), s["out"])
        ended = F.when(t["tag"].isin(*CLOSES_P) & F.array_contains(s["tags"], "p"), state(*cut(s, F.array_position(s["tags"], "p").cast("int")), s["out"])).otherwise(s)
        opened = bind_once(ended, lambda e: state(F.concat(F.array(t["tag"]), e["tags"]), F.concat(F.array(t["at"]), e["ids"]), e["out"]))
        return F.when(t["kind"] == "text", text).when(t["kind"] == "open", opened).when(t["kind"] == "void", ended).otherwise(closed)

    def block(s, part):
        inner = F.aggregate(part, state(s["tags"], s["ids"], none), step)
        return bind_once(inner, lambda r: F.struct(r["tags"].alias("tags"), r["ids"].alias("ids"), F.concat(s["outs"], F.array(r["out"])).alias("outs")))

    def folded(all_):
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda k: F.slice(all_, k * BLOCK + 1, BLOCK))
        zero = F.struct(F.array().cast("array<string>").alias("tags"), F.array().cast("array<int>").alias("ids"), F.array().cast(f"array<{NODES}>").alias("outs"))
        return F.aggregate(parts, zero, block, lambda s: F.flatten(s["outs"]))

    return bind_once(toks, lambda x: F.when(F.size(x) == 0, none).otherwise(folded(x)))


def signal_name(kind: str, value) -> str:
    return f"{kind}:{value[0]}:{value[1]}" if isinstance(value, tuple) else f"{kind}:{value}"


def selector_key(sel: str) -> str:
    """The key of an element that a selector (.class, #id or tag) names."""
    return f"class:{sel[1:]}" if sel.startswith(".") else f"id:{sel[1:]}" if sel.startswith("#") else f"tag:{sel}"


def _keys(tag: Column, raw: Column) -> Column:
    """What rules name an element by: its tag, every class, its id."""
    classes = F.array_remove(F.split(F.coalesce(attribute(raw, "class"), F.lit("")), r"\s+", -1), "")
    return F.array_compact(F.concat(F.array(F.concat(F.lit("tag:"), tag)), F.transform(classes, lambda c: F.concat(F.lit("class:"), c)),
                                    F.array(F.concat(F.lit("id:"), attribute(raw, "id")))))


def _content(texts: Column, selectors) -> Column:
    """The texts of the first selector that has any, joined; texts: struct(keys, text)."""
    def of(key):
        hits = F.filter(texts, lambda x: F.array_contains(x["keys"], key))
        return bind_once(hits, lambda f: F.when(F.size(f) > 0, F.array_join(F.transform(f, lambda x: x["text"]), " ")))
    return F.coalesce(*[of(selector_key(s)) for s in selectors])


def _signals(df: DataFrame, lists) -> Column:
    def literal(kind):
        found = dict.fromkeys(v for k, v in lists if k == kind)
        return F.array(*[F.struct(F.lit(signal_name(kind, v)).alias("name"), F.lit(v[0]).alias("tag"), F.lit(v[1]).alias("part")) for v in found]) if found else None

    def held_by(wanted, column, test):
        return F.filter(wanted, lambda r: F.exists(column, lambda x: (x["tag"] == r["tag"]) & test(x, r)))

    names = list(dict.fromkeys(signal_name(k, v) for k, v in lists))
    found = [F.flatten(F.transform("elements", lambda x: x["keys"]))]
    for kind, column, test in (("heading", "heads", lambda x, r: F.lower(x["text"]).contains(r["part"])), ("heading_cs", "heads", lambda x, r: x["text"].contains(r["part"])),
                               ("class_has", "elements", lambda x, r: F.coalesce(x["class"].contains(r["part"]), F.lit(False)))):
        if (wanted := literal(kind)) is not None:
            found.append(F.transform(held_by(wanted, column, test), lambda r: r["name"]))
    return F.array_intersect(F.array(*[F.lit(n) for n in names]), F.concat(*found))


def page_fields(pages: DataFrame, selectors_broad=None, selectors_narrow=None, signal_lists=None) -> DataFrame:
    """``pages`` (page_id, url, html) with p_texts, content_broad, content_narrow, signals, h1_texts, h2_texts, pre_code and pre_texts."""
    lists = signal_lists if signal_lists is not None else rules.STRUCTURE_SIGNALS_BROAD + rules.STRUCTURE_SIGNALS_NARROW
    df = pages.withColumn("toks", tokens("html"))
    df = df.withColumn("nodes", text_nodes(F.col("toks")))
    element = lambda t: F.struct(t["at"].alias("at"), t["tag"].alias("tag"), _keys(t["tag"], t["raw"]).alias("keys"), attribute(t["raw"], "class").alias("class"))
    df = df.withColumn("elements", F.transform(F.filter("toks", lambda t: t["kind"].isin("open", "void")), element))
    # Elements by the place of their token: an array as long as the tokens, so a text finds its element at once.
    held = bind_once(F.struct(F.col("toks").alias("t"), F.col("nodes").alias("n")), lambda s: F.transform(s["n"], lambda x: bind_once(
        F.get(s["t"], x["parent"]), lambda p: F.struct(x["parent"].alias("parent"), x["in_pre"].alias("in_pre"), p["tag"].alias("tag"), p["raw"].alias("raw"),
                                                       html_unescape(F.get(s["t"], x["at"])["raw"]).alias("text")))))
    df = df.withColumn("held", held)
    of = lambda tag: F.transform(F.filter("held", lambda x: x["tag"] == tag), lambda x: x["text"])
    titled = F.filter("held", lambda x: x["tag"].isin("h1", "h2"))
    heads = bind_once(titled, lambda h: F.filter(h, lambda x, i: ~F.exists(F.slice(h, 1, i), lambda y: y["parent"] == x["parent"])))
    df = df.withColumn("heads", heads).withColumn("keyed", F.transform("held", lambda x: F.struct(_keys(x["tag"], x["raw"]).alias("keys"), x["text"].alias("text"))))
    code = F.filter("held", lambda x: (x["tag"] == "code") & x["in_pre"])
    return df.select(*pages.columns, of("p").alias("p_texts"), _content(F.col("keyed"), selectors_broad or rules.CONTENT_SELECTORS_BROAD).alias("content_broad"),
                     _content(F.col("keyed"), selectors_narrow or rules.CONTENT_SELECTORS_NARROW).alias("content_narrow"), _signals(df, lists).alias("signals"),
                     of("h1").alias("h1_texts"), of("h2").alias("h2_texts"), F.transform(code, lambda x: x["text"]).alias("pre_code"), of("pre").alias("pre_texts"))


def hrefs(html) -> Column:
    """Every ``a::attr(href)`` value in document order, outside comments, scripts and styles."""
    links = F.filter(tokens(html), lambda t: (t["tag"] == "a") & (t["kind"] != "close"))
    return F.filter(F.transform(links, lambda t: attribute(t["raw"], "href")), lambda v: v != "")
