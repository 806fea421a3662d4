"""A plain-Python walk over a page (stdlib ``html.parser``): what the native element tree is held against."""

from __future__ import annotations

from html.parser import HTMLParser

from ferret import rules

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
        "param", "source", "track", "wbr"}
# Start tags that close an open <p> (HTML's implied end tag).
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset",
            "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr",
            "main", "nav", "ol", "p", "pre", "section", "table", "ul", "li", "dd", "dt"}
RAW_TEXT = {"script", "style"}

def _selector_key(sel: str) -> tuple[str, str]:
    if sel.startswith("."):
        return ("class", sel[1:])
    if sel.startswith("#"):
        return ("id", sel[1:])
    return ("tag", sel)


def signal_name(kind: str, value) -> str:
    if isinstance(value, tuple):
        return f"{kind}:{value[0]}:{value[1]}"
    return f"{kind}:{value}"


class _Node:
    __slots__ = ("tag", "classes", "class_attr", "id", "texts")

    def __init__(self, tag, attrs):
        self.tag = tag
        d = {k: (v or "") for k, v in attrs}
        self.class_attr = d.get("class", "")
        self.classes = set(self.class_attr.split())
        self.id = d.get("id")
        self.texts: list[str] = []


class _Walker(HTMLParser):
    """Builds only what the rules read: per element, its direct text nodes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[_Node] = []
        self.elements: list[_Node] = []     # document order of start tags
        self.text_events: list[tuple[_Node, str]] = []
        self.pre_code: list[str] = []
        self.pre_texts: list[str] = []

    def _end_paragraph(self, tag):
        if tag in CLOSES_P and any(n.tag == "p" for n in self.stack):
            while self.stack:
                if self.stack.pop().tag == "p":
                    break

    def handle_starttag(self, tag, attrs):
        self._end_paragraph(tag)
        node = _Node(tag, attrs)
        self.elements.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self._end_paragraph(tag)
        self.elements.append(_Node(tag, attrs))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        if self.stack and data:
            node = self.stack[-1]
            node.texts.append(data)
            self.text_events.append((node, data))
            if node.tag == "code" and any(n.tag == "pre" for n in self.stack[:-1]):
                self.pre_code.append(data)
            elif node.tag == "pre":
                self.pre_texts.append(data)


def _matches(node: _Node, key: tuple[str, str]) -> bool:
    kind, val = key
    if kind == "tag":
        return node.tag == val
    if kind == "class":
        return val in node.classes
    return node.id == val


def _content(events, selectors) -> str | None:
    for sel in selectors:
        key = _selector_key(sel)
        texts = [t for n, t in events if _matches(n, key)]
        if texts:
            return " ".join(texts)
    return None


def _signals(walker: _Walker, signal_lists) -> list[str]:
    out = []
    for kind, value in signal_lists:
        hit = False
        for node in walker.elements:
            if kind == "tag":
                hit = node.tag == value
            elif kind == "class":
                hit = value in node.classes
            elif kind == "id":
                hit = node.id == value
            elif kind == "heading":
                hit = node.tag == value[0] and bool(node.texts) and value[1] in node.texts[0].lower()
            elif kind == "heading_cs":
                hit = node.tag == value[0] and bool(node.texts) and value[1] in node.texts[0]
            elif kind == "class_has":
                hit = node.tag == value[0] and value[1] in node.class_attr
            if hit:
                break
        if hit and signal_name(kind, value) not in out:
            out.append(signal_name(kind, value))
    return out


def walk_one(html: str | None, selectors_broad=None, selectors_narrow=None,
             signal_lists=None) -> dict:
    w = _Walker()
    if html:
        w.feed(html)
        w.close()
    ev = [(n, t) for n, t in w.text_events if n.tag not in RAW_TEXT]
    sig = signal_lists if signal_lists is not None else (
        rules.STRUCTURE_SIGNALS_BROAD + rules.STRUCTURE_SIGNALS_NARROW)
    return {
        "p_texts": [t for n, t in ev if n.tag == "p"],
        "content_broad": _content(ev, selectors_broad or rules.CONTENT_SELECTORS_BROAD),
        "content_narrow": _content(ev, selectors_narrow or rules.CONTENT_SELECTORS_NARROW),
        "signals": _signals(w, sig),
        "h1_texts": [t for n, t in ev if n.tag == "h1"],
        "h2_texts": [t for n, t in ev if n.tag == "h2"],
        "pre_code": w.pre_code,
        "pre_texts": w.pre_texts,
    }
