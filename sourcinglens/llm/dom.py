"""A small HTML reader: pages to element trees with the text in page order.

Tolerant the way browsers are where it matters for text: void elements, raw
text elements, elements whose tags may be left out, stray end tags, quoted
and unquoted attributes, and pages cut off in the middle.  A quote that never
closes ends its tag at the next ``>``.  Reading takes time linear in the page.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections import defaultdict

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
#: Never part of a text, whatever the model says.
HIDDEN = set("head script style noscript template iframe object svg math canvas audio video button select option "
             "textarea input label datalist dialog title".split())
#: What may stand in a head; anything else ends it.
IN_HEAD = set("base basefont bgsound head link meta noframes noscript object script style template title".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span "
             "strike strong sub sup time tt u var wbr nobr".split())
#: Start tag -> open elements that it ends, up to the nearest of SCOPE.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "thead": {"tbody", "tr", "td", "th"},
        "tfoot": {"thead", "tbody", "tr", "td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"},
         "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}, "option": {"select"}, "body": set()}


class Node:
    __slots__ = ("tag", "attrs", "parent", "parts", "depth")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.parts: list[Node | str] = []
        self.depth = parent.depth + 1 if parent else 0


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


class Open:
    """The open elements, with what is asked about them at hand."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = defaultdict(list)      # tag -> places in the stack, ascending
        self.blocks, self.paragraphs = [0], [0]                    # per place: the innermost block; the p that only inlines part from it

    def push(self, node: Node) -> None:
        at, inline = len(self.stack), node.tag in INLINE
        self.stack.append(node)
        self.places[node.tag].append(at)
        self.blocks.append(self.blocks[-1] if inline else at)
        self.paragraphs.append(at if node.tag == "p" else self.paragraphs[-1] if inline else 0)

    def close(self, at: int) -> None:
        """Ends the element at a place and all that it holds."""
        for node in self.stack[at:]:
            self.places[node.tag].pop()
        del self.stack[at:], self.blocks[at:], self.paragraphs[at:]

    def last(self, tag: str) -> int:
        return self.places[tag][-1] if self.places.get(tag) else 0

    def end(self, tag: str) -> None:
        """An end tag; a stray inline one ends no block."""
        at = self.last(tag)
        if at and (tag not in INLINE or at > self.blocks[-1]):
            self.close(at)

    def make_room(self, tag: str) -> None:
        """Ends what a start tag ends: elements of its kind, an open paragraph."""
        if tag in ENDS:
            scope = max((self.last(t) for t in SCOPE[tag]), default=0)
            inside = [p[k] for p in map(self.places.get, ENDS[tag]) if p and (k := bisect(p, scope)) < len(p)]
            if inside:
                self.close(min(inside))
        if tag not in INLINE and tag not in VOID and self.paragraphs[-1]:
            self.close(self.paragraphs[-1])


def parse(page: str) -> Node:
    """The tree of a page.  ``attrs`` is left as written; texts are decoded."""
    root = Node("", "", None)
    opened, at, n = Open(root), 0, len(page)
    stack = opened.stack
    while at < n:
        m = TOKEN.search(page, at)
        if m is None or m.start() > at:
            text = page[at:m.start() if m else n]
            if stack[-1].tag == "head" and text.strip():
                opened.close(len(stack) - 1)
            stack[-1].parts.append(html.unescape(text) if "&" in text else text)
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            opened.end(tag)
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            opened.close(len(stack) - 1)
        opened.make_room(tag)
        node = Node(tag, m[3] or "", stack[-1])
        stack[-1].parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not (m[3] or "").endswith("/"):
            opened.push(node)
    return root
