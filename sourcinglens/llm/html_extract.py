"""Main text of web pages: boosted trees over DOM nodes, decoded as a tree.

Every block element gets features of its subtree (text density, links, marks),
its attribute tokens and those of its ancestors, its depth and its siblings.
Boosted trees score it as *outer* (a wrapper around the article), *main*
(article) or *boiler* (menu, header, notice, advert, comments ...).  Decoding
picks the best labelling of the whole tree among those that make sense: below
outer anything may stand, below main only main or boiler, below boiler only
boiler; so an article never hangs in a menu, and an advert inside an article
is cut out with all it holds.  Inline elements go with their block.

The trees are fit on pages rendered here, from templates of many layouts filled
with text of a bounded sample of the given pages: their labels are known.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcinglens.llm.boosting import Boosted
from sourcinglens.llm.common import pick
from sourcinglens.llm.dom import HIDDEN, INLINE, Node, attributes, parse

OUTER, MAIN, BOILER = 0, 1, 2

#: Words of class, id and role attributes, by what they hint at.
HINTS = {
    "main": "article content main post entry story text body prose markdown",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs tabs pagination pager toolbar",
    "header": "header masthead top topbar logo branding hero",
    "footer": "footer bottom copyright colophon legal",
    "side": "side sidebar aside widget widgets rail column",
    "notice": "notice cookie cookies consent banner alert gdpr popup modal overlay message warning info",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion teaser outbrain taboola",
    "form": "form search newsletter subscribe signup login contact",
    "comments": "comment comments reply replies respond disqus discussion thread feedback review reviews",
    "more": "related share sharing social recommended more tags tag meta author byline follow",
}
HINT_OF = {w: i for i, words in enumerate(HINTS.values()) for w in words.split()}
TAGS = ["html", "body", "div", "section", "article", "main", "nav", "header", "footer", "aside", "ul", "ol", "li", "p",
        "h1", "h2", "h3", "blockquote", "pre", "table", "tr", "td", "figure", "figcaption", "dl", "form", "fieldset"]
#: Controls of a form: their own text is hidden, their number tells.
FIELDS = {"input", "select", "button", "textarea"}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


class Block:
    """A block element: its part of the text, and sums over its subtree."""
    __slots__ = ("node", "parent", "children", "own", "chars", "linked", "links", "tags", "paragraphs", "marks", "fields",
                 "hints", "above", "place", "label")

    def __init__(self, node: Node, parent: Block | None):
        self.node, self.parent, self.children = node, parent, []
        self.own = self.chars = self.linked = self.links = self.tags = self.paragraphs = self.marks = self.fields = 0
        values = attributes(node.attrs) if node.attrs else {}
        self.label = values.get("data-known")
        text = " ".join(values.get(a, "") for a in ("class", "id", "role", "aria-label"))
        self.hints = {HINT_OF[w.lower()] for w in _WORD.findall(text) if w.lower() in HINT_OF} if text.strip() else set()
        self.above = parent.above | parent.hints if parent else set()
        self.place = 0


def blocks_of(root: Node) -> list[Block]:
    """Blocks in page order (the first is the root), sums filled in."""
    out = [Block(root, None)]

    open_parts = [(iter(root.parts), out[0], False)]         # a stack of our own: pages nest deeper than Python may
    while open_parts:
        parts, block, linked = open_parts[-1]
        for part in parts:
            if isinstance(part, str):
                n = len(part.strip())
                block.own += n
                block.linked += n * linked
                block.marks += sum(part.count(c) for c in ".,;:!?")
            elif part.tag in HIDDEN:
                block.fields += part.tag in FIELDS and attributes(part.attrs).get("type", "").lower() != "hidden"
            elif part.tag in INLINE or part.tag in ("br", "img"):
                block.links += part.tag == "a"
                block.tags += 1
                open_parts.append((iter(part.parts), block, linked or part.tag == "a"))
                break
            else:
                child = Block(part, block)
                block.children.append(child)
                out.append(child)
                open_parts.append((iter(part.parts), child, linked))
                break
        else:
            open_parts.pop()

    for b in reversed(out):
        b.chars += b.own
        b.tags += 1
        b.paragraphs += b.node.tag == "p"
        if b.parent:
            for k in ("chars", "linked", "links", "tags", "paragraphs", "marks", "fields"):
                setattr(b.parent, k, getattr(b.parent, k) + getattr(b, k))
        for i, c in enumerate(b.children):
            c.place = i
    return out


class Family:
    """What all children of a block share: taken once, not once per child."""
    __slots__ = ("size", "alike", "longest", "paragraphs")

    def __init__(self, members: list[Block]):
        self.size = len(members)
        self.alike = Counter(m.node.tag for m in members)
        self.longest = max(m.chars for m in members)
        self.paragraphs = sum(m.paragraphs for m in members)


def features(blocks: list[Block]) -> np.ndarray:
    total = max(blocks[0].chars, 1)
    rows, seen = [], 0
    families = {id(b): Family(b.children) for b in blocks if b.children}
    alone = Family(blocks[:1])
    for b in blocks:
        tag = b.node.tag
        mates = families[id(b.parent)] if b.parent else alone
        around = (b.parent.chars if b.parent else b.chars) or 1
        rows.append([
            b.chars / total, np.log1p(b.chars), b.chars / b.tags, b.linked / max(b.chars, 1), b.links, b.tags, b.paragraphs,
            b.marks / max(b.chars, 1), b.own / max(b.chars, 1), b.node.depth, len(b.children), b.place, mates.size,
            mates.alike[tag] / mates.size, b.chars / around, mates.longest / around, seen / total,
            mates.paragraphs, b.fields, b.fields / (b.tags + b.fields), TAGS.index(tag) if tag in TAGS else -1,
            TAGS.index(b.parent.node.tag) if b.parent and b.parent.node.tag in TAGS else -1,
            *(tag == t for t in TAGS), *(i in b.hints for i in range(len(HINTS))), *(i in b.above for i in range(len(HINTS)))])
        seen += b.own
    return np.array(rows, np.float64)


def decode(blocks: list[Block], scores: np.ndarray) -> list[int]:
    """The labelling with the largest sum of scores that goes only from outer
    to main to boiler on any way down."""
    number = {id(b): i for i, b in enumerate(blocks)}
    best = scores.copy()
    for i in range(len(blocks) - 1, 0, -1):
        up = best[number[id(blocks[i].parent)]]
        up += [best[i].max(), max(best[i][MAIN], best[i][BOILER]), best[i][BOILER]]
    labels = [OUTER] * len(blocks)
    for i in range(1, len(blocks)):
        above = labels[number[id(blocks[i].parent)]]
        labels[i] = above + int(np.argmax(best[i][above:]))
    return labels


def text_of(blocks: list[Block], labels: list[int]) -> str:
    """Main blocks in page order: white space inside one becomes one space."""
    label = {id(b.node): x for b, x in zip(blocks, labels, strict=True)}
    out: list[list[str]] = [[]]

    open_parts = [(iter(blocks[0].node.parts), False, False)]
    while open_parts:
        parts, main, is_block = open_parts[-1]
        for part in parts:
            if isinstance(part, str):
                if main:
                    out[-1].append(part)
            elif part.tag in HIDDEN:
                continue
            elif part.tag in INLINE:
                open_parts.append((iter(part.parts), main, False))
                break
            elif id(part) in label:
                out.append([])
                open_parts.append((iter(part.parts), label[id(part)] == MAIN, True))
                break
            elif main:
                out[-1].append(" ")                   # br, img and the like part words
        else:
            open_parts.pop()
            if is_block:
                out.append([])
    return "\n".join(t for t in (_SPACE.sub(" ", "".join(p)).strip() for p in out) if t)


# --- pages with known labels ---------------------------------------------------

def _attr(rng, label: str, names: list[str], plain: float = 0.3) -> str:
    known = f' data-known="{label}"'
    if rng.random() < plain:
        return known
    return known + f' {rng.choice(["class", "id"])}="{rng.choice(names)}"'


def render(rng: np.random.Generator, texts: list[str]) -> str:
    """One page of a random layout; data-known gives each element's label."""
    def words(a: int, b: int) -> str:
        w = texts[rng.integers(len(texts))].split()
        n = int(rng.integers(a, b))
        at = int(rng.integers(max(1, len(w) - n)))
        return " ".join(w[at:at + n]) or "x"

    def some(a: int, b: int) -> range:
        return range(int(rng.integers(a, b)))

    def links(label: str, a: int = 3, b: int = 9) -> str:
        return f'<ul data-known="{label}">' + "".join(
            f'<li data-known="{label}"><a href="/x">{words(1, 4)}</a></li>' for _ in range(int(rng.integers(a, b)))) + "</ul>"

    def el(tag: str, label: str, names: str, inside: str, plain: float = 0.3) -> str:
        return f"<{tag}{_attr(rng, label, names.split(), plain)}>{inside}</{tag}>"

    def p(label: str, a: int = 8, b: int = 90) -> str:
        style = rng.random()
        inner = words(a, b)
        if style < 0.2:
            inner = f"<b>{inner}<br>"
        elif style < 0.4:
            inner += f' <a href="/y">{words(1, 4)}</a> {words(2, 20)}'
        return f'<p data-known="{label}">{inner}' + ("</p>" if rng.random() < 0.8 else "")

    def boiler(kind: int) -> str:
        k = "B"
        return [
            lambda: el(rng.choice(["nav", "div", "div"]), k, "menu nav main-nav top-menu navigation site-links", links(k), 0.2),
            lambda: el(rng.choice(["header", "div"]), k, "header masthead site-header topbar", f'<a href="/">{words(1, 3)}</a>' + (links(k, 2, 6) if rng.random() < .6 else f'<p data-known="B">{words(2, 8)}</p>'), 0.2),
            lambda: el(rng.choice(["aside", "div"]), k, "sidebar side widget rail right-column", f'<h3 data-known="B">{words(1, 4)}</h3>' + links(k) + (p(k, 4, 20) if rng.random() < .5 else ""), 0.2),
            lambda: el("div", k, "ad ads advert sponsored promo ad-slot banner-ad", words(3, 25) if rng.random() < .6 else p(k, 3, 25), 0.1),
            lambda: el("div", k, "cookie-notice consent notice banner alert alert-info gdpr", p(k, 5, 30) if rng.random() < .6 else words(5, 30), 0.1),
            lambda: el(rng.choice(["section", "div"]), k, "comments comment-list discussion replies reader-comments", "".join(
                el(rng.choice(["div", "li", "article"]), k, "comment reply comment-body", (f'<span>{words(1, 3)}</span>' if rng.random() < .5 else "") + p(k, 4, 60), 0.2) for _ in some(1, 6)), 0.05),
            lambda: el(rng.choice(["div", "section"]), k, "related share social more recommended tags", links(k, 2, 7), 0.2),
            lambda: el(rng.choice(["footer", "footer", "div"]), k, "footer site-footer bottom copyright", f"&copy; {words(1, 4)} &middot; {words(2, 20)}" + (links(k, 2, 6) if rng.random() < .4 else ""), 0.15),
            lambda: el("form", k, "search newsletter login subscribe contact-form comment-form", rng.choice([words(1, 12), p(k, 2, 15), f'<h3 data-known="B">{words(1, 5)}</h3>', f'<div data-known="B">{words(1, 8)}</div>'])
                       + "".join(rng.choice(['<label>Name</label><input type="text">', "<input name=q>", "<select><option>one</select>", "<textarea></textarea>"]) for _ in some(1, 5)) + "<button>Go</button>", 0.3),
        ][kind]()

    def piece() -> str:
        r = rng.random()
        if r < 0.2:
            return p("M", 1, 8)
        if r < 0.78:
            return p("M")
        if r < 0.84:
            return f'<h2 data-known="M">{words(2, 8)}</h2>'
        if r < 0.88:
            return '<ul data-known="M">' + "".join(f'<li data-known="M">{words(3, 20)}</li>' for _ in some(2, 6)) + "</ul>"
        if r < 0.92:
            return f'<blockquote data-known="M">{p("M")}</blockquote>'
        if r < 0.95:
            return f'<div data-known="M">{words(8, 60)}</div>'
        return boiler(int(rng.choice([3, 6, 3, 4, 8])))

    head = f'<h1 data-known="M">{words(2, 14)}</h1>'
    pieces = [piece() for _ in some(1, 14)] if rng.random() < 0.85 else [p("M", 3, 12)]
    body = (f'<header data-known="M">{head}</header>' if rng.random() < 0.15 else head if rng.random() < 0.9 else "") + "".join(pieces)
    tag = rng.choice(["article", "article", "main", "div", "div", "section"])
    names = "content article post entry-content main story post-body text page-content article-body"
    page = el(tag, "M", names, body, 0.7 if tag in ("article", "main") else 0.15)
    before = "".join(boiler(k) for k in (0, 1, 3, 4) if rng.random() < (0.8, 0.4, 0.4, 0.25)[(0, 1, 3, 4).index(k)])
    after = "".join(boiler(k) for k in (2, 3, 5, 6) if rng.random() < (0.3, 0.25, 0.35, 0.3)[(2, 3, 5, 6).index(k)])
    inner = rng.random() < 0.5
    page = (before + page + after) if inner else page
    for _ in some(0, 3):
        page = el(rng.choice(["div", "div", "main", "section"]), "O", "wrapper container page row layout site content", page, 0.4)
    page = page if inner else before + page + after
    if rng.random() < 0.3:
        page = boiler(8) + page if rng.random() < 0.5 else page + boiler(8)
    page += boiler(7) if rng.random() < 0.8 else ""
    if rng.random() < 0.15:                           # some servers put the whole page into one form
        page = el("form", "O", "aspnetForm form1 main-form page", '<input type="hidden" name="__VIEWSTATE" value="x">' + page, 0.2)
    return f'<!DOCTYPE html><html data-known="O"><head><title>{words(2, 8)}</title></head><body data-known="O">{page}</body></html>'


def training_texts(pages: DataFrame, html_col: str = "html", sample: int = 300) -> list[str]:
    """Visible text of at most ``sample`` pages, chosen by a hash of the page."""
    keyed = pick(pages, html=html_col).where(F.octet_length("html").between(1, 1 << 16)).withColumn("key", F.xxhash64("html"))
    total = keyed.select("key").count()
    # About 4 * sample keys lie below the mark, however many pages there are:
    # no partition hands the driver more, and of equal pages one is taken.
    mark = int(min(1.0, 4 * sample / max(total, 1)) * (1 << 30))
    low = F.pmod("key", F.lit(1 << 30)) < mark
    chosen = keyed.where(low).select("key").distinct().orderBy("key").limit(sample)
    rows = keyed.where(low).join(F.broadcast(chosen), "key").groupBy("key").agg(F.first("html").alias("html")).orderBy("key").collect()
    texts = []
    for r in rows:
        blocks = blocks_of(parse(r.html))
        texts.append(text_of(blocks, [OUTER] + [MAIN] * (len(blocks) - 1)))
    return [t for t in texts if len(t) > 40] or ["the quick brown fox jumps over the lazy dog. " * 20]


def fit(texts: list[str], pages: int = 500, seed: int = 5) -> Boosted:
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(pages):
        blocks = blocks_of(parse(render(rng, texts)))
        labels = [{"O": OUTER, "M": MAIN, "B": BOILER}.get(b.label, -1) for b in blocks]
        keep = [i for i, y in enumerate(labels) if y >= 0]
        xs.append(features(blocks)[keep])
        ys.append(np.array(labels)[keep])
    return Boosted(3).fit(np.concatenate(xs), np.concatenate(ys))


def extract(model: Boosted, pages: list[str]) -> Iterator[str]:
    """Texts of some pages; the trees see all their nodes at once."""
    trees = [blocks_of(parse(p)) for p in pages]
    scores = model.log_probabilities(np.concatenate([features(t) for t in trees])) if trees else None
    at = 0
    for t in trees:
        yield text_of(t, decode(t, scores[at:at + len(t)]))
        at += len(t)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              sample: int = 300) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Defined cases: null or empty html gives the empty text, as does a page
    without an article; rows that repeat are extracted each for itself; an
    empty table gives an empty result.  The fit sees at most ``sample`` pages.
    """
    base = pick(pages, page_id=id_col, url=url_col, html=html_col).withColumn("html", F.coalesce("html", F.lit("")))
    model = fit(training_texts(pages, html_col, sample))
    schema = base.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                texts = list(extract(model, part.column("html").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return base.mapInArrow(run, schema)
