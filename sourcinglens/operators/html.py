"""HTML extraction over a ``pages`` table.

Visible text, images, links and emails are built-in regex expressions (one
codegen'd projection per page; ``html`` never enters a shuffle).  Class-rule
selection (H4) needs a real parser: ``mapInPandas`` with the standard
library's ``html.parser``, rules passed as data, emitting long rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcinglens.functions import urls

# Fixed values.  Blocks whose text is never visible, removed in this order
# (script bodies may hold '</p>', so they go before tags).
INVISIBLE_BLOCKS = (
    r"(?s)<!--.*?-->",
    r"(?is)<script[^>]*>.*?</script\s*>",
    r"(?is)<style[^>]*>.*?</style\s*>",
    r"(?is)<title[^>]*>.*?</title\s*>",
    r"(?is)<head\b[^>]*>.*?</head\s*>",
    r"(?is)<!DOCTYPE[^>]*>",
)
TAG = r"<[^>]*>"
# Named entities decoded after tags are removed; '&amp;' is decoded last.
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "),
    ("&copy;", "©"), ("&middot;", "·"), ("&reg;", "®"), ("&ndash;", "–"),
    ("&mdash;", "—"), ("&amp;", "&"),
)
# White space as str.split() sees it.
SPACE = r"[\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
IMG_SRC = r"""<img\b[^>]*?\ssrc\s*=\s*["']([^"']*)["']"""
A_HREF = r"""<a\b[^>]*?\shref\s*=\s*["']([^"']*)["']"""
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+"
EMAIL_STRICT = r"(?i)[a-z0-9.\-+_]+@[a-z0-9.\-+_]+\.com"
PAGER_SEGMENT = "pg-"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _numeric(text: Column) -> Column:
    """Numeric character references decoded; ones that name no character go."""
    reference = r"&#([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"
    code = lambda n: F.when(F.lower(n).startswith("x"), F.conv(F.substring(n, 2, 6), 16, 10)).otherwise(n).cast("int")

    def char(n: Column) -> Column:
        k = code(n)
        real = k.between(1, 0xD7FF) | k.between(0xE000, 0x10FFFF)
        return F.when(real, F.decode(F.unhex(F.lpad(F.hex(k), 8, "0")), "UTF-32")).otherwise(F.lit(""))

    chars = F.transform(F.regexp_extract_all(text, F.lit(reference), F.lit(1)), char)
    pieces = F.split(text, reference)
    joined = F.concat_ws("", F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(chars, i), F.lit("")))))
    return F.when(text.contains("&#"), joined).otherwise(text)


def decode_entities(col: Column | str) -> Column:
    """Named (fixed list) and numeric references; '&amp;' last, so what it
    uncovers is not decoded again."""
    c = _c(col)
    for ent, ch in ENTITIES[:-1]:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    c = F.get(F.transform(F.array(c), _numeric), F.lit(0))      # bound once: it is used several times
    return F.replace(c, F.lit(ENTITIES[-1][0]), F.lit(ENTITIES[-1][1]))


def quoted_attributes(html: Column) -> Column:
    """Puts quotes around unquoted href and src values."""
    return F.regexp_replace(html, r"""(?i)(\s(?:href|src)\s*=\s*)([^\s"'>]+)""", '$1"$2"')


def visible_text(html: Column | str) -> Column:
    """Text outside comments, scripts, styles, titles and tags, entity-decoded."""
    c = _c(html)
    for pat in INVISIBLE_BLOCKS:
        c = F.regexp_replace(c, pat, " ")
    return decode_entities(F.regexp_replace(c, TAG, "\n"))


def visible_tokens(html: Column | str) -> Column:
    """H1: white-space tokens of the visible text (array, in page order)."""
    t = F.split(F.trim(F.regexp_replace(visible_text(html), SPACE, " ")), " ")
    return F.filter(t, lambda x: x != "")


def image_sources(html: Column | str) -> Column:
    """H2: non-empty, trimmed img src values."""
    srcs = F.transform(F.regexp_extract_all(quoted_attributes(_c(html)), F.lit(IMG_SRC), 1), lambda s: F.trim(decode_entities(s)))
    return F.filter(srcs, lambda s: s != "")


def page_links(pages: DataFrame, key: Sequence[str] = ("page_id",), url: str = "url") -> DataFrame:
    """H3: anchors resolved against the page URL, '.gz' dropped, same origin
    only (the page's origin occurs in the link).  Rows: (key..., pos, link)."""
    hrefs = F.regexp_extract_all(quoted_attributes(F.col("html")), F.lit(A_HREF), 1)
    ex = pages.select(*key, F.col(url).alias("_base"), F.posexplode(hrefs).alias("pos", "href"))
    resolved = ex.select(*key, "_base", "pos", urls.resolve_link(F.col("_base"), decode_entities("href")).alias("link"))
    origin = F.regexp_extract("_base", urls.ORIGIN, 1)
    return resolved.where(F.col("link").isNotNull() & ~F.col("link").endswith(".gz")
                          & F.col("link").contains(origin)).select(*key, "pos", "link")


def emails_in_text(text: Column | str, strict: bool = False) -> Column:
    """E-mail addresses in raw text (array, in order; duplicates kept)."""
    return F.regexp_extract_all(_c(text), F.lit(EMAIL_STRICT if strict else EMAIL), 0)


def emails_in_pages(pages: DataFrame, key: Sequence[str], text: str = "html", strict: bool = False,
                    trim_dot: bool = False) -> DataFrame:
    """Distinct (key..., email) rows."""
    e = pages.select(*key, F.explode(emails_in_text(text, strict)).alias("email"))
    if trim_dot:
        e = e.withColumn("email", F.regexp_replace("email", r"\.+$", ""))
    return e.distinct()


def listing_pages(seeds: DataFrame, counts: DataFrame) -> DataFrame:
    """Page-number URLs '<dir>/pg-N/<file>' for N in 1..max_pages."""
    j = seeds.join(counts, "url")
    return j.select("url", "origin", F.explode(F.sequence(F.lit(1), F.col("max_pages"))).alias("page")).select(
        F.col("url").alias("seed"), "origin", "page",
        F.regexp_replace("url", r"^(.*/)([^/]*)$", F.concat(F.lit("$1" + PAGER_SEGMENT), F.col("page").cast("string"),
                                                             F.lit("/$2"))).alias("url"))


# --- H4: class-rule selection -------------------------------------------------

RULE_T = T.StructType([T.StructField("rule", T.StringType()), T.StructField("pos", T.IntegerType()),
                       T.StructField("value", T.StringType())])


def _select_rules(html: str, rules: list[tuple[str, str, str, str | None]]) -> list[tuple[str, int, str]]:
    """Parse once; for each element carrying a rule's class (and tag, when
    given) emit its attribute value or its stripped text."""
    from html.parser import HTMLParser

    out: list[tuple[str, int, str]] = []
    counts: dict[str, int] = {}
    void = {"br", "img", "meta", "link", "input", "hr", "source", "area", "base", "col", "wbr"}

    class P(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.stack: list[tuple[str, list]] = []  # (tag, open captures)

        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            classes = (a.get("class") or "").split()
            caps = []
            for name, cls, want_tag, attr in rules:
                if cls in classes and (not want_tag or want_tag == tag):
                    if attr:
                        v = a.get(attr)
                        if v is not None:
                            k = counts.get(name, 0)
                            counts[name] = k + 1
                            out.append((name, k, v.strip()))
                    else:
                        caps.append([name, []])
            if tag not in void:
                self.stack.append((tag, caps))
            else:
                self._close(caps)

        def _close(self, caps):
            for name, buf in caps:
                k = counts.get(name, 0)
                counts[name] = k + 1
                out.append((name, k, "".join(buf).strip()))

        def handle_endtag(self, tag):
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == tag:
                    while len(self.stack) > i:
                        _, caps = self.stack.pop()
                        self._close(caps)
                    break

        def handle_data(self, data):
            for _, caps in self.stack:
                for cap in caps:
                    cap[1].append(data)

    p = P()
    try:
        p.feed(html or "")
        p.close()
    except Exception:  # noqa: BLE001 - a broken page yields what was parsed
        pass
    while p.stack:
        _, caps = p.stack.pop()
        p._close(caps)
    return out


def select_text(pages: DataFrame, rules: Sequence[tuple[str, str, str, str | None]],
                key: Sequence[str] = ("url",)) -> DataFrame:
    """H4: ``(key..., rule, pos, value)`` for every element matching a rule.

    ``rules``: (name, css class, tag or '', attribute or None for text).
    Runs as Arrow batches per partition; only key columns and results leave
    the Python worker.
    """
    rules = [tuple(r) for r in rules]
    key = list(key)
    schema = T.StructType([*(pages.schema[k] for k in key), *RULE_T.fields])

    def run(it):
        for pdf in it:
            rows = []
            for rec in pdf.itertuples(index=False):
                kv = tuple(getattr(rec, k) for k in key)
                for name, pos, val in _select_rules(rec.html, rules):
                    rows.append((*kv, name, pos, val))
            yield pd.DataFrame(rows, columns=[*key, "rule", "pos", "value"])

    return pages.select(*key, "html").mapInPandas(run, schema)
