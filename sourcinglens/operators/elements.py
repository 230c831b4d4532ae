"""Elements of an HTML text with all they hold, as column expressions.

A page is split before every ``<``.  One fold over the pieces keeps the stack
of open tags: an end tag closes the nearest open element of its name and all
that is open inside it; end tags without one are ignored, and the end of the
page closes the rest.  Ranges of pieces then give an element's content, or the
page without it.  Nothing leaves the projection, so html is never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that hold nothing.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
HIDDEN = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
TAG = r"""(?s)^<(?:[^>"']|"[^"]*"|'[^']*')*>"""
RANGES = "array<struct<start:int,stop:int>>"
FOLD = f"struct<stack:array<string>,open:int,start:int,out:{RANGES}>"


def pieces_of(html: Column) -> Column:
    """The page, without comments, scripts and styles, cut before every '<'."""
    return F.split(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, ""), "(?=<)")


def _name(piece: Column) -> Column:
    return F.lower(F.regexp_extract(piece, r"^</?([A-Za-z][A-Za-z0-9:-]*)", 1))


def has_class(piece: Column, name: str) -> Column:
    """Whether a piece is a start tag that carries the class."""
    return piece.rlike(rf"""(?is)^<[a-z][^>]*\sclass\s*=\s*(?:"(?:[^"]*\s)?{name}(?:\s[^"]*)?"|'(?:[^']*\s)?{name}(?:\s[^']*)?'|{name}[\s>/])""")


def is_tag(piece: Column, name: str) -> Column:
    return piece.rlike(rf"(?i)^<{name}[\s>/]")


def ranges(pieces: Column, test: Callable[[Column], Column]) -> Column:
    """Outermost elements whose start tag passes ``test``: numbers of the piece
    with the start tag and of the piece after the last one inside.  ``pieces``
    is read several times: pass a bound value."""
    def token(p: Column, i: Column) -> Column:
        def of(name: Column) -> Column:
            opens = ~p.startswith("</") & (name != "") & ~name.isin(*VOID) & ~p.rlike(r"^<[^>]*/>")
            return F.struct(i.alias("at"), name.alias("name"), p.startswith("</").alias("closes"), opens.alias("opens"))
        return bound(_name(p), of)

    def step(s: Column, t: Column) -> Column:
        size = F.size(s["stack"])

        def on(back: Column) -> Column:                                                    # 1: the innermost
            closing = back > 0
            left = size - back
            ended = (s["open"] > 0) & (left < s["open"])
            begins = t["opens"] & t["hit"] & (s["open"] == 0)
            return F.struct(
                F.when(closing, F.slice(s["stack"], F.lit(1), left)).when(t["opens"], F.array_append(s["stack"], t["name"]))
                .otherwise(s["stack"]).alias("stack"),
                F.when(ended, F.lit(0)).when(begins, size + 1).otherwise(s["open"]).alias("open"),
                F.when(begins, t["at"]).otherwise(s["start"]).alias("start"),
                F.when(ended, F.array_append(s["out"], F.struct(s["start"].alias("start"), t["at"].alias("stop"))))
                .otherwise(s["out"]).alias("out")).cast(FOLD)

        return bound(F.when(t["closes"], F.array_position(F.reverse(s["stack"]), t["name"]).cast("int")).otherwise(F.lit(0)), on)

    # Only pieces with a tag that opens or closes something take a step; only start tags are tested.
    tags = F.filter(F.transform(pieces, token), lambda t: t["opens"] | t["closes"])
    tested = F.transform(tags, lambda t: t.withField("hit", t["opens"] & test(F.get(pieces, t["at"]))))
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(0).alias("open"),
                     F.lit(0).alias("start"), F.array().cast(RANGES).alias("out")).cast(FOLD)
    folded = lambda ts: F.aggregate(ts, start, step, lambda s: F.when(s["open"] > 0, F.array_append(
        s["out"], F.struct(s["start"].alias("start"), F.size(pieces).alias("stop")))).otherwise(s["out"]))
    return bound(tested, lambda ts: F.when(F.exists(ts, lambda t: t["hit"]), folded(ts)).otherwise(F.array().cast(RANGES)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def inner(pieces: Column, test: Callable[[Column], Column]) -> Column:
    """Inner HTML of every outermost element that passes ``test``."""
    def content(p: Column, r: Column) -> Column:
        first = F.regexp_replace(F.get(p, r["start"]), TAG, "")
        return F.concat(first, F.array_join(F.slice(p, r["start"] + 2, r["stop"] - r["start"] - 1), ""))
    return bound(pieces, lambda p: F.transform(ranges(p, test), lambda r: content(p, r)))


def without(pieces: Column, test: Callable[[Column], Column]) -> Column:
    """The pieces outside every element that passes ``test``."""
    def rest(p: Column, gone: Column) -> Column:
        # The piece at ``stop`` starts with the element's end tag, unless that of an outer one ends it.
        def ends(x: Column, i: Column) -> Column:
            return F.exists(gone, lambda r: (i == r["stop"]) & (_name(x) == _name(F.get(p, r["start"]))))
        kept = F.filter(F.transform(p, lambda x, i: F.when(ends(x, i), F.regexp_replace(x, "^</[^>]*>", "")).otherwise(x)),
                        lambda x, i: ~F.exists(gone, lambda r: (i >= r["start"]) & (i < r["stop"])))
        return F.when(F.size(gone) == 0, p).otherwise(kept)
    return bound(pieces, lambda p: bound(ranges(p, test), lambda gone: rest(p, gone)))
