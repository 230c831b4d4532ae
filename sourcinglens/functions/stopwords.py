"""Stopword list.

Matching terms are filtered against the stopwords of *all* languages at once
(an English word that is a foreign stopword goes too).  The default is the
union of the 14 public Apache Spark MLlib lists, kept as a plain text resource
of this package (one word a line), so neither a jar nor a JVM is needed to
read it.  Users may pass any other list instead.
"""

from __future__ import annotations

import functools
from importlib import resources


@functools.lru_cache(maxsize=None)
def default_stopwords() -> tuple[str, ...]:
    """Sorted union of the default lists."""
    text = resources.files("sourcinglens.resources").joinpath("stopwords.txt").read_text(encoding="utf-8")
    return tuple(sorted(w for w in text.split("\n") if w))


def sql_list_literal(words: tuple[str, ...] | None = None) -> str:
    """The stopword list as a SQL list literal ``['a', 'b', ...]`` (oracle side)."""
    words = default_stopwords() if words is None else words
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
