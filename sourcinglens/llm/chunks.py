"""Answers per text, put together from answers per chunk of text.

Byte-level BPE never merges across a single space that stands between two
other characters: the split pattern always starts a new match at such a space.
A text can so be cut there, and whatever a tokenizer gives for the chunks, one
after the other, is what it gives for the text.  Chunks repeat far more often
than texts, so each worker keeps the answers of chunks it has seen (up to ``cap``,
the ones not used lately go first).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

_SINGLE = re.compile(r"(?<=\S) (?=\S)")
#: White space other than the space: what ``\s`` matches.
_OTHER = [chr(c) for c in range(0x3001) if chr(c).isspace() and c != 0x20]
#: Name of the way texts are cut; stored answers hold it in their version.
CUT = "single spaces between two characters that are no white space"


def parts(text: str) -> list[str]:
    """The first chunk, then the other chunks without their leading space."""
    # Where no space touches other white space, plain splitting cuts at the same places.
    mixed = "  " in text or any(w in text and (f" {w}" in text or f"{w} " in text) for w in _OTHER)
    return _SINGLE.split(text) if mixed else text.split(" ")


class Recent:
    """Answers by key, the ones used lately: two generations of ``cap`` / 2.
    ``solve`` maps a list of keys to their answers, in order; ``weigh`` gives
    what an entry adds towards ``cap`` (one, if there is none)."""

    def __init__(self, solve: Callable[[list], list], cap: int, weigh: Callable | None = None):
        self.solve, self.cap, self.weigh = solve, cap, weigh
        self.young: dict = {}
        self.old: dict = {}
        self.weight = 0

    def hold(self, keys: set) -> dict:
        """A mapping that has every one of ``keys``, until the next call."""
        if self.weight > self.cap // 2:
            self.old, self.young, self.weight = self.young, {}, 0
        new = keys - self.young.keys()
        missing = sorted(new - self.old.keys())
        self.young.update((k, self.old[k]) for k in new & self.old.keys())
        if missing:
            self.young.update(zip(missing, self.solve(missing), strict=True))
        self.weight += sum(map(self.weigh, new)) if self.weigh else len(new)
        return self.young


class ChunkCache:
    """``solve`` maps a list of chunks to their answers, in order."""

    def __init__(self, solve: Callable[[list[str]], list], cap: int = 400_000, weigh: Callable | None = None):
        self.heads = Recent(solve, cap // 8, weigh)                                        # chunks as they are
        self.rest = Recent(lambda keys: solve([f" {k}" for k in keys]), cap, weigh)        # after their leading space

    def answers(self, texts: list[str], chars: int = 1_000_000) -> Iterator[list]:
        """One list of chunk answers per text; ``chars`` of text at a time."""
        group: list[list[str]] = []
        size = 0
        for t in texts:
            group.append(parts(t))
            size += len(t)
            if size >= chars:
                yield from self._flush(group)
                group, size = [], 0
        yield from self._flush(group)

    def _flush(self, group: list[list[str]]) -> Iterator[list]:
        words: set[str] = set()
        for p in group:
            words.update(p)
        heads = self.heads.hold({p[0] for p in group})
        rest = self.rest.hold(words)
        for p in group:
            yield [heads[p[0]], *map(rest.__getitem__, p[1:])]
