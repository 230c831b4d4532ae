"""A hashed maximum-entropy model of the next word, in numpy.

Words are leaves of a two-level tree: ``CLASSES`` classes of ``MEMBERS``
leaves.  P(word | history) = P(class | history) P(leaf | class, history)
P(word | leaf): a softmax over hashed features of the history (the word before,
the two before, the one two before and the one three before; the first two for
the leaf) and a constant one, another softmax of the same kind, and a share
fixed by counts.  The most frequent words have a leaf of their own, the
others share leaves by the power of two of their count and their hash, and one
leaf stands for all words that the training text lacks.  So the probabilities
of all known words and the unknown one add up to 1.
"""

from __future__ import annotations

import numpy as np

from sourcinglens.llm.shingles import mix

CLASSES, MEMBERS = 32, 32
BANDS, SHARES = 32, 8                          # shared leaves: powers of two of a count, times hash shares
FREQUENT = CLASSES * MEMBERS - BANDS * SHARES - 1
UNKNOWN = FREQUENT                             # the leaf of unknown words
ROWS = 1 << 15                                 # hashed rows of each level
DEEP = 2                                       # features of the choice of a leaf inside its class
BATCH = 1 << 16                                # tokens of a gradient step
LONG = 48                                      # rows of a segment that is summed by itself
LEAST, TOP = 1e-12, 60                         # of a leaf's share at the start, of a sum of weights
ODD = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
NONE = np.uint64(0x5851F42D4C957F2D)           # stands for the words before the first
STRANGE = np.uint64(0x14057B7EF767814F)        # for an unknown word in a history


def shared_leaf(counts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Leaf of words that have none of their own, by count (at least 1)."""
    band = np.minimum(np.frexp(counts.astype(np.float64))[1] - 1, BANDS - 1)
    return (FREQUENT + 1 + band * SHARES + (hashes >> np.uint64(61)).astype(np.int64) % SHARES).astype(np.int32)


def histories(keys: np.ndarray, place: np.ndarray, at: int, to: int) -> np.ndarray:
    """Hashed features of the histories of tokens at..to, (4, to - at) of 64 bits: the
    word before, the two before, the one two before, the one three before.
    ``keys``: all tokens' hashes; ``place``: their places in their texts."""
    back = []
    for k in (1, 2, 3):
        b = np.full(to - at, NONE)
        b[max(k - at, 0):] = keys[max(at - k, 0):max(to - k, 0)]
        b[place[at:to] < k] = NONE
        back.append(b)
    one, two, three = back
    return np.stack([mix(one + ODD[1]), mix(mix(one) * ODD[0] + two), mix(two + ODD[2]), mix(three + ODD[3])])


def segment_sums(values: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows ``values[order]`` of each segment: long ones by a
    matrix product, the others side by side, one row of each at a time."""
    sizes = np.diff(np.append(starts, len(order)))
    out = np.empty((len(starts), values.shape[1]), np.float32)
    ones = np.ones(max(sizes.max(), 1), np.float32)
    for i in np.flatnonzero(sizes >= LONG):
        part = values.take(order[starts[i]:starts[i] + sizes[i]], axis=0, mode="clip")
        np.matmul(ones[:sizes[i]], part, out=out[i])
    short = np.flatnonzero(sizes < LONG)
    short = short[np.argsort(-sizes[short].astype(np.int16), kind="stable")]
    if len(short):
        at, left = starts[short], sizes[short]
        sums = values.take(order[at], axis=0, mode="clip")
        for j in range(1, left[0]):
            more = np.searchsorted(-left, -j)                  # segments with more than j rows
            sums[:more] += values.take(order[at[:more] + j], axis=0, mode="clip")
        out[short] = sums
    return out


class MaxEnt:
    """Weights: per level a table of hashed rows and then those of the constant
    feature (one row of class biases; a row of leaf biases for each class).
    ``mass`` is each leaf's token count, where the constant feature starts."""

    def __init__(self, mass: np.ndarray, tables: list[np.ndarray] | None = None):
        mass = mass.astype(np.float64).reshape(CLASSES, MEMBERS)
        total = np.maximum(mass.sum(1), 1e-9)
        self.prior = [np.log(np.maximum(total / total.sum(), LEAST)).astype(np.float32)[None],
                      np.log(np.maximum(mass / total[:, None], LEAST)).astype(np.float32)]
        self.tables = tables or [np.zeros((ROWS + 1, CLASSES), np.float32), np.zeros((ROWS + CLASSES, MEMBERS), np.float32)]

    def rows(self, level: int, features: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Row numbers (features, tokens) of a level's table."""
        if level:
            features = mix(features[:DEEP] + cls.astype(np.uint64) * ODD[0])
        return (features & np.uint64(ROWS - 1)).astype(np.uint16)

    def chances(self, level: int, rows: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """P of each class, or of each leaf of ``cls``: (tokens, outcomes)."""
        table = self.tables[level]
        constant = self.prior[level] + table[ROWS:]
        z = np.take(constant, cls if level else np.zeros(len(cls), np.intp), axis=0)
        part = np.empty_like(z)
        for r in rows:
            np.take(table, r.astype(np.intp), axis=0, out=part, mode="clip")
            z += part
        np.minimum(z, TOP, out=z)
        np.exp(z, out=z)
        z /= (z @ np.ones(z.shape[1], np.float32))[:, None]
        return z

    def score(self, features: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each token's leaf."""
        cls, member = np.divmod(leaf, MEMBERS)
        here, out = np.arange(len(cls)), np.zeros(len(leaf), np.float64)
        for level, target in enumerate((cls, member)):
            p = self.chances(level, self.rows(level, features, cls), cls)[here, target]
            out += np.log(np.maximum(p, 1e-38), dtype=np.float64)
        return out


class Learner:
    """Local steps of one task: sparse gradients with adaptive step sizes."""

    def __init__(self, model: MaxEnt, rate: float, start: float):
        self.model, self.rate = model, rate
        self.energy = [np.full(t.shape, start, np.float32) for t in model.tables]
        self.touched = [np.zeros(len(t), np.float32) for t in model.tables]

    def _apply(self, level: int, numbers: np.ndarray, g: np.ndarray, order: np.ndarray) -> None:
        """One adaptive step; ``numbers`` name the table row of each row of g[order], sorted."""
        starts = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1]))
        rows = numbers[starts].astype(np.intp)
        sums = segment_sums(g, order, starts)
        e = self.energy[level].take(rows, axis=0)
        e += sums * sums
        self.energy[level][rows] = e
        np.sqrt(e, out=e)
        sums *= self.rate
        sums /= e
        self.model.tables[level][rows] -= sums
        self.touched[level][rows] += np.diff(np.append(starts, len(numbers)))

    def step(self, features: np.ndarray, leaf: np.ndarray) -> float:
        """One gradient step on a batch; returns the batch's log loss before it."""
        cls, member = np.divmod(leaf, MEMBERS)
        here, loss = np.arange(len(leaf)), 0.0
        for level, target in enumerate((cls, member)):
            rows = self.model.rows(level, features, cls)
            g = self.model.chances(level, rows, cls)
            loss -= float(np.log(np.maximum(g[here, target], 1e-38)).sum())
            g[here, target] -= 1
            flat = rows.ravel()
            order = np.argsort(flat, kind="stable")
            self._apply(level, flat[order], g, order % len(leaf))
            by = np.argsort(cls.astype(np.uint16), kind="stable") if level else here
            self._apply(level, ROWS + cls[by] if level else np.full(len(leaf), ROWS), g, by)
        return loss
