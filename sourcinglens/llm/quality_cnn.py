"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks of ``WIDTH`` bytes,
``STRIDE`` apart, covering all of it.  Each chunk gives the learned embeddings
of its bytes and one more channel, its *echo*: the largest share, over lags of
2 to ``LAGS`` bytes, of the bytes around it that equal the byte one lag back,
scaled to 0..4 (a word repeated on and on comes near 4).  Learned filters read a chunk;
each filter is max-pooled over the document, and one dense layer combines the
pooled values into a probability.

Labels come from a bounded sample of labelled rows (``per_class`` rows of each
class, chosen by a hash of the id, texts up to ``max_bytes``): only the fit is
bounded, scoring reads every whole text, in segments of ``SEGMENT`` bytes so
that memory does not grow with the longest text.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcinglens.llm.common import pick

WIDTH, STRIDE = 8, 4          # bytes of a chunk, and from one chunk to the next
ECHO, LAGS = 32, 32           # bytes an echo looks at, and its largest lag
SEGMENT = 1 << 18             # bytes handled at a time (a multiple of ECHO)
EMBED, FILTERS = 4, 16


def echo(data: np.ndarray) -> np.ndarray:
    """Echo, times 4, of each half window of ``ECHO`` bytes (it and the next half)."""
    half = ECHO // 2
    n = -(-len(data) // half)
    equal = np.zeros((LAGS - 1, n * half), np.uint8)
    for lag in range(2, min(LAGS, len(data) - 1) + 1):
        np.equal(data[lag:], data[:-lag], out=equal[lag - 2, lag:len(data)].view(bool))
    words = equal.view(np.uint64).reshape(LAGS - 1, n, half // 8)
    eights = sum(words[:, :, i] for i in range(1, half // 8)) + words[:, :, 0]     # byte-wise sums, no carry
    per_half = ((eights * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.int32)
    both = per_half.copy()
    both[:, :-1] += per_half[:, 1:]
    return both.max(0).astype(np.float32) * np.float32(4 / ECHO)


def chunks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes, zero-padded to whole chunks, and the echo of each chunk."""
    n = max(1, -(-(len(data) - (WIDTH - STRIDE)) // STRIDE))
    padded = np.zeros((n - 1) * STRIDE + WIDTH, np.uint8)
    padded[:len(data)] = data
    if not len(data):
        return padded, np.zeros(n, np.float32)
    e = echo(data)
    return padded, e[np.minimum(np.arange(n) * STRIDE // (ECHO // 2), len(e) - 1)]


class Network:
    """Parameters: embedding (256, EMBED), filters, and the dense layer."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = rng.normal(0, 0.3, (WIDTH * EMBED + 1, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.dense = rng.normal(0, 0.3, FILTERS).astype(np.float32)
        self.offset = np.zeros(1, np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.dense, self.offset]

    def responses(self, padded: np.ndarray, e: np.ndarray) -> np.ndarray:
        flat = self.embed.take(padded, axis=0)
        row = flat.strides[0]
        windows = np.lib.stride_tricks.as_strided(flat, (len(e), WIDTH * EMBED), (STRIDE * row, flat.strides[1]))
        return windows @ self.filters[:-1] + e[:, None] * self.filters[-1]

    def score(self, data: np.ndarray) -> float:
        """Probability of label 1; segments overlap so that no chunk is lost."""
        pooled = np.full(FILTERS, -np.inf, np.float32)
        for at in range(0, max(1, len(data)), SEGMENT):
            pooled = np.maximum(pooled, self.responses(*chunks(data[at:at + SEGMENT + ECHO])).max(0))
        z = float(np.maximum(pooled + self.bias, 0) @ self.dense + self.offset[0])
        return 1 / (1 + np.exp(-min(max(z, -60.0), 60.0)))

    def gradient(self, padded: np.ndarray, e: np.ndarray, label: int) -> list[np.ndarray]:
        """Gradient of the log loss; only each filter's best chunk takes part."""
        r = self.responses(padded, e)
        best = r.argmax(0)
        pooled = r[best, np.arange(FILTERS)] + self.bias
        hidden = np.maximum(pooled, 0)
        z = float(hidden @ self.dense + self.offset[0])
        d = np.float32(1 / (1 + np.exp(-z)) - label)
        back = d * self.dense * (pooled > 0)
        at = padded[best[:, None] * STRIDE + np.arange(WIDTH)]     # (FILTERS, WIDTH) bytes
        flat = self.embed[at].reshape(FILTERS, -1)
        g_filters = np.vstack([(flat * back[:, None]).T, (e[best] * back)[None]])
        g_embed = np.zeros_like(self.embed)
        np.add.at(g_embed, at.ravel(), (self.filters[:-1].T * back[:, None]).reshape(-1, EMBED))
        return [g_embed, g_filters, back, d * hidden, np.array([d], np.float32)]


def fit(rows: Iterable[tuple[str, int]], epochs: int = 8, batch: int = 32, rate: float = 0.01, decay: float = 1e-4,
        seed: int = 7) -> Network:
    """Adam on the log loss.  Rows are taken in one seeded order an epoch."""
    data = [(*chunks(np.frombuffer(t.encode(), np.uint8)), y) for t, y in rows]
    net, rng = Network(seed), np.random.default_rng(seed)
    first = [np.zeros_like(p) for p in net.parts()]
    second = [np.zeros_like(p) for p in net.parts()]
    step = 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(data)), max(1, len(data) // batch)):
            total = [np.zeros_like(p) for p in net.parts()]
            for i in at:
                for t, g in zip(total, net.gradient(*data[i]), strict=True):
                    t += g
            step += 1
            for p, m, v, g in zip(net.parts(), first, second, total, strict=True):
                g = g / len(at) + decay * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return net


def held_out(doc_id: Column) -> Column:
    """Rows kept out of every fit: crc32 of the id's decimal text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", per_class: int = 1500, max_bytes: int = 1 << 16) -> list[tuple[str, int]]:
    """The bounded, reproducible sample of labelled rows outside the held-out third."""
    known = (pick(labels, key=id_col, label=label_col).where(F.col("key").isNotNull() & F.col("label").isin(0, 1))
             .groupBy("key").agg(F.max("label").alias("label")).where(~held_out(F.col("key"))))
    order = F.xxhash64("key")
    chosen = known.where("label = 0").orderBy(order, "key").limit(per_class).unionAll(
        known.where("label = 1").orderBy(order, "key").limit(per_class))
    texts = pick(docs, key=id_col, text=text_col).join(F.broadcast(chosen), "key")    # 2 * per_class keys at most
    rows = texts.where(F.octet_length("text") <= max_bytes).select("key", "text", "label").collect()
    return [(r.text, int(r.label)) for r in sorted(rows, key=lambda r: (r.key, r.text))[:4 * per_class]]


def scorer(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           label_col: str = "quality", per_class: int = 1500):
    """A function from a text column to its score column, with a network fit on
    the labelled rows of ``docs``.  With labels of one class only every score
    is that class, with none it is 0.5."""
    rows = training_rows(docs, labels, id_col, text_col, label_col, per_class)
    classes = {y for _, y in rows}
    if len(classes) < 2:
        return lambda text: F.lit(float(max(classes)) if classes else 0.5)
    net = fit(rows)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([net.score(np.frombuffer(t.as_buffer(), np.uint8)) for t in texts.cast(pa.large_binary())], pa.float64())

    return lambda text: score(F.coalesce(text, F.lit("")))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", per_class: int = 1500) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Defined cases: a null text is empty, and is scored as the model scores no
    bytes; rows that repeat an id are scored each for itself; a null id is not
    held out; an empty table gives an empty result.
    """
    score = scorer(docs, labels, id_col, text_col, label_col, per_class)
    base = pick(docs, doc_id=id_col, text=text_col).withColumn("score", score(F.col("text")))
    return base.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The columns of ``docs``, the rows predicted to be label 1."""
    score = scorer(docs, labels, id_col, text_col, **options)
    names = docs.columns
    flat = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    kept = flat.withColumn("_score", score(F.col(f"_c{names.index(text_col)}"))).where("_score >= 0.5")
    return kept.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)])
