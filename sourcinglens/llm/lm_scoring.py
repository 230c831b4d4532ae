"""Language-model scores by a hashed maximum-entropy model (``maxent``).

1. Blocks: each task reads its texts in blocks of about ``BLOCK`` bytes and
   keeps a block's tokens as numbers of the block's own vocabulary; blocks are
   written as a table in the shared folder, so nothing is split into words twice.
2. Counts of every training word, over all blocks, by a shuffle of (word hash,
   block); each block gets the counts of its own vocabulary back.  No task or
   driver holds the vocabulary of all blocks.
3. Training in ``rounds`` over disjoint slices that cover all training text:
   tasks take sparse gradient steps from the shared weights, and their changes
   are averaged, weighted by how often a task touched a weight row, in stripes
   of rows.  Only the model itself (2 tables of 2^15 rows, 8 MB) passes the driver.
4. Scoring: one pass over the blocks, in batches.

In training, half of the words (by hash) that occur once in all training text
count as unknown, so the model learns when to expect unknown words.  Words are
compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcinglens.llm import maxent
from sourcinglens.llm.common import cut, pick, scratch_folder
from sourcinglens.llm.shingles import groups

BLOCK = 16 << 20              # bytes of text of a block
TASK = 72 << 20               # bytes of text a training task takes
END = np.uint64(0xE4D5C6B7A8990112)
STRIPE = 64                   # weight rows sent together


def held_out(doc_id: Column) -> Column:
    """Rows kept out of training: crc32 of the id's decimal text, mod 7, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def pack(x: np.ndarray) -> bytes:
    """Numbers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.decompress(data, n * size, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts, and where each text's tokens end."""
    parts, lengths = [], []
    for _, words in groups(texts, lower=True):
        parts.append(words.hash)
        lengths.append(np.diff(words.first))
    ends = np.cumsum(np.concatenate(lengths) + 1)
    out = np.empty(ends[-1], np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[ends - 1] = True
    out[is_end], out[~is_end] = END, np.concatenate(parts)
    return out, ends


def block_row(number: int, ids: pa.Array, train: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
    """A block as one row: its vocabulary, most frequent first, how often each
    word is in training text, and the tokens as places in the vocabulary."""
    hashes, ends = tokens_of(texts)
    words, token = np.unique(hashes, return_inverse=True)
    order = np.argsort(-np.bincount(token, minlength=len(words)), kind="stable")
    new = np.empty(len(words), np.uint32)
    new[order] = np.arange(len(words), dtype=np.uint32)
    token, words = new[token], words[order]
    lengths = np.diff(ends, prepend=0)
    tf = np.bincount(token[np.repeat(train, lengths)], minlength=len(words)).astype(np.int32)
    listed = lambda x, kind: pa.array([x], pa.list_(kind))
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), listed(train, pa.bool_()),
         listed(ends, pa.int64()), pa.array([pack(token)], pa.binary()), listed(words.view(np.int64), pa.int64()), listed(tf, pa.int32())],
        names=["block", "ids", "train", "ends", "tokens", "words", "tf"])


def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, train, text) -> blocks.  Their numbers hold the task's."""
    number = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []
    size = 0

    def flush() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        ids, train, texts = (whole.column(i).chunk(0) for i in range(3))
        return block_row(number, ids, train.to_numpy(zero_copy_only=False), texts)

    for b in batches:
        lengths = np.cumsum(pc.binary_length(b.column(2)).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            done = lengths[at - 1] if at else 0
            to = min(b.num_rows, int(np.searchsorted(lengths, done + BLOCK - size)) + 1)
            held.append(b.slice(at, to - at))
            size += lengths[to - 1] - done
            at = to
            if size >= BLOCK:
                yield flush()
                held, size, number = [], 0, number + 1
    if held:
        yield flush()


class Vocabulary:
    """Leaves of words, given the most frequent ones (hash, count; in order) and
    the token counts of the shared leaves."""

    def __init__(self, frequent: list[tuple[int, int]], shared: dict[tuple[int, int], tuple[int, int]]):
        self.top = np.array([h for h, _ in frequent], np.int64).view(np.uint64)
        self.by_hash = np.argsort(self.top)
        mass = np.zeros(maxent.CLASSES * maxent.MEMBERS, np.int64)
        for (band, share), (count, _) in shared.items():
            mass[maxent.FREQUENT + 1 + min(band, maxent.BANDS - 1) * maxent.SHARES + share] += count
        counts = np.array([c for _, c in frequent], np.int64)
        if len(counts):
            np.subtract.at(mass, maxent.shared_leaf(counts, self.top), counts)
        mass[:len(counts)] = counts
        self.mass = mass.astype(np.float64)
        singles = sum(n for (band, _), (_, n) in shared.items() if band == 0)
        self.mass[maxent.UNKNOWN] = (singles + 1) / 2
        self.tokens = sum(c for c, _ in shared.values())
        self.types = sum(n for _, n in shared.values())

    def leaves(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's leaf and the log of its share in it."""
        leaf = np.full(len(words), maxent.UNKNOWN, np.int32)
        log_share = np.zeros(len(words))
        known = np.flatnonzero(counts > 0)
        leaf[known] = maxent.shared_leaf(counts[known], words[known])
        if len(self.top):
            at = np.minimum(np.searchsorted(self.top, words, sorter=self.by_hash), len(self.top) - 1)
            own = (self.top[self.by_hash[at]] == words) & (counts > 0)
            leaf[own] = self.by_hash[at[own]]
        log_share[known] = np.log(counts[known] / self.mass[leaf[known]])
        return leaf, log_share


class Block:
    """One row of the table of counted blocks."""

    def __init__(self, row: dict):
        self.ends, self.train = np.array(row["ends"], np.int64), np.array(row["train"], bool)
        self.words = np.frombuffer(row["words"], np.uint64)
        n = len(self.words)
        self.counts = unpack(row["counts"], n, np.int64)
        self.token = unpack(row["tokens"], int(self.ends[-1]), np.uint32)
        self.lengths = np.diff(self.ends, prepend=0)
        self.place = np.arange(len(self.token)) - np.repeat(self.ends - self.lengths, self.lengths)

    def strange(self) -> np.ndarray:
        """Words that histories don't name: unknown ones, and half of those that occur once."""
        return (self.counts == 0) | ((self.counts == 1) & (self.words & np.uint64(1) == 1))

    def keys(self) -> np.ndarray:
        return np.where(self.strange(), maxent.STRANGE, self.words)

    def learn(self, vocabulary: Vocabulary, learner: maxent.Learner) -> None:
        chosen = np.repeat(self.train, self.lengths)
        token, place = self.token[chosen], self.place[chosen]
        leaf = np.where(self.strange(), maxent.UNKNOWN, vocabulary.leaves(self.words, self.counts)[0])
        keys = self.keys()[token]
        for at in range(0, len(token), maxent.BATCH):
            to = min(at + maxent.BATCH, len(token))
            learner.step(maxent.histories(keys, place, at, to), leaf[token[at:to]])

    def scores(self, vocabulary: Vocabulary, model: maxent.MaxEnt) -> tuple[np.ndarray, ...]:
        """Of each text: tokens, known tokens, base score, score."""
        leaf, log_share = vocabulary.leaves(self.words, self.counts)
        base = np.log10((self.counts + 1) / (vocabulary.tokens + (vocabulary.types + 1)))
        keys = self.keys()[self.token]
        logs = np.empty(len(self.token))
        for at in range(0, len(logs), maxent.BATCH):
            to = min(at + maxent.BATCH, len(logs))
            logs[at:to] = model.score(maxent.histories(keys, self.place, at, to), leaf[self.token[at:to]])
        logs += log_share[self.token]
        starts = self.ends - self.lengths
        total = lambda x: np.add.reduceat(x, starts)
        return self.lengths, total((self.counts > 0)[self.token].astype(np.int64)), total(base[self.token]), total(logs) / np.log(10)


def counted_blocks(docs: DataFrame, rounds: int) -> tuple[str, Vocabulary]:
    """The folder of the table of blocks with counts, by slice, and the vocabulary."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block long, ids array<{kind}>, train array<boolean>, ends array<long>, tokens binary, words array<long>, tf array<int>"
    raw, done = scratch_folder(docs, "lm-blocks"), scratch_folder(docs, "lm-counted")
    docs.mapInArrow(to_blocks, schema).write.parquet(raw)
    blocks = docs.sparkSession.read.schema(schema).parquet(raw)

    words = blocks.select("block", F.posexplode("words").alias("at", "word"))
    found = blocks.select(F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("tf").alias("tf")))).where("tf > 0")
    counts = cut(found.groupBy("word").agg(F.sum("tf").alias("n")))
    frequent = counts.orderBy(F.col("n").desc(), "word").limit(maxent.FREQUENT).collect()
    shared = counts.groupBy((F.length(F.bin("n")) - 1).alias("band"), F.shiftrightunsigned("word", 61).alias("share")).agg(
        F.sum("n").alias("n"), F.count("*").alias("types")).collect()             # at most 63 * 8 rows
    vocabulary = Vocabulary([(r.word, r.n) for r in frequent], {(r.band, r.share): (r.n, r.types) for r in shared})

    def with_counts(block: pa.Table, found: pa.Table) -> pa.Table:
        hashes = block.column("words").chunk(0)[0].values.to_numpy()
        number = block.column("block")[0].as_py()
        n = np.zeros(len(hashes), np.int64)
        n[found.column("at").to_numpy()] = found.column("n").to_numpy()
        return pa.table({"slice": pa.array([(number ^ number >> 32) % rounds], pa.int32()), "ids": block.column("ids"), "train": block.column("train"),
                         "ends": block.column("ends"), "tokens": block.column("tokens"), "words": pa.array([hashes.tobytes()], pa.binary()),
                         "counts": pa.array([pack(n)], pa.binary())})

    own = words.join(counts, "word").select(F.col("block").alias("of"), "at", "n")
    out = blocks.groupBy("block").cogroup(own.groupBy("of")).applyInArrow(
        with_counts, f"slice int, ids array<{kind}>, train array<boolean>, ends array<long>, tokens binary, words binary, counts binary")
    out.write.partitionBy("slice").parquet(done)
    return done, vocabulary


COLUMNS = ("train", "ends", "tokens", "words", "counts")


def block_of(batch: pa.RecordBatch, i: int) -> Block:
    return Block({c: batch.column(c)[i].as_py() for c in COLUMNS})


def trained(blocks: DataFrame, vocabulary: Vocabulary, rounds: int, tasks: int, rate: float, start: float) -> maxent.MaxEnt:
    """Weights after ``rounds`` of distributed steps, each over its own slice."""
    model = maxent.MaxEnt(vocabulary.mass)
    context = blocks.sparkSession.sparkContext
    for r in range(rounds):
        shared = context.broadcast((vocabulary, model.tables))

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, tables = shared.value
            learner = maxent.Learner(maxent.MaxEnt(vocabulary.mass, [t.copy() for t in tables]), rate / (1 + r), start)
            for b in batches:
                for i in range(b.num_rows):
                    block_of(b, i).learn(vocabulary, learner)
            for level, (new, old, n) in enumerate(zip(learner.model.tables, tables, learner.touched, strict=True)):
                changed = [k for k in range(0, len(n), STRIPE) if n[k:k + STRIPE].any()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([level] * len(changed), pa.int32()), pa.array(changed, pa.int32()),
                     pa.array([((new - old)[k:k + STRIPE]).astype(np.float16).tobytes() for k in changed], pa.binary()),
                     pa.array([n[k:k + STRIPE].tobytes() for k in changed], pa.binary())], names=["level", "row", "change", "n"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], list[np.ndarray]] = {}
            for b in batches:
                for level, row, change, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    times = np.frombuffer(n, np.float32).astype(np.float64)[:, None]
                    part = np.frombuffer(change, np.float16).reshape(len(times), -1) * times
                    if (level, row) in sums:
                        sums[level, row][0] += part
                        sums[level, row][1] += times
                    else:
                        sums[level, row] = [part, times]
            if sums:
                keys = list(sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
                     pa.array([(sums[k][0] / np.maximum(sums[k][1], 1)).astype(np.float32).tobytes() for k in keys], pa.binary())],
                    names=["level", "row", "change"])

        changes = blocks.where(F.col("slice") == r).select(*COLUMNS).coalesce(tasks).mapInArrow(
            learn, "level int, row int, change binary, n binary")
        for c in changes.repartition("level", "row").mapInArrow(add, "level int, row int, change binary").collect():
            table = model.tables[c.level]
            part = np.frombuffer(c.change, np.float32).reshape(-1, table.shape[1])
            table[c.row:c.row + len(part)] += part
        shared.unpersist()
    return model


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", learn_from=None, rounds: int = 3,
          rate: float = 0.2, start: float = 1.0) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score.

    ``learn_from``: a condition on the id column, the rows to learn from (not
    ``held_out`` ones when left out).  Defined cases: a null or empty text is
    its end token alone; a null id is not held out; rows that repeat an id are
    learned and scored each for itself; without training text every token is
    the unknown one, whose probability is 1 (scores are 0, but for rounding); an empty table
    gives an empty result; a very long text is a block of its own, learned and
    scored whole, ``maxent.BATCH`` tokens at a time.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    out_of = held_out(F.col("doc_id")) if learn_from is None else ~learn_from(F.col("doc_id"))
    text = F.coalesce(F.col("text"), F.lit(""))
    folder, vocabulary = counted_blocks(rows.select("doc_id", (~out_of).alias("train"), text.alias("text")), rounds)
    kind = rows.schema["doc_id"].dataType.simpleString()
    blocks = docs.sparkSession.read.schema(
        f"ids array<{kind}>, train array<boolean>, ends array<long>, tokens binary, words binary, counts binary, slice int").parquet(folder)
    size = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0
    model = trained(blocks, vocabulary, rounds, max(1, -(-size // (rounds * TASK))), rate, start)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, model.tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, tables = shared.value
        model = maxent.MaxEnt(vocabulary.mass, tables)
        for b in batches:
            for i in range(b.num_rows):
                block = block_of(b, i)
                n, known, base, full = block.scores(vocabulary, model)
                yield pa.RecordBatch.from_arrays(
                    [b.column("ids")[i].values, pa.array(~block.train), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                     pa.array(base), pa.array(full)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    scored = blocks.select("ids", *COLUMNS).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(vocabulary.tokens).cast("long"))
