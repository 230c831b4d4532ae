"""Substring dedup by repeated-phrase automata.

A window is ``window`` consecutive words of one document; a word goes when a
window that covers it also starts in a document with a smaller id.

1. Confirm recurring phrases.  Every window picks the phrase of ``phrase``
   words in it whose hash is smallest; equal windows pick equal phrases.  A
   phrase picked in two documents recurs.  About two phrases are picked per
   ``window - phrase + 2`` words, so this shuffles a few bytes per window.
2. Compile automata.  Documents are dealt to shards of about ``shard_bytes`` of
   text; the recurring phrases of a shard's documents become one Aho-Corasick
   automaton over word ids.  Shards grow in number with the corpus, never in
   size, and each document meets the one automaton that has all the phrases it
   can hold.
3. Stream all documents of the shard through it and locate every occurrence.
   Windows whose picked phrase was found are candidates; per shard one row per
   different window, with its smallest and largest id, is compared over all
   shards (96-bit digests of the window's words).
4. The windows that start in a smaller document somewhere go back to their
   shards, and the documents are cut.

Windows are judged on the input.  A document's text crosses the network once,
to its shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourcinglens.llm.common import cut, pick, spread_join
from sourcinglens.llm.shingles import Words, groups

NO_ID = (1 << 63) - 1         # a null id stands after all ids


def picks(w: Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows (as word numbers), the start of the phrase each
    one picks, and the hashes of the phrases from every word."""
    hashes = w.phrases(phrase)
    lengths = np.diff(w.first) - window + 1
    lengths = np.maximum(lengths, 0)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), hashes
    starts = np.arange(total) + np.repeat(w.first[:-1] - (np.cumsum(lengths) - lengths), lengths)
    span = window - phrase + 1
    best = np.lib.stride_tricks.sliding_window_view(hashes, span).argmin(1)
    return starts, starts + best[starts], hashes


def _per_word(w: Words, values: np.ndarray) -> np.ndarray:
    return np.repeat(values, np.diff(w.first))


def _picked(rows: DataFrame, window: int, phrase: int) -> DataFrame:
    """(phrase, rank, shard), once per document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank, shard = b.column("rank").to_numpy(), b.column("shard").to_numpy()
            for at, w in groups(b.column("text"), lower=False):
                doc = _per_word(w, np.arange(len(w.first) - 1))
                _, chosen, hashes = picks(w, window, phrase)
                chosen = np.unique(chosen)
                order = np.lexsort((hashes[chosen], doc[chosen]))
                h, d = hashes[chosen][order], doc[chosen][order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                h, d = h[new], d[new] + at
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(rank[d]), pa.array(shard[d])],
                                                 names=["phrase", "rank", "shard"])

    return rows.select("rank", "shard", "text").mapInArrow(run, "phrase long, rank long, shard int")


def automaton(w: Words, chosen: np.ndarray, hashes: np.ndarray, recurring: np.ndarray, phrase: int):
    """Automaton of the recurring phrases, as sequences of 32-bit word ids."""
    ids = (w.hash >> np.uint64(32)).astype(np.int64)
    at = np.unique(chosen)
    at = at[np.isin(hashes[at], recurring)]
    _, one = np.unique(hashes[at], return_index=True)
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for start in at[one].tolist():
        machine.add_word(tuple(ids[start:start + phrase].tolist()), phrase)
    machine.make_automaton()
    return machine, ids


def located(w: Words, machine, ids: np.ndarray) -> np.ndarray:
    """Whether a recurring phrase starts at a word, of any document."""
    found = np.zeros(len(ids) + 1, bool)
    if len(machine):
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            ends = [a + end + 1 - k for end, k in machine.iter(tuple(ids[a:b].tolist()))] if b > a else []
            found[ends] = True
    return found


def digests(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    return w.phrases(window).view(np.int64), (w.phrases(window, seed=0x5EED) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _bytes_of(texts: pa.ChunkedArray) -> Iterator[tuple[int, Words]]:
    one = texts.combine_chunks()
    if isinstance(one, pa.ChunkedArray):
        one = pa.concat_arrays(one.chunks) if one.num_chunks else pa.array([], pa.string())
    yield from groups(one, lower=False, size=1 << 23)


def _candidates(window: int, phrase: int):
    names = ["shard", "digest", "check", "low", "high"]

    def run(key, docs: pa.Table, phrases: pa.Table) -> pa.Table:
        recurring = phrases.column("phrase").to_numpy().view(np.uint64)
        out = []
        if len(recurring) and docs.num_rows:
            rank = docs.column("rank").to_numpy()
            for at, w in _bytes_of(docs.column("text")):
                starts, chosen, hashes = picks(w, window, phrase)
                if not len(starts):
                    continue
                machine, ids = automaton(w, chosen, hashes, recurring, phrase)
                starts = starts[located(w, machine, ids)[chosen]]
                d, c = digests(w, window)
                out.append((d[starts], c[starts], _per_word(w, rank[at:at + len(w.first) - 1])[starts]))
        d, c, r = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (
            np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))
        order = np.lexsort((c, d))
        d, c, r = d[order], c[order], r[order]
        new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (c[1:] != c[:-1])])) if len(d) else np.zeros(0, int)
        low = np.minimum.reduceat(r, new) if len(d) else r
        high = np.maximum.reduceat(r, new) if len(d) else r
        shard = np.full(len(new), key[0].as_py(), np.int32)
        return pa.table(dict(zip(names, [shard, d[new], c[new], low, high], strict=True)))

    return run


def _cut_documents(window: int, with_text: bool):
    def run(key, docs: pa.Table, seen: pa.Table) -> pa.Table:
        known, check, first = (seen.column(n).to_numpy() for n in ("digest", "check", "first_rank"))
        order = np.lexsort((check, known))
        known, check, first = known[order], check[order], first[order]
        rank = docs.column("rank").to_numpy()
        rows = []
        for at, w in _bytes_of(docs.column("text")) if docs.num_rows else ():
            covered = np.zeros(len(w.hash) + 1, np.int32)
            starts, _, _ = picks(w, window, 1) if len(known) else (np.zeros(0, np.int64), None, None)
            if len(starts):
                d, c = digests(w, window)
                low = np.searchsorted(known, d[starts])
                of = _per_word(w, rank[at:at + len(w.first) - 1])[starts]
                gone = np.zeros(len(starts), bool)
                step = 0
                while True:                                   # digests equal in 64 bits stand in a row
                    i = low + step
                    live = (i < len(known)) & (known[np.minimum(i, len(known) - 1)] == d[starts])
                    if not live.any():
                        break
                    i = np.minimum(i, len(known) - 1)
                    gone |= live & (check[i] == c[starts]) & (first[i] < of)
                    step += 1
                covered[starts[gone]] += 1                    # a window starts at a word once
                covered[starts[gone] + window] -= 1
            keep = np.cumsum(covered)[:-1] == 0
            raw, bounds = w.data.tobytes(), w.bounds.tolist()
            for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
                words = raw[bounds[i]:bounds[i + 1]].split()
                mask = keep[a:b]
                kept = int(mask.sum())
                text = b" ".join(words if kept == len(words) else compress(words, mask.tolist()))
                rows.append((len(words), len(words) - kept, hashlib.sha256(text).hexdigest(), text.decode() if with_text else None))
        n, gone, sha, text = zip(*rows, strict=True) if rows else ((), (), (), ())
        out = {"doc_id": docs.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()),
               "kept_sha256": pa.array(sha, pa.string())}
        return pa.table(out | ({"kept_text": pa.array(text, pa.string())} if with_text else {}))

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, phrase: int = 10,
                    shard_bytes: int = 4 << 20, with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (and the
    kept words, joined by one space, with ``with_text``).

    Defined cases: a null text has no words; a null id stands after all ids;
    rows that share an id are one document's, none is smaller than the other,
    and each is cut for itself; texts shorter than a window lose nothing; an
    empty table gives an empty result.  Ids are integers.
    """
    base = pick(docs, doc_id=id_col, text=text_col)
    kind = base.schema["doc_id"].dataType.simpleString()
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(total // shard_bytes + 1)
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = base.select("doc_id", rank.alias("rank"), F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "shard", F.pmod(F.xxhash64("rank"), F.lit(shards)).cast("int"))

    picked = cut(_picked(rows, window, phrase))
    recurring = picked.groupBy("phrase").agg(F.min("rank").alias("low"), F.max("rank").alias("high")).where("low < high")
    by_shard = spread_join(picked, recurring.select("phrase"), "phrase", "rank").select("shard", "phrase").distinct()

    texts = rows.select("shard", "doc_id", "rank", "text")
    found = texts.groupBy("shard").cogroup(by_shard.groupBy("shard")).applyInArrow(
        _candidates(window, phrase), "shard int, digest long, check int, low long, high long")
    first = F.min("low").over(Window.partitionBy("digest", "check"))
    seen = found.withColumn("first_rank", first).where("high > first_rank").select("shard", "digest", "check", "first_rank")
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return texts.groupBy("shard").cogroup(seen.groupBy("shard")).applyInArrow(_cut_documents(window, with_text), schema)
