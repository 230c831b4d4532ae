"""Byte-level BPE encoding and decoding by DuckDB recursive queries.

Each Python worker holds one in-memory DuckDB with the merge table of a rank
file: (left token, right token) -> token of the joined bytes, whose id is the
rank.  The distinct pieces of a partition become token-position rows; the
recursive query joins neighbours with the merge table and contracts, in every
piece, the leftmost pair of minimum rank, until no pair is left.  Decoding
joins the ids with the vocabulary and puts the bytes together by an ordered
aggregation.

A piece that is a token by itself is that token.  Pieces longer than
``LONG`` bytes, where the recursion would be quadratic, take the same merges
from a heap instead (the same result).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcinglens.llm.chunks import ChunkCache, Recent
from sourcinglens.llm.common import pick

LONG = 1024                   # bytes of a piece
AT_ONCE = 2_000_000           # rows that the steps of one recursive query may add up to
CACHED = 160_000_000          # bytes of each cache of a worker
TOGETHER = 4_000_000          # characters of text whose new pieces share their queries: each query has a fixed cost

# Rows know their right neighbour (npos, ntok), so a step needs no sorting: the
# best pair of a word changes its left row, the row before it and no other.
# A word's rows are copied once more, not live, when none of its pairs merges.
CONTRACT = """
WITH RECURSIVE t AS (
  SELECT w, pos, tok, npos, ntok, true AS live FROM token_rows
  UNION ALL
  (WITH pairs AS (SELECT t.w, t.npos, m.tok::BIGINT * 1048576 + t.pos AS score
                  FROM t JOIN merges m ON m.l = t.tok AND m.r = t.ntok WHERE t.live),
   best AS (SELECT w, min(score) % 1048576 AS left_pos, (min(score) // 1048576)::INTEGER AS merged, arg_min(npos, score) AS gone
            FROM pairs GROUP BY w),
   now AS (SELECT t.w, t.pos, t.tok, t.npos, t.ntok, best.left_pos, best.merged, best.gone
           FROM t LEFT JOIN best ON best.w = t.w WHERE t.live),
   beyond AS (SELECT w, npos, ntok FROM now WHERE pos = gone)
   SELECT now.w, now.pos, CASE WHEN now.pos = left_pos THEN merged ELSE now.tok END,
          CASE WHEN now.pos = left_pos THEN beyond.npos ELSE now.npos END,
          CASE WHEN now.pos = left_pos THEN beyond.ntok WHEN now.npos = left_pos THEN merged ELSE now.ntok END, gone IS NOT NULL
   FROM now LEFT JOIN beyond ON beyond.w = now.w AND now.pos = left_pos WHERE gone IS NULL OR now.pos <> gone))
SELECT w, pos, tok FROM t WHERE NOT live"""

DECODE = """
SELECT string_agg(v.hex, '' ORDER BY i.pos) AS hex
FROM id_rows i JOIN vocabulary v ON v.tok = i.tok GROUP BY i.w ORDER BY i.w"""


def _bytes(key: bytes | str) -> int:
    """What a cache entry of this key takes at most: objects, ids, bytes."""
    return 250 + 8 * len(key)


class Bpe:
    """Encoder and decoder of one rank file (base64 token, space, rank)."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        rows = [(a, b, r) for t, r in self.ranks.items() for i in range(1, len(t))
                if (a := self.ranks.get(t[:i])) is not None and (b := self.ranks.get(t[i:])) is not None]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        self._table("merges", dict(zip(("l", "r", "tok"), np.array(rows, np.int32).T, strict=True)))
        self._table("vocabulary", {"tok": np.array(list(self.ranks.values()), np.int32), "hex": [t.hex() for t in self.ranks]})
        self.pieces = Recent(self._pieces, CACHED, _bytes)
        self.cache = ChunkCache(self._chunks, CACHED, _bytes)

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("_new", pa.table({k: pa.array(v) for k, v in columns.items()}))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM _new")
        self.db.unregister("_new")

    def _ask(self, name: str, rows: dict | pa.Table, sql: str) -> pa.Table:
        self.db.register(name, rows if isinstance(rows, pa.Table) else pa.table({k: pa.array(v) for k, v in rows.items()}))
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(name)

    def _contract(self, pieces: list[bytes]) -> pa.Table:
        """Final rows (w, pos, tok) of the pieces, w their number."""
        lengths = np.array([len(p) for p in pieces])
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(pieces), np.uint8)
        pos = (np.arange(len(data)) - np.repeat(starts, lengths)).astype(np.int32)
        tok = self.of_byte[data]
        right = np.append(tok[1:], np.int32(-1))
        right[starts + lengths - 1] = -1
        return self._ask("token_rows", {"w": np.repeat(np.arange(len(pieces), dtype=np.int32), lengths), "pos": pos, "tok": tok,
                                        "npos": pos + 1, "ntok": right}, CONTRACT)

    def _heap(self, piece: bytes) -> list[int]:
        """The same merges for one long piece, neighbours as linked positions."""
        n = len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := self.ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (r := self.ranks.get(piece[i:end[j]])) is not None:
                heapq.heappush(heap, (r, i, j, end[j]))

        while heap:
            _, i, j, to = heapq.heappop(heap)
            if end[i] != j or j >= n or end[j] != to:
                continue
            end[i], end[j] = to, -1
            if to < n:
                before[to] = i
            offer(before[i], i)
            offer(i, to)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i:end[i]]])
            i = end[i]
        return out

    def decode(self, id_rows: pa.Table) -> list[tuple[str, bytes]]:
        """Of each number w (0, 1, ...): its ids, joined by commas, and their bytes."""
        hexes = self._ask("id_rows", id_rows, DECODE).column("hex").to_pylist()
        w, pos, tok = (id_rows.column(c).to_numpy() for c in ("w", "pos", "tok"))
        ids = pa.array(tok[np.lexsort((pos, w))]).cast(pa.string())
        lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(np.bincount(w))).astype(np.int32), ids)
        return [(f",{i}", bytes.fromhex(h)) for i, h in zip(pc.binary_join(lists, ",").to_pylist(), hexes, strict=True)]

    def _pieces(self, pieces: list[bytes]) -> list[tuple[str, bytes]]:
        """Of each piece: its ids as text (",1,2") and the bytes they decode to."""
        found: dict[bytes, tuple[str, bytes]] = {}
        ready, groups, size = [], [[]], 0
        for p in pieces:
            if p in self.ranks or len(p) > LONG:
                ready.append(p)
                continue
            if size >= AT_ONCE:
                groups.append([])
                size = 0
            groups[-1].append(p)
            size += len(p) * (len(p) + 1) // 2 + len(p)
        for g in groups:
            tables = [self._contract(g).select(["w", "pos", "tok"])] if g else []
            if ready:                                                           # decoded with the first group
                ids = [[self.ranks[p]] if p in self.ranks else self._heap(p) for p in ready]
                rows = [(w, pos, tok) for w, i in enumerate(ids, len(g)) for pos, tok in enumerate(i)]
                tables.append(pa.table(dict(zip(("w", "pos", "tok"), np.array(rows, np.int32).T, strict=True))))
            if tables:
                found.update(zip(g + ready, self.decode(pa.concat_tables(tables)), strict=True))
            ready = []
        return [found[p] for p in pieces]

    def _chunks(self, chunks: list[str]) -> list[tuple[str, bytes]]:
        split = [[p.encode() for p in self.pattern.findall(c)] for c in chunks]
        of = self.pieces.hold({p for s in split for p in s})
        return [of[s[0]] if len(s) == 1 else ("".join([of[p][0] for p in s]), b"".join([of[p][1] for p in s]))
                for s in split]

    def documents(self, texts: list[str]) -> Iterator[tuple[int, str, bytes]]:
        """Of each text: number of ids, ids joined by commas, decoded bytes."""
        for got in self.cache.answers(texts, TOGETHER):
            ids = "".join([g[0] for g in got])
            yield ids.count(","), ids[1:], b"".join([g[1] for g in got])


_OPEN: dict[tuple[str, str], Bpe] = {}


def engine(rank_file: str, pattern: str) -> Bpe:
    """One per worker process; later partitions in it reuse the tables."""
    if (rank_file, pattern) not in _OPEN:
        _OPEN[rank_file, pattern] = Bpe(rank_file, pattern)
    return _OPEN[rank_file, pattern]


def encode_decode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                  with_ids: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256
    (and, with ``with_ids``, token_ids and decoded text).

    The digests are those of the decimal ids joined by commas and of the
    decoded bytes.  Defined cases: a null or empty text has no ids; rows that
    repeat an id are encoded each for itself; special strings are plain text;
    an empty table gives an empty result.  ``rank_file`` must be readable at
    that path on every worker (an installed package).
    """
    base = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>, decoded string" * with_ids
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = engine(rank_file, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                rows = []
                for n, ids, raw in bpe.documents(part.column("text").to_pylist()):
                    row = (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest())
                    rows.append(row + ([int(i) for i in ids.split(",") if i], raw.decode("utf-8", "replace")) if with_ids else row)
                columns = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types[:len(columns)], strict=True)]],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids", "decoded"][:1 + len(columns)])

    return base.mapInArrow(run, f"doc_id {kind}, {schema}")
