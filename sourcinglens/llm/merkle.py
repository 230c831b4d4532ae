"""Merkle dataset manifest with persistent, path-copying versions.

One tree per part (source) over its rows in id order, 16 children a node, and
one tree over the parts' roots.  Positions come from a range-partitioned,
checkpointed order: the running number inside a partition plus the counts of a
part's earlier partitions, so no part is numbered by one task.

``levels`` (distributed) rolls nodes up, 16 at a time, until each tree has one.
An aligned block of 256 leaves (two levels) is rebuilt in one task as a
persistent tree: putting another leaf in makes a version that shares every
untouched node and copies only the leaf's ancestors.  A block knows the runs
above it (``paths``, one row per block), so each version goes on from its
block's copied root through the upper levels, in the task of its block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcinglens.llm.common import ascii_lower, cut, pick, spread_join

FAN = 16                      # children of a node
LOW = 2                       # levels of an aligned block
BLOCK = FAN ** LOW            # its leaves

STEP = "struct<before:string,after:string>"


def encoded(value: Column) -> Column:
    """`-` for null, else UTF-8 byte count, `:`, value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``pos``, the place of a row in its ``tree`` (from 0, in ``order``),
    and ``n``, the rows of the tree.  ``tree`` has no nulls."""
    ran = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ran = ran.withColumn("_at", F.monotonically_increasing_id())
    ran = cut(ran.withColumn("_part", F.shiftright("_at", 33)))
    counts = cut(ran.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")))
    earlier = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("tree", "_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
                            F.sum("_n").over(Window.partitionBy("tree")).alias("n"))
    return ran.join(offsets, ["tree", "_part"]).withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop(
        "_at", "_part", "_first", "_before")


def runs(nodes: DataFrame) -> DataFrame:
    """Nodes (tree, pos, n, digest) -> their runs of 16 (tree, run, n, digests)."""
    of = F.array_sort(F.collect_list(F.struct("pos", "digest")))
    return nodes.groupBy("tree", F.floor(F.col("pos") / FAN).alias("run")).agg(
        F.first("n").alias("n"), F.transform(of, lambda x: x["digest"]).alias("digests"))


def levels(leaves: DataFrame) -> list[DataFrame]:
    """Runs of each level, from the leaves (tree, pos, n, digest) up; the last
    entry has the roots (tree, digest).  A tree that is down to one node is
    left out of further runs."""
    out, nodes = [], leaves
    roots = nodes.where("n = 1").select("tree", "digest")
    while True:
        level = cut(runs(nodes.where("n > 1")))
        if level.isEmpty():
            return [*out, roots]
        out.append(level)
        nodes = level.select("tree", F.col("run").alias("pos"), F.ceil(F.col("n") / FAN).alias("n"),
                             F.sha2(F.array_join("digests", ""), 256).alias("digest"))
        roots = roots.unionByName(nodes.where("n = 1").select("tree", "digest"))


def paths(starts: DataFrame, above: list[DataFrame]) -> DataFrame:
    """Adds ``path`` to rows (tree, pos): what stands before and after the
    row's node in its run, level by level through ``above``."""
    out = starts.withColumns({"path": F.array().cast(f"array<{STEP}>"), "_at": F.col("pos")})
    for level in above:
        side = level.select("tree", F.col("run").alias("_run"), "digests")
        out = cut(out.withColumn("_run", F.floor(F.col("_at") / FAN)))
        own = F.pmod("_at", F.lit(FAN)).cast("int")
        step = F.struct(F.array_join(F.slice("digests", F.lit(1), own), "").alias("before"),
                        F.array_join(F.slice("digests", own + 2, F.lit(FAN)), "").alias("after"))
        out = spread_join(out, side, ["tree", "_run"], "pos", how="left").withColumns({
            "path": F.when(F.col("digests").isNull(), F.col("path")).otherwise(F.array_append("path", step)),
            "_at": F.col("_run")}).drop("digests", "_run")
    return out.drop("_at")


@dataclass(frozen=True, slots=True)
class Node:
    """A node of a persistent tree: never changed, shared by versions."""
    digest: str
    children: tuple = ()


def joined(children: tuple) -> Node:
    return Node(hashlib.sha256("".join([c.digest for c in children]).encode()).hexdigest(), children)


def grown(leaves: list[str], height: int) -> Node:
    """The tree of at most FAN ** height leaves."""
    nodes = [Node(d) for d in leaves]
    for _ in range(height):
        nodes = [joined(tuple(nodes[i:i + FAN])) for i in range(0, len(nodes), FAN)]
    return nodes[0]


def version(root: Node, at: int, leaf: str, height: int) -> list[Node]:
    """Nodes that a version with another leaf copies, the leaf first, its root last."""
    if not height:
        return [Node(leaf)]
    slot, rest = divmod(at, FAN ** (height - 1))
    below = version(root.children[slot], rest, leaf, height - 1)
    return [*below, joined((*root.children[:slot], below[-1], *root.children[slot + 1:]))]


def siblings(root: Node, at: int, height: int) -> list[str]:
    """Digests of the others in each run on the way from a leaf up to ``root``."""
    out: list[str] = []
    while height:
        slot, at = divmod(at, FAN ** (height - 1))
        out = [c.digest for i, c in enumerate(root.children) if i != slot] + out
        root, height = root.children[slot], height - 1
    return out


def height_of(n: int) -> int:
    """Levels of a block in a tree of n leaves."""
    return 0 if n == 1 else 1 if n <= FAN else LOW


def folded(rows: pa.Table, block: pa.Table) -> Iterator[tuple[str, str, list[str]]]:
    """Of each row of a block, in order: proof digest, root folded from its new
    leaf, and the nodes its version copies (leaf first)."""
    height = height_of(rows.column("n")[0].as_py())
    leaves = [x.hex() for x in rows.column("leaf").to_pylist()]
    root = grown(leaves, height)
    steps = [(s["before"], s["after"]) for s in block.column("path")[0].as_py()]
    above = "".join([b + a for b, a in steps])
    for at, new in enumerate(rows.column("fresh").to_pylist()):
        copied = [c.digest for c in version(root, at, leaves[at] if new is None else new.hex(), height)]
        for before, after in steps:
            copied.append(hashlib.sha256(f"{before}{copied[-1]}{after}".encode()).hexdigest())
        yield hashlib.sha256(("".join(siblings(root, at, height)) + above).encode()).hexdigest(), copied[-1], copied


def tampered(doc_id: Column) -> Column:
    """Where 5 divides the crc32 of the decimal id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tree_field: str = "source",
             order_field: str = "doc_id", text_field: str = "text", change=tampered, with_nodes: bool = False) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256,
    folded_root, verified (and, with ``with_nodes``, ``copied``: the digests of
    the nodes that the row's version copies, from its leaf to the root).

    A row's version has its text lower-cased (A-Z) where ``change`` holds for
    the row's id, and is the original elsewhere.  Defined cases: any field may be null; null ids come
    first, rows that repeat an id are ordered by their leaf; equal rows are
    leaves of their own, side by side; a null part is a part of its own, before
    the empty one; a part with one row has that leaf as its root; an empty
    table gives an empty result; very long texts are hashed whole, one at a
    time, and go no further than their digest; columns that aren't fields are
    ignored, whatever their names.
    """
    names = {f"f{i}": f for i, f in enumerate(fields)}
    of = {f: F.col(a) for a, f in names.items()}

    def digest(text: Column) -> Column:
        return F.unhex(F.sha2(F.concat(*[encoded(text if f == text_field else of[f]) for f in fields]), 256))

    lower = F.when(of[text_field].isNotNull(), ascii_lower(of[text_field]))
    rows = cut(pick(docs, **names).select(
        of[order_field].alias("doc_id"), F.coalesce(F.concat(F.lit("="), of[tree_field].cast("string")), F.lit("")).alias("tree"),
        digest(of[text_field]).alias("leaf"), F.when(change(of[order_field]), digest(lower)).alias("fresh"),
        F.monotonically_increasing_id().alias("_tie")))
    rows = cut(numbered(rows, ["doc_id", "leaf", "_tie"]).drop("_tie"))

    *up, roots = levels(rows.select("tree", "pos", "n", F.lower(F.hex("leaf")).alias("digest")))
    parts = cut(numbered(cut(roots.select(F.lit("").alias("tree"), F.col("tree").alias("part"), "digest")), ["part"]))
    *top, root = levels(parts)
    root = root.first()                                   # one digest
    ends = paths(parts, top).select(F.col("part").alias("tree"), F.col("digest").alias("subroot"), F.col("path").alias("_top"))
    blocks = rows.select("tree", F.floor(F.col("pos") / BLOCK).alias("pos")).distinct()
    own = spread_join(cut(paths(blocks, up[LOW:])), cut(ends), "tree", "pos").withColumn("path", F.concat("path", "_top")).drop("_top")
    own = own.select(*[F.col(a).alias(b) for a, b in (("tree", "of"), ("pos", "at"), ("path", "path"), ("subroot", "subroot"))])

    kind = rows.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(c, T.StringType()) for c in (
        "leaf", "subroot", "proof_sha256", "folded_root")], T.StructField("copied", T.ArrayType(T.StringType()))])

    def fold(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("pos")
        proofs, tops, copied = zip(*folded(left, right), strict=True)
        return pa.table([left.column("doc_id").combine_chunks(), pa.array([x.hex() for x in left.column("leaf").to_pylist()]),
                         pa.array([right.column("subroot")[0].as_py()] * left.num_rows), pa.array(proofs), pa.array(tops),
                         pa.array([c if with_nodes else None for c in copied], pa.list_(pa.string()))], names=schema.names)

    docs_side = rows.withColumn("block", F.floor(F.col("pos") / BLOCK)).groupBy("tree", "block")
    out = docs_side.cogroup(own.groupBy("of", "at")).applyInArrow(fold, schema)
    whole = F.lit(root.digest if root else None).cast("string")
    return out.select("doc_id", "leaf", "subroot", whole.alias("root"), "proof_sha256", "folded_root",
                      (F.col("folded_root") == whole).alias("verified"), *["copied"] * with_nodes)


def _oracle(low: int = 6, high: int = 4) -> str:
    """SQL for parts of up to 16 ** low rows and 16 ** high parts."""
    def climb(name: str, nodes: str, walkers: str, count: int) -> str:
        out = ""
        for k in range(count):
            below, up = (nodes, walkers) if k == 0 else (f"{name}n{k}", f"{name}p{k}")
            out += f"""
{name}r{k} AS (SELECT tree, pos // 16 AS run, any_value(n) AS n, list(digest ORDER BY pos) AS ds FROM {below} GROUP BY tree, pos // 16),
{name}n{k + 1} AS (SELECT tree, run AS pos, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS digest FROM {name}r{k}),
{name}p{k + 1} AS (SELECT p.* REPLACE (p.spot // 16 AS spot,
    CASE WHEN r.n = 1 THEN p.fold ELSE sha256(array_to_string(ds[1:p.spot % 16], '') || p.fold || array_to_string(ds[p.spot % 16 + 2:], '')) END AS fold,
    CASE WHEN r.n = 1 THEN p.sib ELSE p.sib || array_to_string(ds[1:p.spot % 16], '') || array_to_string(ds[p.spot % 16 + 2:], '') END AS sib)
  FROM {up} p JOIN {name}r{k} r ON r.tree = p.tree AND r.run = p.spot // 16),"""
        return out

    def h(text: str) -> str:
        one = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
        return "sha256(" + " || ".join(one.format(f) for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE tab(i, k, c) AS (SELECT i, 0, i::BIGINT FROM range(256) t(i) UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM tab WHERE k < 8),
crc(id, spot, c) AS (SELECT DISTINCT doc_id, 0, 4294967295::BIGINT FROM documents WHERE doc_id IS NOT NULL UNION ALL
  SELECT id, spot + 1, xor(t.c, crc.c >> 8) FROM crc JOIN tab t ON t.k = 8 AND t.i = xor(crc.c, ord((id::VARCHAR)[spot + 1])) & 255 WHERE spot < len(id::VARCHAR)),
bad AS (SELECT id FROM crc WHERE spot = len(id::VARCHAR) AND xor(c, 4294967295) % 5 = 0),
d AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {h('text')} AS leaf,
  CASE WHEN doc_id IN (SELECT id FROM bad) THEN {h(lower)} ELSE {h('text')} END AS fresh FROM documents),
leaves AS (SELECT *, leaf AS digest, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
walk AS (SELECT doc_id, tree, leaf, pos AS spot, fresh AS fold, '' AS sib FROM leaves),{climb('s', 'leaves', 'walk', low)}
parts AS (SELECT '' AS tree, tree AS part, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM sn{low}),
up AS (SELECT p.* REPLACE ('' AS tree, t.pos AS spot), t.digest AS subroot FROM sp{low} p JOIN parts t ON t.part = p.tree),{climb('t', 'parts', 'up', high)}
root AS (SELECT digest FROM tn{high})
SELECT doc_id, leaf, subroot, root.digest AS root, sha256(sib) AS proof_sha256, fold AS folded_root, fold = root.digest AS verified
FROM tp{high}, root"""


ORACLE = _oracle()
