"""Exact dedup by skew-safe combining (native).

Texts are equal when identical after lower-casing A-Z; null counts as empty.
Three stages, each comparing the full content, not only its digest:

1. local: the map side of the first aggregation collapses equal texts inside
   a task (grouping key: digest, salt and the text itself);
2. salted: the copies of one text meet in up to ``salts`` groups, spread by
   the row's id, so a text held by a third of all rows has no single reducer;
3. global: at most ``salts`` salt winners per text and map task are combined.

Rows find their winner the same way back: winner -> (digest, salt) -> row, so
no step joins a hot digest to all of its rows at once, and no text is shuffled
for it.  Should two different texts share a digest, stage 3 sees it (more than
one content per digest) and the rows of those digests are matched on the text
as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcinglens.llm.common import ascii_lower, cut, pick, spread_join


def _sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64,
                digest: Callable[[Column], Column] = _sha256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, twins
    (rows that repeat both id and text, itself included).

    Of equal texts the row with the largest id stays.  Defined cases: a null
    or empty text is the empty text; null ids never win over an id; rows that
    repeat both id and text count in group_size, one of them is kept; an empty
    table gives an empty result.  ``digest`` only routes rows: any function of
    the text is right, a better one is faster.
    """
    def rows() -> DataFrame:
        base = pick(docs, doc_id=id_col, text=text_col).select("doc_id", ascii_lower(F.col("text")).alias("norm"))
        return base.select("doc_id", "norm", digest(F.col("norm")).alias("digest"),
                           F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))

    sha = F.lower(F.hex("digest")) if digest is _sha256 else F.sha2(F.col("norm"), 256)
    keys = cut(rows().select("doc_id", "digest", "salt", sha.alias("text_sha256")) if digest is not _sha256
               else rows().select("doc_id", "digest", "salt"))

    salted = rows().groupBy("digest", "salt", "norm").agg(F.max("doc_id").alias("best"), F.count("*").alias("n"))
    winners = salted.groupBy("digest", "norm").agg(F.max("best").alias("keep_id"), F.sum("n").alias("group_size"))
    summary = cut(winners.groupBy("digest").agg(
        F.count("*").alias("contents"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")))

    matched = spread_join(keys, summary.where("contents = 1").drop("contents"), "digest", "doc_id", salts)
    clashing = summary.where("contents > 1").select("digest")
    if not clashing.isEmpty():
        texts = rows().join(clashing, "digest", "left_semi")
        exact = texts.join(winners.join(clashing, "digest", "left_semi"), ["digest", "norm"])
        cols = matched.columns
        matched = matched.unionByName(exact.withColumn("text_sha256", F.sha2(F.col("norm"), 256)).select(*cols))

    same = Window.partitionBy("digest", "salt", "doc_id")
    matched = matched.withColumns({"twin": F.row_number().over(same.orderBy(F.lit(0))), "twins": F.count("*").over(same)})
    out_sha = F.lower(F.hex("digest")) if digest is _sha256 else F.col("text_sha256")
    return matched.select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("twin") == 1)).alias("kept"),
        out_sha.alias("text_sha256"), "twins")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs``, the rows that stay: one of each group of equal
    texts.  Rows that repeat both id and text are told apart by a number, only
    where there are any."""
    kept = cut(exact_dedup(docs, id_col, text_col).where("kept").select("doc_id", "text_sha256", "twins"))
    names = docs.columns
    flat = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    doc_id, text = (F.col(f"_c{names.index(c)}") for c in (id_col, text_col))
    flat = flat.withColumn("_sha", F.sha2(ascii_lower(text), 256))
    key = doc_id.eqNullSafe(F.col("doc_id")) & (F.col("_sha") == F.col("text_sha256"))
    out = flat.join(kept.hint("shuffle_hash"), key, "left_semi")
    if not kept.where("twins > 1").isEmpty():
        twin = F.row_number().over(Window.partitionBy(doc_id, "_sha").orderBy(F.lit(0)))
        out = out.withColumn("_twin", twin).where("_twin = 1")
    return out.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)])
