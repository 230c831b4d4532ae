"""Ranking, sort, limit and sample operators (W1-W8) and rank helpers.

Top-k per group uses ``row_number() <= k``: Spark plans a WindowGroupLimit
below the shuffle, so even a hot group is cut to k rows per partition before
it moves.  Full per-group numbering of possibly hot groups (chunks, ranks of
long lists) uses ``group_row_number``: range partitions cut a hot group into
stretches, and the counts of earlier stretches make the numbers exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcinglens.session import cut_lineage

def _sorted_by(order: Sequence[str]) -> list[Column]:
    return [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order]


def group_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn") -> DataFrame:
    """Exact 1-based row numbers per group of ``keys`` in ``order`` ("-name":
    descending; a total order inside each group), without one task per group.

    The rows are range-partitioned by keys and order and checkpointed once, so
    a partition is a stretch of the ordered list and its number never changes
    afterwards.  Rows are numbered inside their (group, partition); the counts
    of a group's earlier partitions, a small aggregate, are added.  Any
    boundaries give the same numbers.
    """
    ranged = cut_lineage(df.repartitionByRange(*_sorted_by([*keys, *order])))
    numbered = ranged.withColumn("_bucket", F.spark_partition_id())
    counts = numbered.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"),
                            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*_sorted_by(order)))
    same = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = numbered.withColumn("_local", local).join(offsets, same)
    return out.withColumn(name, F.col("_off") + F.col("_local")).drop(
        "_bucket", "_local", "_b", "_off", *[f"_k{i}" for i in range(len(keys))])


def global_rank(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """Exact 1-based position in a total order over the whole DataFrame, by the
    same buckets (their offsets are the only rows seen as a whole)."""
    return group_row_number(df.withColumn("_all", F.lit(0)), ["_all"], order, name).drop("_all")


def keep_matches(scores: DataFrame, partition: Sequence[str], score: str = "score", tie: str = "code",
                 min_similarity: float = 0.5, min_codes: int = 1, max_codes: int = 10) -> DataFrame:
    """Per partition keep rank < min_codes OR score > min_similarity, then
    the first max_codes (ranked by score desc, then ``tie``).

    The kept rows always form a prefix of the ranking, so this is a top-k
    filter (WindowGroupLimit) with a residual predicate.
    """
    w = Window.partitionBy(*partition).orderBy(F.col(score).desc(), F.col(tie))
    ranked = scores.withColumn("rank", F.row_number().over(w))
    return ranked.where((F.col("rank") <= max_codes)
                        & ((F.col("rank") <= min_codes) | (F.col(score) > min_similarity)))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key by ascending ``order`` (deterministic).

    A hash aggregate with ``min_by``: map-side partial aggregation keeps one
    row per key per partition, so hot keys never gather in one task.
    """
    others = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_r"))
    return packed.select(*keys, *[F.col("_r")[c].alias(c) for c in others])


def cap_pages(pages: DataFrame, key: Sequence[str], url: str = "url", max_pages: int = 7,
              seed: int = 42) -> DataFrame:
    """At most ``max_pages`` pseudo-random pages per key (reproducible:
    ordered by the MD5 of url and seed); no cap when max_pages <= 0."""
    if max_pages <= 0:
        return pages
    w = Window.partitionBy(*key).orderBy(F.md5(F.concat(F.col(url), F.lit(f"|{seed}"))), F.col(url))
    return pages.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_pages).drop("_r")


def rank_suppliers(scores: DataFrame, partition: Sequence[str], relevance: str = "relevance",
                   tie: Sequence[str] = ("position",), name: str = "rank") -> DataFrame:
    """Rank by relevance descending, stable on ``tie``; rows without text
    carry -1 and therefore rank last.  Exact per-request numbering that also
    holds for very long short lists.  The scores are written once: choosing
    the ranges reads them as often as giving the numbers."""
    scores = cut_lineage(scores)
    return group_row_number(scores, partition, [f"-{relevance}", *tie], name)


def top_links(hits: DataFrame, key: Sequence[str], order: Sequence[str] = ("pos",), n: int = 1) -> DataFrame:
    """First ``n`` rows per key in result order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return hits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def sample_records(df: DataFrame, n: int, seed: int = 42, where: Column | None = None,
                   id_col: str = "_id") -> DataFrame:
    """``n`` pseudo-random records (order of the MD5 of id and seed; reproducible),
    optionally filtered.  Planned as TakeOrderedAndProject (top-n per task)."""
    src = df if where is None else df.where(where)
    return src.orderBy(F.md5(F.concat(F.col(id_col), F.lit(f"|{seed}"))), F.col(id_col)).limit(n)


def chunk(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int,
          name: str = "chunk") -> DataFrame:
    """Split each ordered list into consecutive groups of ``n`` (0-based)."""
    numbered = group_row_number(df, keys, order, "_rn")
    return numbered.withColumn(name, F.floor((F.col("_rn") - 1) / n).cast("int")).drop("_rn")


# Fixed values of the result pager: 49 results per page, the second page
# starts at offset 11 (10 + 1), no new page once 1,000 results are passed.
PAGE_SIZE = 49
SECOND_PAGE_START = 11
RESULT_STOP = 1000


def max_result_pages(size: int = PAGE_SIZE, stop: int = RESULT_STOP) -> int:
    """Number of pages the pager fetches: it starts page k while (k-1)*size < stop."""
    k = 0
    while k * size < stop:
        k += 1
    return k


def page_start(page: int, size: int = PAGE_SIZE) -> int:
    """1-based offset of the first result on ``page``."""
    return 1 if page <= 1 else SECOND_PAGE_START + (page - 2) * size


def last_position(size: int = PAGE_SIZE) -> int:
    """The last result that the pager returns; a list may be cut after it."""
    return page_start(max_result_pages(size) + 1, size) - 1


def page_of_results(hits: DataFrame, pos: str = "pos", size: int = PAGE_SIZE) -> DataFrame:
    """Every (hit, page) pair the pager returns a hit on (pages overlap:
    page 1 holds 1..size, page k>1 holds 11+(k-2)*size .. 10+(k-1)*size)."""
    p = F.col(pos)
    last = max_result_pages(size)
    later = (F.floor((p - SECOND_PAGE_START) / size) + 2).cast("int")
    pages = F.array_compact(F.array(
        F.when(p <= size, F.lit(1)),
        F.when((p >= SECOND_PAGE_START) & (later <= last), later)))
    return hits.withColumn("page", F.explode(pages))
