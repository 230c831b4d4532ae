"""Mixing sources to target weights by Sainte-Lague apportionment (native).

Sizes are words.  Targets: the sources' weights share ``ratio`` times all
words, a source stops at ``max_repeat`` times its own size and the excess is
shared again by weight (water filling, solved in closed form over the source
table).  The mix is dealt in equal-token blocks:

1. blocks go to sources by highest quotients target / (2k + 1);
2. a source's blocks go to its shards the same way, by shard size;
3. in a shard the documents stand in a seeded order, and the quota is a seeded
   run of consecutive blocks, starting over at the end: documents whole
   passes cover are taken again, never more than ``max_repeat`` times.

The run is computed from running sums, so no block is ever a row.  A source is
cut into about sqrt(documents) shards of sqrt(documents) documents: no window
holds more of a hot source than that.  Only the table of sources (one row per
source) is ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourcinglens.llm.common import WORD, cut, pick, spread_join

SOURCE = ["source_null", "source_key"]


def apportion(parts: DataFrame, within: list[str], votes: str, seats: str, ties: list[str]) -> DataFrame:
    """Adds ``quota``: ``seats`` (one value per group ``within``) dealt to rows
    by highest quotients votes / (2k + 1), ties by the columns ``ties``.

    Rounding votes / (total / seats) takes every quotient above one threshold;
    only the seats that differ from the total are then ranked.  A row's part
    of those is bounded by its share, so few candidates are made.
    """
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    v = F.col(votes).cast("double")
    total = F.sum(v).over(group)
    base = parts.withColumns({"_share": F.when(total > 0, v / total).otherwise(F.lit(0.0))})
    base = base.withColumn("_q", F.floor(F.col("_share") * F.col(seats) + 0.5).cast("long"))
    base = base.withColumns({"_off": F.col(seats) - F.sum("_q").over(group), "_rows": F.count("*").over(group)})
    base = base.withColumn("_off", F.when(total > 0, F.col("_off")).otherwise(F.lit(0)))
    room = F.ceil(F.col("_share") * (F.abs("_off") + F.col("_rows"))).cast("int") + 1
    step = F.explode(F.sequence(F.lit(0), room - 1)).alias("_j")
    key = within + ties
    candidates = base.where("_off <> 0 AND _share > 0").select(*key, "_off", "_q", F.col(votes).cast("double").alias("_v"), step)
    candidates = candidates.where("_off > 0 OR _q > _j").withColumn(
        "_quotient", F.when(F.col("_off") > 0, F.col("_v") / (2 * (F.col("_q") + F.col("_j")) + 1))
        .otherwise(-F.col("_v") / (2 * (F.col("_q") - F.col("_j")) - 1)))
    rank = F.row_number().over(group.orderBy(F.desc("_quotient"), *ties, "_j"))
    moved = (candidates.withColumn("_rank", rank).where("_rank <= abs(_off)")
             .groupBy(*key).agg(F.sum(F.signum("_off")).cast("long").alias("_moved")))
    return (base.join(moved, key, "left")
            .withColumn("quota", F.col("_q") + F.coalesce("_moved", F.lit(0)))
            .drop("_share", "_q", "_off", "_rows", "_moved"))


def source_targets(sources: DataFrame, weights: tuple[int, ...], ratio: float, max_repeat: int) -> DataFrame:
    """Adds ``target`` to the source table (source_null, source_key, source_size)."""
    everything, order = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(*SOURCE)
    rank = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    t = sources.withColumn("weight", weight).withColumns({
        "_cap": F.col("source_size").cast("double") * max_repeat,
        "_all": F.sum("source_size").over(everything).cast("double") * ratio})
    t = t.withColumn("_fill", F.col("_cap") / F.col("weight"))
    upto = Window.partitionBy(F.lit(0)).orderBy("_fill", *SOURCE)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({"_caps": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
                       "_rest": F.sum("weight").over(upto.rowsBetween(0, Window.unboundedFollowing))})
    t = t.withColumn("_full", F.col("_caps") + F.col("_fill") * F.col("_rest") <= F.col("_all"))
    spent = F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("weight"))).over(everything)
    t = t.withColumns({"_spent": spent, "_open": open_weight})
    level = (F.col("_all") - F.col("_spent")) / F.col("_open") * F.col("weight")
    return (t.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.least(level, F.col("_cap"))))
            .drop("_cap", "_all", "_fill", "_caps", "_rest", "_full", "_spent", "_open"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (3, 1, 2), ratio: float = 1.5, max_repeat: int = 2, block: int = 16,
        seed: int = 17) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken.

    Defined cases: a null text has size 0 and takes 0; a null source is one
    source, last in order; rows that repeat an id are taken each for itself;
    an empty table gives an empty result.  Equal input and seed, equal mix.
    """
    sizes = cut(pick(docs, doc_id=id_col, text=text_col, source=source_col).select(
        "doc_id", F.col("source").isNull().alias("source_null"), F.coalesce("source", F.lit("")).alias("source_key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))

    sources = sizes.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = source_targets(sources, weights, ratio, max_repeat)
    blocks = F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block).cast("long")
    sources = cut(apportion(sources.withColumn("_blocks", blocks), [], "target", "_blocks", SOURCE)
                  .withColumnRenamed("quota", "source_quota").drop("_blocks"))

    n_shards = F.greatest(F.lit(1), F.floor(F.sqrt("n_docs"))).cast("long")
    dealt = spread_join(sizes, sources.select(*SOURCE, n_shards.alias("n_shards")), SOURCE, "doc_id").withColumn(
        "shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("n_shards"))).drop("n_shards")
    shards = dealt.groupBy(*SOURCE, "shard").agg(F.sum("size").alias("shard_size"))
    shards = apportion(shards.join(sources, SOURCE), SOURCE, "shard_size", "source_quota", ["shard"])
    size = F.col("shard_size")
    amount = F.least(F.col("quota") * block, size * max_repeat)
    start = F.pmod(F.xxhash64(*SOURCE, "shard", F.lit(seed)), F.greatest(F.lit(1), F.ceil(size / block))) * block
    shards = shards.select(
        *SOURCE, "shard", "source_size", "target", "shard_size",
        F.when(size > 0, F.floor(amount / size)).otherwise(0).cast("long").alias("passes"),
        F.when(size > 0, amount % size).otherwise(0).alias("rest"), start.alias("start"))

    seeded = Window.partitionBy(*SOURCE, "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "size")
    placed = dealt.withColumn("to", F.sum("size").over(seeded.rowsBetween(Window.unboundedPreceding, 0))).join(
        shards, SOURCE + ["shard"])

    def overlap(low, high):
        return F.greatest(F.lit(0), F.least(F.col("to"), high) - F.greatest(F.col("to") - F.col("size"), low))

    run_end = F.col("start") + F.col("rest")
    taken = (F.col("passes") * F.col("size") + overlap(F.col("start"), run_end)
             + overlap(F.col("start") - F.col("shard_size"), run_end - F.col("shard_size")))
    return placed.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target",
                         taken.cast("long").alias("taken"))


def copies(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix as rows: the columns of ``docs``, each document 0, 1 or
    ``max_repeat`` times.  The run of a shard takes nearly every document in
    whole passes; the one or two at its ends are rounded.  Rows that share an
    id are taken alike, as often as the most taken of them."""
    taken = mix(docs, id_col=id_col, **options)
    times = taken.where("taken > 0").groupBy("doc_id").agg(
        F.max(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int").alias("_times")).where("_times > 0")
    names = docs.columns
    flat = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    joined = flat.join(times.hint("shuffle_hash"), F.col(f"_c{names.index(id_col)}").eqNullSafe(F.col("doc_id")))
    repeated = joined.withColumn("_time", F.explode(F.array_repeat(F.lit(0), F.col("_times"))))
    return repeated.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)])
