"""Filter interaction audit by recursive CTE enumeration.

Every document has a mask: one bit per filter that it fails.  Masks, not
documents, are what orders of filters act on, so the table is first counted
into cells (part, mask).  A recursive query then extends filter prefixes by
each letter they lack: it starts with the empty prefix and all masks, carries
the bits applied so far, and each level emits what its step does to each mask
(kept, removed, redundant, failing this filter only).  That is a fixed table
of 326 prefixes times 32 masks, whatever the input; its rows are joined with
the cells by mask and added up per part.  A permutation's step k is its prefix
of length k.
"""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcinglens.llm.common import WORD_GAP, cut, pick, spread_join

#: The filters, in bit order.
LETTERS = "ABCDE"

WALK = """
WITH RECURSIVE walk(prefix, step, letter, applied, mask, kept, removed, redundant, alone) AS (
  SELECT '', 0, '', 0, CAST(id AS INT), true, false, false, false FROM range({masks})
  UNION ALL
  SELECT concat(prefix, next.letter), step + 1, next.letter, applied | next.bit, mask,
         mask & (applied | next.bit) = 0,
         mask & applied = 0 AND mask & next.bit <> 0,
         mask & applied <> 0 AND mask & next.bit <> 0,
         mask = next.bit
  FROM (SELECT *, explode(filter({filters}, f -> applied & f.bit = 0)) AS next FROM walk WHERE step < {steps}))
SELECT * FROM walk WHERE step > 0"""


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, WORD_GAP), "")
    size = F.get(F.transform(F.array(words), lambda w: F.struct(
        F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"))), F.lit(0))
    chars = F.length(text)
    capitals = chars - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    bits = F.get(F.transform(F.array(size), lambda s: F.when(s["n"] < 200, 1).otherwise(0)
                             + F.when(100 * s["distinct"] < 50 * s["n"], 2).otherwise(0)), F.lit(0))
    return (bits + F.when(100 * capitals > 2 * chars, 4).otherwise(0) + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)).cast("int")


def walk(spark: SparkSession) -> DataFrame:
    """What each step of each filter prefix does to each mask: (prefix, step,
    letter, applied, mask, kept, removed, redundant, alone)."""
    filters = "array(" + ", ".join(f"named_struct('letter', '{x}', 'bit', {1 << i})" for i, x in enumerate(LETTERS)) + ")"
    return spark.sql(WALK.format(masks=1 << len(LETTERS), steps=len(LETTERS), filters=filters))


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
          label_id: str = "doc_id", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """Rows (part, mask, good, toxic, n): documents counted by what they fail
    and how they are labelled.  Equal texts are found by SHA-256."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = pick(docs, doc_id=id_col, text=text_col, part=part_col)
    marked = cut(base.select("doc_id", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), failures(text).alias("bits"),
                             F.unhex(F.sha2(text, 256)).alias("digest")).groupBy("digest", "doc_id", "part", "bits").agg(F.count("*").alias("n")))
    lowest = marked.groupBy("digest").agg(F.min("doc_id").alias("lowest"))
    late = F.coalesce(F.col("doc_id") > F.col("lowest"), F.lit(False))
    full = spread_join(marked, lowest, "digest", "doc_id").select(
        "doc_id", "part", (F.col("bits") + F.when(late, 16).otherwise(0)).alias("mask"), "n").groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    full = cut(full)
    known = pick(labels, doc_id=label_id, good=good_col, toxic=toxic_col).groupBy("doc_id").agg(
        F.max((F.col("good") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    labelled = spread_join(full.where("doc_id IS NOT NULL"), known, "doc_id", "mask", how="left")
    nameless = full.where("doc_id IS NULL").withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    return labelled.unionByName(nameless).groupBy(
        "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.sum("n").alias("n"))


def filter_audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row per part, permutation of the filters and step: part,
    filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley.

    Defined cases: a null or empty text has no words (it fails A only, and E
    where a smaller id has one too); a null part is ''; a null id is never
    larger than another, so it passes E, and has no label; rows that repeat an
    id and a text count each, none of them fails E for the other; an id with
    several labels counts as good or toxic if one of them says so; very long
    texts are split whole in the JVM, one text at a time; an empty table gives
    an empty result.
    """
    cells = masks(docs, labels, **columns)
    plan = cut(walk(docs.sparkSession))                  # 325 prefixes x 32 masks, whatever the input
    cells = cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"),
                                              F.sum(F.col("n") * F.col("toxic")).alias("toxic"))

    def of(flag: str, count: str = "n") -> Column:
        return F.sum(F.when(F.col(flag), F.col(count)).otherwise(0))

    steps = cells.join(F.broadcast(plan), "mask").groupBy("part", "prefix", "step", "letter").agg(
        of("kept").alias("kept"), of("removed").alias("removed"), of("redundant").alias("redundant"),
        of("alone").alias("unique_fails"), of("removed", "good").alias("good_lost"), of("removed", "toxic").alias("toxic_lost"))
    steps = cut(steps)
    rest = [factorial(len(LETTERS) - k) for k in range(1, len(LETTERS) + 1)]           # permutations a prefix begins
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in rest]), F.col("step"))
    shapley = steps.groupBy("part", "letter").agg(F.sum(F.col("removed") * weight).alias("shapley"))
    orders = plan.where((F.col("step") == len(LETTERS)) & (F.col("mask") == 0)).select(
        F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    orders = orders.select("filter_order", F.expr("left(filter_order, step)").alias("prefix"))
    return steps.join(F.broadcast(orders), "prefix").join(shapley, ["part", "letter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


ORACLE = """
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS txt FROM documents),
w AS (SELECT *, regexp_extract_all(txt, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY txt) AS lowest FROM t),
m AS (SELECT w.part,
   CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
   + CASE WHEN 100 * (length(txt) - length(regexp_replace(txt, '[A-Z]', '', 'g'))) > 2 * length(txt) THEN 4 ELSE 0 END
   + CASE WHEN regexp_matches(txt, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN w.doc_id > lowest THEN 16 ELSE 0 END AS mask,
   coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
   FROM w LEFT JOIN labels l ON l.doc_id = w.doc_id),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
walk AS (SELECT '' AS prefix, 0 AS step, '' AS letter, 0 AS bit, 0 AS before
  UNION ALL SELECT prefix || f.letter, step + 1, f.letter, f.bit, before | walk.bit FROM walk JOIN f ON NOT contains(prefix, f.letter)),
steps AS (SELECT part, prefix, step, letter,
   sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
   sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
   sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
   sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
   sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
   sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
   FROM walk, cells WHERE step > 0 GROUP BY part, prefix, step, letter),
full_rows AS (SELECT s.*, o.prefix AS filter_order FROM steps s JOIN walk o ON o.step = 5 AND starts_with(o.prefix, s.prefix))
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
   unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
   (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM full_rows"""
