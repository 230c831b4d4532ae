"""Quality rules as a short-circuit cascade (native).

The base counts of a text are computed once.  The verdict is a cascade of
rejecting rules: on a sample of the documents, the share that each rule rejects
is counted and the time Spark needs for it measured, over many copies of the
sample and less the time of a job without a rule; the rules are tried in the
order of rejections per second.  A ``CASE`` expression stops at the first rule that
rejects, so a later rule's expression is not evaluated for that document.
Every rule is tried on what the earlier ones kept: order changes the cost of
the verdict, never the verdict.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcinglens.llm.common import WORD_GAP, cut, pick

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 5


def rules() -> dict[str, Column]:
    """Rule name -> rejecting condition, over the base counts and ``text``."""
    n, text = F.col("n_words"), F.col("text")
    lines = F.size(F.split(text, "\n"))
    return {
        "symbols": F.col("n_symbols") * 10 > n,                       # over one symbol in ten words
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
        "repeated_lines": (lines >= 4) & (F.col("n_dup_lines") * 2 > lines),
        "shouting": F.regexp_count(text, F.lit("!")) * 5 > n,
        "capitals": F.regexp_count(text, F.lit(r"\p{Lu}")) * 10 > F.col("word_chars") * 4,
        "letters": F.regexp_count(text, F.lit(r"\p{L}")) * 2 < F.col("word_chars"),
        "endless_word": F.regexp_count(text, F.lit(r"\p{L}{60}")) > 0,
    }


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and the base counts of every whole text."""
    d = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("words", F.filter(F.split("text", WORD_GAP), lambda w: w != ""))
    d = d.withColumn("n_words", F.size("words").cast("long"))

    def window(i: Column) -> Column:
        return F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])

    starts = F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW)
    none = F.array().cast("array<bigint>")
    d = d.withColumn("grams", F.when(F.col("n_words") >= WINDOW, F.transform(starts, window)).otherwise(none))
    # Equal windows stand side by side once sorted; most texts have none.
    repeats = F.size(F.array_distinct("grams")) < F.size("grams")
    paired = F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    d = d.withColumn("sorted", F.when(repeats, paired))
    again = F.filter("sorted", lambda x, k: (x["g"] == F.get("sorted", k - 1)["g"]) | (x["g"] == F.get("sorted", k + 1)["g"]))
    d = d.withColumn("at", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.transform("at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1), p + WINDOW) - p))
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    d = d.withColumn("lines", lines)
    return d.select(
        "doc_id", "text", "n_words",
        F.char_length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.octet_length("text") - F.octet_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"))


BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def order_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 1000, copies: int = 4,
                runs: int = 3, seed: int = 11) -> list[str]:
    """Rule names by measured rejections per second on about ``sample_rows``
    documents.  Only the sample's base counts are taken.  A rule's time is the
    least of ``runs`` jobs over ``copies`` copies of the sample, less that of
    jobs that only read the texts."""
    total = docs.select(F.lit(1)).count()
    sample = docs.sample(min(1.0, sample_rows / total), seed) if total else docs
    sample = cut(base_counts(sample, id_col, text_col)).where(f"NOT ({BASE_FAILED})")      # a filter below the cut would repeat the counts
    many = sample.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))

    def job(rejects: Column) -> tuple[float, int]:
        began = time.perf_counter()
        # the copy's number stands in the text, so no evaluation serves two copies
        rejected = many.withColumn("text", F.concat("text", F.char(F.lit(48) + F.col("copy") % 10))).agg(F.count_if(rejects)).first()[0]
        return time.perf_counter() - began, rejected

    def measured(rejects: Column) -> tuple[float, int]:
        taken = [job(rejects) for _ in range(runs)]
        return min(t for t, _ in taken), taken[0][1]

    job(F.lit(True))
    idle, _ = measured(F.octet_length("text") < 0)
    worth = {}
    for name, rejects in rules().items():
        seconds, rejected = measured(rejects)
        worth[name] = (rejected + 0.5) / max(seconds - idle, 1e-3)
    return sorted(worth, key=lambda k: -worth[k])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  order: list[str] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept.

    ``order`` (rule names) skips the sample.  Defined cases: a null or empty
    text has no words and fails; rows that repeat an id are judged each for
    itself; an empty table gives an empty result.  Five-word windows are
    compared by 64-bit hash within one text (a chance of about n^2 / 2^65 per
    text that two different windows look alike).
    """
    counts = base_counts(docs, id_col, text_col)
    reject = rules()
    order = order_rules(docs, id_col, text_col) if order is None else order
    failed = F.expr(BASE_FAILED)
    verdict = F.when(failed, F.lit(False))
    for name in order:
        verdict = verdict.when(reject[name], F.lit(False))
    return counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         failed.alias("base_failed"), verdict.otherwise(F.lit(True)).alias("kept"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, list_aggregate(ws[i + 1 : i + 5], 'string_agg', chr(10)) AS gram
      FROM (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 4, 0))) AS i FROM d)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, sum(least(5, coalesce(nxt, i + 5) - i)) AS n_repeat_words
      FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM f) GROUP BY doc_id),
c AS (SELECT d.doc_id, t, CAST(len(ws) AS BIGINT) AS n_words,
   CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
   CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
   list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]', '', 'g') <> '') AS ls,
   CAST(coalesce(r.n_repeat_words, 0) AS BIGINT) AS n_repeat_words
   FROM d LEFT JOIN r ON r.doc_id = d.doc_id),
b AS (SELECT *, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
   n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
   OR (len(string_split(t, chr(10))) >= 4 AND n_dup_lines * 2 > len(string_split(t, chr(10))))
   OR len(regexp_extract_all(t, '!')) * 5 > n_words OR len(regexp_extract_all(t, '\p{Lu}')) * 10 > word_chars * 4
   OR len(regexp_extract_all(t, '\p{L}')) * 2 < word_chars OR len(regexp_extract_all(t, '\p{L}{60}')) > 0) AS kept
FROM b"""
