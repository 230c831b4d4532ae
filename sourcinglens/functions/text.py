"""Text column functions (T1-T6, T25): markup cleaning, tokens, stopwords,
lemmas, stems and boolean search strings.

All column functions are built-in Spark expressions (whole-stage codegen).
Lemmas work over the *distinct* vocabulary and join back; stems use one
Arrow batch UDF over the distinct vocabulary only.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcinglens.functions.stopwords import default_stopwords

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# Markup patterns of the cleaning step, applied in this order: image tags,
# other tags, [img_assist ...] markers, then URLs.  The URL class keeps the
# range `$-_` exactly as written (it spans digits, capitals and `<>/?` ...).
IMG_TAG = r"<img[^<>]+(>|$)"
ANY_TAG = r"<[^<>]+(>|$)"
IMG_ASSIST = r"\[img_assist[^\]]*?\]"
URL = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\(\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
IMAGE_PLACEHOLDER = " image_token "
URL_PLACEHOLDER = " url_token "
# Word runs: letters, letter-numbers, other numbers and '_' (decimal digits
# split runs); a run is kept only when it is letters alone.
WORD_RUN = r"[\p{L}\p{Nl}\p{No}_]+"
LETTERS_ONLY = r"^\p{L}+$"
# Noun suffix rules of WordNet's morphy (old suffix, new suffix), in order.
NOUN_SUFFIX_RULES = (
    ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"),
    ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"),
)
# ---------------------------------------------------------------------------


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_markup(col: Column | str) -> Column:
    """Drop image tags, tags, [img_assist] markers and URLs.

    The placeholders contain '_' so the tokenizer drops them whole.
    """
    c = F.regexp_replace(_c(col), IMG_TAG, IMAGE_PLACEHOLDER)
    c = F.regexp_replace(c, ANY_TAG, " ")
    c = F.regexp_replace(c, IMG_ASSIST, " ")
    return F.regexp_replace(c, URL, URL_PLACEHOLDER)


def tokenize(col: Column | str) -> Column:
    """Lower-cased letter runs; digits split runs; runs with '_' or
    non-letters are dropped whole; single letters are kept (min length 0)."""
    runs = F.regexp_extract_all(F.lower(_c(col)), F.lit(WORD_RUN), 0)
    return F.filter(runs, lambda t: t.rlike(LETTERS_ONLY))


def drop_stopwords(tokens: Column | str, stopwords: Iterable[str] | None = None) -> Column:
    """Remove stopwords of all languages, keeping order and duplicates.

    A long ``IN`` list is planned as a hash-set lookup (InSet).  It is handed
    over as one SQL text: literal by literal it takes seconds to build.
    """
    words = list(default_stopwords() if stopwords is None else stopwords)
    if not words:
        return _c(tokens)
    listed = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)
    return F.call_function("filter", _c(tokens), F.expr(f"t -> t NOT IN ({listed})"))


def preprocess(col: Column | str, stopwords: Iterable[str] | None = None) -> Column:
    """T1 -> T2 -> T3 as one expression."""
    return drop_stopwords(tokenize(clean_markup(col)), stopwords)


def lemma_table(terms: DataFrame, lexicon: DataFrame, term_col: str = "term",
                word_col: str = "word") -> DataFrame:
    """T4 over a vocabulary: ``(term, lemma)`` for every distinct term.

    Candidates are the term and its noun-suffix rewrites; candidates found in
    the lexicon are kept and the shortest wins (rule order breaks ties); a
    term without any candidate in the lexicon is its own lemma.  Work is over
    distinct terms only, joined on the candidate (equi-join, no cross join).
    """
    vocab = terms.select(F.col(term_col).alias("term")).where(F.col("term").isNotNull()).distinct()
    cands = [F.struct(F.lit(0).alias("k"), F.col("term").alias("cand"))]
    for i, (old, new) in enumerate(NOUN_SUFFIX_RULES, start=1):
        cands.append(F.struct(
            F.lit(i).alias("k"),
            F.when(F.col("term").endswith(old),
                   F.concat(F.expr(f"substring(term, 1, length(term) - {len(old)})"), F.lit(new))).alias("cand")))
    exploded = vocab.select("term", F.explode(F.array(*cands)).alias("c")).select(
        "term", F.col("c.k").alias("k"), F.col("c.cand").alias("cand")).where(F.col("cand").isNotNull())
    lex = lexicon.select(F.col(word_col).alias("cand")).distinct()
    found = exploded.join(lex, "cand", "left_semi")
    best = found.groupBy("term").agg(
        F.min_by("cand", F.struct(F.length("cand"), F.col("k"))).alias("lemma"))
    return vocab.join(best, "term", "left").select("term", F.coalesce("lemma", "term").alias("lemma"))


def render_boolean(groups: Column | str) -> Column:
    """``array<array<string>>`` of OR-groups -> '(a OR b) AND (c)'."""
    inner = F.transform(_c(groups), lambda g: F.array_join(g, " OR "))
    return F.concat(F.lit("("), F.array_join(inner, ") AND ("), F.lit(")"))


def render_site_group(sites: Column | str) -> Column:
    """T6 (site form): '(site:a OR site:b)'."""
    return F.concat(F.lit("("), F.array_join(F.transform(_c(sites), lambda s: F.concat(F.lit("site:"), s)), " OR "),
                    F.lit(")"))


@F.pandas_udf(T.StringType())
def _porter_stem(words: pd.Series) -> pd.Series:
    from sourcinglens.functions.porter import stem
    return words.map(lambda w: None if w is None else stem(w))


def stem_table(terms: DataFrame, term_col: str = "term") -> DataFrame:
    """T5: ``(term, stem)`` for the distinct vocabulary (Arrow batch UDF on
    distinct terms only; join the result back where needed)."""
    vocab = terms.select(F.col(term_col).alias("term")).where(F.col("term").isNotNull()).distinct()
    return vocab.select("term", _porter_stem("term").alias("stem"))
