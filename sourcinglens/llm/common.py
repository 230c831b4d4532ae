"""Helpers shared by the operators of this package."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcinglens.session import cut_lineage, ensure_checkpoint_dir

#: A word, everywhere in this package: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_GAP = r"[\x20\x09-\x0D]+"


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """``alias=name`` selection that survives clashing names.

    ``name`` is matched exactly and by position, so an extra column that only
    differs in case, or carries a name the operator uses inside, cannot make
    the reference ambiguous.  The first of several equal names counts.
    """
    names = df.columns
    flat = df.toDF(*[f"_c{i}" for i in range(len(names))])
    return flat.select(*[F.col(f"_c{names.index(name)}").alias(alias) for alias, name in columns.items()])


def keep_columns(df: DataFrame, key: str, mask: DataFrame) -> DataFrame:
    """Rows of ``df`` (all columns, as named) whose ``key`` is in ``mask.key``;
    null keys are matched too.  Only the mask is hashed: rows of ``df`` stream."""
    names = df.columns
    flat = df.toDF(*[f"_c{i}" for i in range(len(names))])
    k = F.col(f"_c{names.index(key)}")
    mask = mask.select(F.col("key").alias("_key")).hint("shuffle_hash")
    return flat.join(mask, k.eqNullSafe(F.col("_key")), "left_semi").toDF(*names)


def ascii_lower(text: Column) -> Column:
    """A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder."""
    return cut_lineage(df)


def spread_join(rows: DataFrame, table: DataFrame, key: str | list[str], by: str, salts: int = 64,
                how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (one row per ``key``) without ever sending
    all rows of one key to one task: the table's row is first handed to the
    salts in use (few), then meets the rows of each salt.  ``rows`` is read
    twice, so give it a cut or a cheap one.  ``how="left"`` keeps the rows of
    keys that ``table`` lacks; rows with a null key go in either case."""
    keys = [key] if isinstance(key, str) else key
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    in_use = salted.groupBy(*keys, "_salt").agg(F.lit(1).alias("_one")).drop("_one").join(table, keys, how)
    return salted.join(in_use, [*keys, "_salt"]).drop("_salt")


def scratch_folder(df: DataFrame, name: str) -> str:
    """A new folder below the shared checkpoint folder, for a written table."""
    return f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
