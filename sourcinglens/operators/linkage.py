"""Record linkage (R7): best domain label for a company name.

Candidates come from an equi-join on the request (J9); each pair gets an
edit distance (built-in) and a gestalt ratio (Arrow batch UDF), and the best
is chosen by a hash aggregate with ``min_by`` — no all-pairs product.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcinglens.functions.similarity import gestalt_ratio


def best_domain(pairs: DataFrame, keys: Sequence[str] = ("request_id",), legacy: bool = False) -> DataFrame:
    """(keys..., domain) — lowest edit distance, then highest ratio, then
    first position.  ``legacy`` takes the first candidate, as the reference's
    loop returns on its first turn.  No candidates: no row."""
    if legacy:
        return pairs.groupBy(*keys).agg(F.min_by("domain", "pos").alias("domain"))
    scored = pairs.withColumn("dist", F.levenshtein("name", "domain")).withColumn(
        "ratio", gestalt_ratio(F.col("name"), F.col("domain")))
    return scored.groupBy(*keys).agg(
        F.min_by("domain", F.struct("dist", (-F.col("ratio")).alias("nr"), "pos")).alias("domain"))
