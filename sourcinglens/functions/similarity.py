"""String similarity columns.

Edit distance is Spark's built-in ``levenshtein``.  The Ratcliff-Obershelp
ratio has no built-in: an Arrow batch UDF over ``difflib``, meant for
blocked candidate pairs only (never an all-pairs product).
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def edit_distance(a: Column | str, b: Column | str) -> Column:
    """Levenshtein distance, unit costs."""
    return F.levenshtein(a, b)


@F.pandas_udf(T.DoubleType())
def gestalt_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2*M/T similarity in [0, 1]."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio()
                      for x, y in zip(a, b)], dtype="float64")
