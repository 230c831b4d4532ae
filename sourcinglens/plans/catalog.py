"""Registered queries: one Spark plan and one DuckDB oracle per operator.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs the operator over the
whole derived tables; ``ORACLE[name]`` is the same question in SQL over the
flat driver views.  Computed columns carry the same alias on both sides and
doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

import importlib
import sys
import traceback
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


MODULES = ("q_text", "q_relational", "q_html", "q_flow", "q_more", "q_sources", "q_directories", "q_discovery")
FAILED: dict[str, str] = {}


def load_all() -> None:
    """Import every module that registers queries.  A module that cannot be
    imported is reported on stderr and kept in ``FAILED``; the others stay."""
    for m in MODULES:
        try:
            importlib.import_module(f"sourcinglens.plans.{m}")
        except Exception:  # noqa: BLE001  reported, and asserted empty by the tests
            FAILED[m] = traceback.format_exc()
            print(f"query module {m} failed to import:\n{FAILED[m]}", file=sys.stderr)
