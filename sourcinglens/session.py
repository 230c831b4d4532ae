"""Session helpers: a local session for tests/bench and shared-storage lookups.

Operators never build sessions; they use ``df.sparkSession``.  The only
cluster-level setting an operator reads is ``spark.checkpoint.dir`` (shared
storage for lineage cuts), taken from the running session.
"""

from __future__ import annotations

import gc
import os
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark removes the shuffle files of a plan that is made while this is set, once it has run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "sourcinglens") -> SparkSession:
    """Local session for tests and the bench.  A cluster passes its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SOURCINGLENS_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting must name shared storage; without it this raises,
    as a folder on the driver's own disk is of no use to executors.  Only a
    local master, where driver and executors are one process, gets a folder.
    """
    sc = spark.sparkContext
    conf_dir = (sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
                or sc.getConf().get("spark.checkpoint.dir", None))
    if not conf_dir:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf_dir = tempfile.mkdtemp(prefix="sourcinglens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(conf_dir)
    return conf_dir


@contextmanager
def run_once(spark: SparkSession) -> Iterator[None]:
    """Plans made inside run once and lose their shuffle files then, not only
    when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable lineage cut: a checkpoint on shared storage (never local).  The
    plan behind it is one of its own (``df`` may run again) and leaves no shuffle files."""
    ensure_checkpoint_dir(df.sparkSession)
    with run_once(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def drop_unused(spark: SparkSession) -> None:
    """Have the driver collect its garbage now.  Only then does Spark remove the
    broadcasts, shuffle files and (where the session says so) checkpoints that
    nothing refers to; left alone the driver may not for half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
