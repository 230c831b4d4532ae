"""M3: incremental ingest of arriving page files (Structured Streaming).

Each micro-batch is turned into records (``to_records``), de-duplicated on
``_id`` and anti-joined against the stored table before it is appended
(M1), so a replayed batch adds nothing and no unbounded de-dup state is kept
in the stream.  The stored table and the stream checkpoint live on shared
storage given by the caller.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcinglens.operators.ingest import insert_if_absent


def page_records(batch: DataFrame) -> DataFrame:
    """Default record builder: one record per page url."""
    from sourcinglens.operators.html import visible_tokens
    return batch.select(F.col("url").alias("_id"), "url", F.size(visible_tokens("html")).alias("n_tokens"))


def supplier_records(batch: DataFrame) -> DataFrame:
    """Supplier records (H12) of arriving profile pages (url, origin, html);
    pages of unknown origin and pages without a profile give none."""
    from sourcinglens.operators.directories import extract_by_origin
    found = extract_by_origin(batch.select("url", "origin", "html"))
    return found.where("reason IS NULL").drop("reason").withColumn("_id", F.col("url"))


def ingest_stream(spark: SparkSession, source_dir: str, schema: T.StructType, table_path: str,
                  checkpoint_dir: str, to_records: Callable[[DataFrame], DataFrame] = page_records,
                  fmt: str = "parquet"):
    """Start the stream (``availableNow``: process what has arrived, then stop)."""

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        recs = to_records(batch)
        try:
            existing = batch.sparkSession.read.parquet(table_path).select("_id")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":           # only a table that isn't there yet counts as empty
                raise
            existing = batch.sparkSession.createDataFrame([], "_id string")
        insert_if_absent(recs, existing).write.mode("append").parquet(table_path)

    stream = spark.readStream.schema(schema).format(fmt).load(source_dir)
    return (stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
            .trigger(availableNow=True).start())
