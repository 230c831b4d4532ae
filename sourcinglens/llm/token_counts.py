"""Token counts with a digest cache.

The cache is a table (tokenizer, digest, n_tokens) in shared storage: digest is
the SHA-256 of the content (null and empty are the same content), tokenizer
that of the tokenizer file, the library's version and the way texts are cut
into chunks.  A run joins its texts'
digests with the stored counts, encodes one document of each digest that is
missing, appends the new counts and reads every count from the cache.  Texts
that repeat, in this run or an earlier one, are so encoded once.  A run that
dies between encoding and reading leaves counts that the next run uses; should
two runs append the same digest, reading takes one of the equal rows.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcinglens.llm.chunks import CUT, ChunkCache
from sourcinglens.llm.common import cut, pick, spread_join

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def tokenizer_version(tokenizer_file: str) -> str:
    import tokenizers

    with open(tokenizer_file, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode() + CUT.encode()).hexdigest()


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame:
    """The stored counts; no table yet is an empty one, other errors are raised."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


_OPEN: dict[str, ChunkCache] = {}


def _counter(tokenizer_file: str) -> ChunkCache:
    """One per worker process: the library's counts by chunk."""
    if tokenizer_file not in _OPEN:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        def solve(chunks: list[str]) -> list[int]:
            out: list[int] = []
            for at in range(0, len(chunks), 5000):
                out += [len(e) for e in tokenizer.encode_batch_fast(chunks[at:at + 5000], add_special_tokens=False)]
            return out

        _OPEN[tokenizer_file] = ChunkCache(solve)
    return _OPEN[tokenizer_file]


def token_counts(docs: DataFrame, cache_path: str, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 512) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    ``tokenizer_file`` is a byte-level BPE tokenizer of the ``tokenizers``
    library, readable at that path on every worker.  Defined cases: a null
    text is empty and has 0 tokens; rows that repeat an id or a text are
    counted each for itself and encoded once; an empty table gives an empty
    result and leaves the cache as it was.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_file)

    def texts() -> DataFrame:
        base = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        return base.withColumn("digest", F.unhex(F.sha2("text", 256)))

    keys = cut(texts().select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")))
    stored = read_cache(spark, cache_path).where(F.col("tokenizer") == version)
    misses = keys.groupBy("digest").agg(F.min("doc_id").alias("first_id")).join(stored, "digest", "left_anti")
    # The small side is hashed, so the texts stream through the join unsorted.
    first = misses.hint("shuffle_hash").withColumnRenamed("digest", "miss")
    chosen = texts().join(first, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("digest") == F.col("miss")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer_file)
        for b in batches:
            counts = [sum(got) for got in counter.answers(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    counted = chosen.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")
    counted = counted.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))       # rows may repeat an id and its text
    counted.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)

    counts = (read_cache(spark, cache_path).where(F.col("tokenizer") == version)
              .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))
    return spread_join(keys, counts, "digest", "doc_id").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
