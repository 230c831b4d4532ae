"""What op10 and the pipeline's near-duplicate stage leave on disk, and move."""

import random
import time

import corpus_pipeline
from pyspark.sql import functions as F

from sourcinglens.llm import ngram_join
from sourcinglens.llm.ngram_join import jaccard_groups
from sourcinglens.session import cut_lineage


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {s for i in range(blocks.size()) if (s := blocks.apply(i).name()).startswith("shuffle_")}


def left_over(spark, before):
    """Shuffle files since ``before``, a while later: Spark removes them in the background."""
    for _ in range(40):
        if not (more := shuffle_files(spark) - before):
            break
        time.sleep(0.25)
    return more


def texts(n):
    rng = random.Random(n)
    words = [f"w{i}" for i in range(50)]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(n)]
    return base + [t + " more" for t in base[::3]] + base[::7]


def test_a_cut_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    rows = spark.range(5000).groupBy((F.col("id") % 1000).alias("k")).count()
    cut = cut_lineage(rows)
    assert not left_over(spark, before)
    assert cut.count() == rows.count() == 1000          # neither needs them


def test_the_near_duplicate_stage_leaves_only_the_files_of_its_result(spark):
    docs = cut_lineage(spark.createDataFrame(list(enumerate(texts(300))), "doc_id long, text string"))
    before = shuffle_files(spark)
    kept = corpus_pipeline.near_copies(spark, docs, "")
    # Sums of a row (do links still change) stay until the driver collects them.
    sizes = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    big = [s for s in left_over(spark, before) if s.endswith(".data") and sizes.getFile(s).length() > 500]
    assert not big
    assert kept.count() == 300


def test_postings_name_their_class_by_number(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ngram_join, "cut", lambda df, f=ngram_join.cut: seen.append(df.schema) or f(df))
    docs = spark.createDataFrame(list(enumerate(texts(60))), "doc_id long, text string")
    groups = {r.doc_id: r.component_id for r in jaccard_groups(docs).collect()}
    postings = [s for s in seen if "token" in s.names]
    assert postings and all(f.dataType.typeName() != "binary" for s in postings for f in s.fields if f.name == "cls")
    assert len(set(groups.values())) == 60
