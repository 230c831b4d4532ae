"""Row numbers of long lists, with columns beside the sort keys."""
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sourcinglens.operators import windows as wn


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbers_equal_row_number_with_payload(spark, adaptive):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        df = spark.range(1_000_000).select(
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
            F.when(F.col("id") % 50 > 0, F.pmod(F.xxhash64("id"), F.lit(900)) / 7.0).alias("score"), "id",
            F.concat(F.lit("payload "), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
        got = wn.group_row_number(df, ["g"], ["-score", "id"], "rn")
        want = F.row_number().over(Window.partitionBy("g").orderBy(F.col("score").desc(), "id"))
        wrong = got.withColumn("want", want).agg(F.count("*").alias("n"), F.count_if(F.col("rn") != F.col("want")).alias("bad")).first()
        assert (wrong.n, wrong.bad) == (1_000_000, 0)
        ranked = wn.global_rank(df.select("id", "text"), ["id"]).agg(F.count("*"), F.count_if(F.col("rank") != F.col("id") + 1)).first()
        assert tuple(ranked) == (1_000_000, 0)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_small_tables(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 3)], "g string, v int")
    assert {(r.g, r.v, r.rn) for r in wn.group_row_number(df, ["g"], ["v"]).collect()} == {("a", None, 1), ("a", 1, 2), (None, 3, 1)}
    assert wn.group_row_number(df.limit(0), ["g"], ["v"]).count() == 0


def test_many_shuffle_partitions(spark):
    """The plan doesn't grow with the partitions; a hot group lies in many of them."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "500")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20_000).select(F.when(F.col("id") % 4 > 0, "hot").alias("g"), F.pmod(F.xxhash64("id"), F.lit(97)).alias("v"), "id")
        got = wn.group_row_number(df, ["g"], ["-v", "id"], "rn")
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert len(plan) < 10_000
        want = F.row_number().over(Window.partitionBy("g").orderBy(F.col("v").desc(), "id"))
        wrong = got.withColumn("want", want).agg(F.count("*"), F.count_if(F.col("rn") != F.col("want"))).first()
        assert tuple(wrong) == (20_000, 0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
