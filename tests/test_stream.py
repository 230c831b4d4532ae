"""M3: a replayed stream keeps _id unique."""

import shutil
import tempfile

from sourcinglens.streaming.ingest_stream import ingest_stream


def test_ingest_stream_replay_keeps_ids_unique(spark):
    src = tempfile.mkdtemp(prefix="sl-src-")
    shutil.copy("/root/testdata/sf0.001/pages.parquet", f"{src}/pages-1.parquet")
    out = tempfile.mkdtemp(prefix="sl-out-") + "/table"
    schema = spark.read.parquet(src).schema
    q = ingest_stream(spark, src, schema, out, tempfile.mkdtemp(prefix="sl-ck1-"))
    q.awaitTermination(120)
    n1 = spark.read.parquet(out).count()
    # replay the same file under a new stream checkpoint: nothing new is added
    q2 = ingest_stream(spark, src, schema, out, tempfile.mkdtemp(prefix="sl-ck2-"))
    q2.awaitTermination(120)
    df = spark.read.parquet(out)
    assert df.count() == n1 == df.select("_id").distinct().count()
    assert n1 == spark.read.parquet(src).select("url").distinct().count()


def test_stream_of_supplier_records(spark, tmp_path):
    """Profiles become records once, whatever file brings them; a stored table
    that can't be read is no empty table."""
    import pytest
    from sourcinglens.streaming.ingest_stream import supplier_records
    page = "<h1 class='company-content__company-name'>{}</h1>"
    rows = [("u1", "Europages", page.format("One")), ("u2", "Europages", "nothing"), ("u3", "Elsewhere", page.format("Three"))]
    schema = "url string, origin string, html string"
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame(rows, schema).write.parquet(src)
    schema = spark.read.parquet(src).schema
    ingest_stream(spark, src, schema, out, str(tmp_path / "c1"), supplier_records).awaitTermination(120)
    spark.createDataFrame([*rows, ("u4", "Europages", page.format("Four"))], schema).write.mode("append").parquet(src)
    ingest_stream(spark, src, schema, out, str(tmp_path / "c1"), supplier_records).awaitTermination(120)
    assert sorted((r._id, r.name) for r in spark.read.parquet(out).collect()) == [("u1", "One"), ("u4", "Four")]
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):
        ingest_stream(spark, src, schema, str(broken), str(tmp_path / "c2"), supplier_records).awaitTermination(120)
    assert [p.name for p in broken.iterdir() if p.name.endswith(".parquet")] == ["part-0.parquet"]
