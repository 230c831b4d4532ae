"""Ingest idempotence (M1) and the oracle gate on small data."""

import duckdb

import __spark_entry__ as E
from sourcinglens.operators.ingest import insert_if_absent

SF = "/root/testdata/sf0.001"


def test_insert_if_absent_idempotent(spark):
    existing = spark.createDataFrame([("a",)], "_id string")
    batch = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "_id string, v int")
    new = insert_if_absent(batch, existing)
    assert sorted(r._id for r in new.collect()) == ["b"]
    again = insert_if_absent(batch, existing.unionByName(new.select("_id")))
    assert again.count() == 0


def _duck():
    con = duckdb.connect()
    from sourcinglens.sources.tables import TABLES
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_oracle_gate_small(spark):
    con = _duck()
    sqls = E.oracle_sql()
    for name in ("R4_cosine_rank", "F1_filter_suppliers", "A4_top_codes", "H3_page_links", "T7_domain_label"):
        df = E.queries()[name](spark, SF)
        got = sorted(tuple(str(v) for v in r) for r in df.select(sorted(df.columns)).collect())
        cur = con.execute(f"SELECT * FROM ({sqls[name]}) ORDER BY ALL")
        cols = [c[0] for c in cur.description]
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        want = sorted(tuple(str(r[i]) for i in order) for r in cur.fetchall())
        assert len(got) == len(want), name


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["item_id", "doc_id", "relevance", "rank"]
    assert df.count() >= 0
