"""Queries of the record sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourcinglens.operators import joins as jn
from sourcinglens.plans.catalog import register
from sourcinglens.plans.q_more import _SUPPLIER_HITS, asked_suppliers, result_lists
from sourcinglens.sources import records_io as io
from sourcinglens.sources.fixture_sql import with_ctes
from sourcinglens.sources.tables import read_table


@register("S2_normalise_classifications", """
SELECT p_partkey, 'scalar' AS classification, lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS code FROM part
UNION ALL SELECT p_partkey, 'list', p_brand FROM part UNION ALL SELECT p_partkey, 'list', p_type FROM part
UNION ALL SELECT p_partkey, 'structs', p_name FROM part""")
def s2_normalise_classifications(spark, d):
    p = read_table(spark, d, "part")
    raw = F.to_json(F.struct(
        F.lpad(F.col("p_partkey").cast("string"), 7, "0").alias("scalar"), F.array("p_brand", "p_type").alias("list"),
        F.array(F.struct(F.col("p_name").alias("code"), F.lit("x").alias("label"))).alias("structs"),
        F.array().cast("array<string>").alias("none")))
    out = io.normalise_classifications(p.select("p_partkey", F.parse_json(raw).alias("classifications")))
    return out.select("p_partkey", F.explode("classifications").alias("classification", "codes")).select(
        "p_partkey", "classification", F.explode("codes").alias("code"))


@register("S4_distinct_products", """
SELECT DISTINCT p_name AS "Ingredients" FROM part WHERE p_name <> ''""")
def s4_distinct_products(spark, d):
    return io.distinct_products(read_table(spark, d, "part").select(F.col("p_name").alias("Ingredients")))


@register("S6_shortlist_report", with_ctes(["supplier_base"], f""", {_SUPPLIER_HITS},
l AS (SELECT request_id, site, list(link ORDER BY pos) AS ls FROM hits GROUP BY ALL)
SELECT a.request_id, a.id AS _id, p.n_hits, l.ls[1] AS link_0, l.ls[2] AS link_1, l.ls[3] AS link_2
FROM asked a JOIN per p ON p.request_id = a.request_id AND p.site = a.website
JOIN l ON l.request_id = p.request_id AND l.site = p.site"""))
def s6_shortlist_report(spark, d):
    hits = jn.suppliers_with_hits(asked_suppliers(spark, d), result_lists(spark, d))
    return io.shortlist_report(hits.select("request_id", "_id", "n_hits", "links"), 3, "links")
