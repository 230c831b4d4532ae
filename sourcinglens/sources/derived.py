"""Supplier-domain input tables derived by Spark from the driver's tables.

The reference reads a document store of suppliers, industry-code workbooks,
a crawl queue, a country-language lookup and live web pages.  Here those
inputs are derived from the driver's TPC-H-like tables so that every query
grows with the data.  Each builder has a SQL twin in ``fixture_sql.py``
(the DuckDB oracle reads the flat form; the engine packs nested records).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcinglens.sources.tables import read_table

SITE_RE = r"^([a-z]+://[^/?#]+)"
ORIGINS = ("Organicbio", "Europages", "Kompass")


def _sid(col: str) -> F.Column:
    return F.concat(F.lit("sup-"), F.col(col).cast("string"))


def supplier_base(spark: SparkSession, d: str) -> DataFrame:
    """(id, name, country, origin, website, description): one row per supplier.

    Documents and pages are dealt to suppliers by their ids modulo the number
    of suppliers (keys are 0, 1, ..): a description is all of a supplier's
    documents, in id order, a website that of its first page.
    """
    s = read_table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = read_table(spark, d, "nation").select("n_nationkey", "n_name")
    hands = F.lit(max(1, s.count()))
    k = F.col("s_suppkey")
    docs = read_table(spark, d, "documents").groupBy((F.col("doc_id") % hands).alias("_dealt")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n").alias("description"))
    sites = read_table(spark, d, "pages").groupBy((F.col("page_id") % hands).alias("_dealt")).agg(
        F.min_by(F.regexp_extract("url", SITE_RE, 1), "page_id").alias("site"))
    return (s.join(n, s.s_nationkey == n.n_nationkey)
            .join(docs, docs["_dealt"] == k, "left")
            .join(sites, sites["_dealt"] == k, "left")
            .select(_sid("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("n_name").alias("country"),
                    F.when(k % 3 == 0, "Organicbio").when(k % 3 == 1, "Europages").otherwise("Kompass").alias("origin"),
                    F.when(k % 7 == 0, F.lit("")).otherwise(F.col("site")).alias("website"),
                    "description"))


def _supplied(spark: SparkSession, d: str, column: str) -> DataFrame:
    """(id, value): distinct values of a part column over all of a supplier's lineitems."""
    lines = read_table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    part = read_table(spark, d, "part").select("p_partkey", F.col(column).alias("value"))
    return lines.join(part, lines.l_partkey == part.p_partkey).select(_sid("l_suppkey").alias("id"), "value").distinct()


def supplier_code(spark: SparkSession, d: str) -> DataFrame:
    """(id, classification, code): Kompass codes from brands, SIC from types."""
    kompass = _supplied(spark, d, "p_brand").select("id", F.lit("Kompass").alias("classification"), F.col("value").alias("code"))
    return kompass.unionAll(_supplied(spark, d, "p_type").select("id", F.lit("SIC").alias("classification"), F.col("value").alias("code")))


def supplier_keyword(spark: SparkSession, d: str) -> DataFrame:
    """(id, keyword)."""
    return _supplied(spark, d, "p_name").select("id", F.col("value").alias("keyword"))


def industry_code(spark: SparkSession, d: str) -> DataFrame:
    """(classification, code, label, relevant): one lookup row per code."""
    part = read_table(spark, d, "part").select("p_name", "p_brand", "p_type")
    kompass = part.groupBy(F.col("p_brand").alias("code")).agg(
        F.min("p_name").alias("label"), F.count(F.lit(1)).alias("n")).select(
        F.lit("Kompass").alias("classification"), "code", "label",
        F.when(F.col("n") % 2 == 0, 1).otherwise(0).alias("relevant"))
    sic = part.groupBy(F.col("p_type").alias("code")).agg(F.min("p_name").alias("m")).select(
        F.lit("SIC").alias("classification"), "code",
        F.concat(F.lower("code"), F.lit(" "), F.col("m")).alias("label"), F.lit(1).alias("relevant"))
    names = part.groupBy(F.col("p_name").alias("code")).agg(F.lit(1).alias("relevant")).select(
        F.lit("NAME").alias("classification"), "code", F.col("code").alias("label"), "relevant")
    return kompass.unionAll(sic).unionAll(names)


def site_page(spark: SparkSession, d: str, with_html: bool = True) -> DataFrame:
    """(page_id, url, site[, html]).  Keep ``html`` out of shuffles: select it late."""
    p = read_table(spark, d, "pages")
    cols = [F.col("page_id"), F.col("url"), F.regexp_extract("url", SITE_RE, 1).alias("site")]
    if with_html:
        cols.append(F.col("html"))
    return p.select(*cols)


def page_status(spark: SparkSession, d: str) -> DataFrame:
    """Page table in the fetch-result form: (url, status, html, origin).

    Status and origin stand in for the HTTP result and the directory.
    """
    p = read_table(spark, d, "pages")
    k = F.col("page_id")
    return p.select("page_id", "url",
                    F.when(k % 10 == 9, 404).otherwise(200).alias("status"), "html",
                    F.when(k % 3 == 0, "Organicbio").when(k % 3 == 1, "Europages").otherwise("Kompass").alias("origin"))


def crawl_queue(spark: SparkSession, d: str) -> DataFrame:
    """(_id, origin, url, discovered): 0 pending, -2 failed, epoch seconds done."""
    p = read_table(spark, d, "pages").select("page_id", "url")
    k = F.col("page_id")
    return p.select(F.col("url").alias("_id"),
                    F.when(k % 3 == 0, "Organicbio").when(k % 3 == 1, "Europages").otherwise("Kompass").alias("origin"),
                    F.col("url"),
                    F.when(k % 4 == 0, F.lit(0.0)).when(k % 4 == 1, F.lit(-2.0))
                    .otherwise((F.lit(1_600_000_000) + k * 60).cast("double")).alias("discovered"))


def country_languages(spark: SparkSession, d: str) -> DataFrame:
    """(countryName, languageCode) with comma lists, by region."""
    n = read_table(spark, d, "nation").select("n_name", "n_regionkey")
    r = F.col("n_regionkey")
    code = (F.when(r == 0, "en").when(r == 1, "fr,en").when(r == 2, "de").when(r == 3, "es,pt")
            .otherwise("it,fr,de"))
    return n.select(F.col("n_name").alias("countryName"), code.alias("languageCode"))


def requests(spark: SparkSession, d: str) -> DataFrame:
    """(request_id, product, countries array) — product requests from part names.

    A product asks for the countries of the region ``min(p_partkey) % 5``.
    """
    part = read_table(spark, d, "part").select("p_partkey", "p_name")
    nation = read_table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    reqs = part.groupBy("p_name").agg((F.min("p_partkey") % 5).cast("int").alias("region"))
    # nation is a fixed 25-row lookup: bounded broadcast, one array per region.
    by_region = nation.groupBy(F.col("n_regionkey").alias("region")).agg(
        F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("ns")).select(
        "region", F.transform("ns", lambda x: x["n_name"]).alias("countries"))
    return reqs.join(F.broadcast(by_region), "region").select(
        F.col("p_name").alias("request_id"), F.col("p_name").alias("product"), "countries")


def page_requests(spark: SparkSession, d: str) -> DataFrame:
    """(request_id, product, countries): one request per page title, for the
    countries of the region ``page_id % 5``.  Titles share the page vocabulary,
    so site searches have hits."""
    p = read_table(spark, d, "pages").select("page_id", "html")
    nation = read_table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    by_region = nation.groupBy(F.col("n_regionkey").alias("region")).agg(
        F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("ns")).select(
        "region", F.transform("ns", lambda x: x["n_name"]).alias("countries"))
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    return p.select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("request_id"),
                    title.alias("product"), (F.col("page_id") % 5).cast("int").alias("region")).join(
        F.broadcast(by_region), "region").select("request_id", "product", "countries")


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    """Nested supplier records (the document-store shape) from the flat tables.

    classifications: map<string, array<string>>; keywords: array<string>;
    postalAddress: struct; contactEmails / companydataEnriched: arrays of structs.
    """
    from sourcinglens.functions.records import make_website_array
    base = supplier_base(spark, d)
    codes = supplier_code(spark, d).groupBy("id", "classification").agg(
        F.array_sort(F.collect_set("code")).alias("codes")).groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct("classification", "codes"))).alias("classifications"))
    kws = supplier_keyword(spark, d).groupBy("id").agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))
    empty_map = F.create_map().cast("map<string,array<string>>")
    return (base.join(codes, "id", "left").join(kws, "id", "left")
            .select(F.col("id").alias("_id"), "name",
                    F.struct(F.lit("").alias("streetAddress"), F.lit("").alias("addressLocality"),
                             F.lit("").alias("addressRegion"), F.col("country").alias("addressCountry"),
                             F.lit("").alias("postalCode")).alias("postalAddress"),
                    "origin", "website", "description",
                    F.coalesce("classifications", empty_map).alias("classifications"),
                    F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"),
                    F.array().cast("array<struct<email:string,type:string,source:string>>").alias("contactEmails"),
                    make_website_array(F.col("website"), F.col("origin")).alias("companydataEnriched")))
