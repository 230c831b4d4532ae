"""Record sources and sinks.

Supplier records come as JSON (an array per file, or one record a line), the
scale path is Parquet.  ``classifications`` differ by origin (a scalar, an
array, or an array of structs with a ``code``), so they are read as VARIANT
and brought to ``map<string, array<string>>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUPPLIER_SCHEMA = """
_id string, lastScraped double, url string, name string, classifications variant,
postalAddress struct<streetAddress: string, addressLocality: string, addressRegion: string, addressCountry: string,
  postalCode: string, addressRaw: string>,
telephone string, website string, mainActivity string, vatId string, category string, subcategory string,
corporateCapital string, yearEstablished int, legalForm string, locationType string, revenue string,
employeesSite string, facilitySize string, products array<string>, origin string, keywords array<string>,
certifications array<string>, brands array<string>, description string, registrationNumber string, logoUrl string,
headquarter string, contactEmails array<struct<email: string, type: string, source: string>>,
companydataEnriched array<struct<url: string, url_root: string, origin: string, probability: double>>,
incoterms array<string>, documents array<struct<document: string, url: string>>
"""
CODE_SCHEMA = "classification string, code string, label string, relevant int"


def read_suppliers(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Typed supplier rows from JSON files: an array of records per file,
    or (``lines``, splittable) one record a line.  Epoch seconds become a
    timestamp; fields a record lacks are NULL."""
    df = spark.read.schema(SUPPLIER_SCHEMA).option("multiLine", not lines).json(path)
    return normalise_classifications(df).withColumn("lastScraped", F.timestamp_seconds("lastScraped"))


def codes_of(value: Column) -> Column:
    """One classification's codes, from any of its shapes, as strings."""
    shape = F.schema_of_variant(value)
    as_list = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda e: F.when(
        F.schema_of_variant(e).startswith("OBJECT"), F.try_variant_get(e, "$.code", "string")
    ).otherwise(F.try_variant_get(e, "$", "string")))
    return (F.when(value.isNull() | (shape == "VOID"), F.array().cast("array<string>"))
            .when(shape.startswith("ARRAY"), F.filter(as_list, lambda c: c.isNotNull()))
            .when(shape.startswith("OBJECT"), F.array_compact(F.array(F.try_variant_get(value, "$.code", "string"))))
            .otherwise(F.array(F.try_variant_get(value, "$", "string"))))


def normalise_classifications(df: DataFrame, col: str = "classifications") -> DataFrame:
    """VARIANT of mixed shapes -> map<string, array<string>>; NULL is an empty map."""
    entries = F.try_variant_get(F.col(col), "$", "map<string, variant>")
    empty = F.create_map().cast("map<string,array<string>>")
    return df.withColumn(col, F.coalesce(F.transform_values(entries, lambda _, v: codes_of(v)), empty))


def read_industry_codes(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """S3: the code table, codes as strings (leading zeros stay), relevant ones only."""
    reader = spark.read.schema(CODE_SCHEMA)
    df = reader.option("header", True).csv(path) if kind == "csv" else reader.parquet(path)
    return df.where("relevant = 1")


def distinct_products(df: DataFrame, col: str = "Ingredients") -> DataFrame:
    """Distinct product names, sorted; missing and empty names are none."""
    return df.select(F.col(col)).where(F.col(col).isNotNull() & (F.col(col) != "")).distinct().orderBy(col)


def write_shortlist(df: DataFrame, path: str) -> None:
    """One folder of JSON lines per request."""
    df.write.partitionBy("request_id").mode("overwrite").json(path)


def shortlist_report(df: DataFrame, width: int = 5, links: str = "subDomains") -> DataFrame:
    """The wide report: what identifies a supplier, its number of hits and
    the first ``width`` links as ``link_0`` .. (missing ones are NULL)."""
    rest = [c for c in df.columns if c != links]
    return df.select(*rest, *[F.get(links, F.lit(i)).alias(f"link_{i}") for i in range(width)])


def export_records(df: DataFrame, path: str, kind: str = "json") -> None:
    """Records for exchange; for CSV, values that are no plain text or
    number are written as JSON text."""
    if kind == "json":
        df.write.mode("overwrite").json(path)
        return
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", "\"").csv(path)
