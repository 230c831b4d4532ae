"""Directory profiles (H5, H6, H8, H12): pages rendered from supplier rows by
Spark, extracted again, held against the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourcinglens.operators import directories as dr
from sourcinglens.plans.catalog import register
from sourcinglens.sources.tables import read_table


def class_profile():
    """The class-driven profile of a supplier row."""
    return F.concat(
        F.lit("<div class='page__layout'><h1 class='big company-content__company-name'> "), F.col("s_name"),
        F.lit("</h1><i class='flag flag-1x fr'></i><span>"), F.col("n_name"), F.lit("</span><pre>"), F.col("s_address"),
        F.lit("\nTown</pre><span class='js-num-tel js-hidden'>"), F.col("s_phone"),
        F.lit("</span><a class='page-action' itemprop='url' href='http://http://S"), F.col("s_suppkey"), F.lit(".example'>w</a><ul class='organisation-list'><li><span>Year established</span> <span>"),
        F.col("year"), F.lit("</span></li></ul><ul class='brand-list'><li>A &amp; B</li><li>C</li></ul><a class='keyword-tag'>Tea</a><a class='keyword-tag'>Oil</a>"
                             "<li class='js-click-out'><span class='label'>Doc&nbsp;"), F.col("s_suppkey"), F.lit("</span><a href='/d.pdf'>get</a></li></div>"))


def profiles(spark, d):
    """(url, origin, html): one profile per supplier, in its directory's form;
    every third is of an origin that has no extractor."""
    s = read_table(spark, d, "supplier").join(read_table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    s = s.withColumns({"url": F.concat(F.lit("https://dir.example/"), k), "year": (1900 + k % 120).cast("string"),
                       "s_address": F.concat(F.lit("Rue "), k), "s_phone": F.concat(F.lit("+33 "), k)})
    values = {0: "s_name", 1: "s_address", 5: "n_name", 6: "s_phone", 17: "year"}
    cells = F.concat(*[F.concat(F.lit(f"<tr><th>L{i}</th>\n <td class='v'> "), F.col(values[i]) if i in values
                                else F.lit("Growing &amp; trade<br>Export <a href='/x'>more</a>") if i in (10, 19)
                                else F.lit("x"), F.lit("</td></tr>")) for i in range(24)])
    kind = k % 3
    return s.select("url", F.when(kind == 0, "Organicbio").when(kind == 1, "Europages").otherwise("Kompass").alias("origin"),
                    F.when(kind == 0, F.concat(F.lit("<table>"), cells, F.lit("</table>"))).otherwise(class_profile()).alias("html"))


_ROWS = """WITH r AS (SELECT s.*, n.n_name, concat('https://dir.example/', s_suppkey) AS url, 1900 + s_suppkey % 120 AS yr,
 concat('Rue ', s_suppkey) AS s_address, concat('+33 ', s_suppkey) AS s_phone
 FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey)"""


@register("H5_label_value_records", f"""{_ROWS}
SELECT url, s_name AS name, trim(s_address) AS "streetAddress", n_name AS "addressCountry", s_phone AS telephone,
 CAST(yr AS INTEGER) AS "yearEstablished", 'Growing & trade, Export, more' AS "mainActivity", 'export|growing & trade' AS keywords
FROM r WHERE s_suppkey % 3 = 0""")
def h5_label_value_records(spark, d):
    out = dr.label_value_records(profiles(spark, d).where("origin = 'Organicbio'"))
    return out.select("url", "name", "streetAddress", "addressCountry", "telephone", "yearEstablished", "mainActivity",
                      F.array_join("keywords", "|").alias("keywords"))


@register("H6_directory_records", f"""{_ROWS}
SELECT url, s_name AS name, n_name AS "addressCountry", concat(trim(s_address), ';Town') AS "addressRaw", s_phone AS telephone,
 concat('http://s', s_suppkey, '.example') AS website, CAST(yr AS INTEGER) AS "yearEstablished", 'Tea|Oil' AS keywords, 'A & B|C' AS brands
FROM r WHERE s_suppkey % 3 = 1""")
def h6_directory_records(spark, d):
    out = dr.directory_records(profiles(spark, d).where("origin = 'Europages'"))
    return out.select("url", "name", "addressCountry", "addressRaw", "telephone", "website", "yearEstablished",
                      F.array_join("keywords", "|").alias("keywords"), F.array_join("brands", "|").alias("brands"))


@register("H8_document_links", f"""{_ROWS}
SELECT url, 0 AS pos, concat('Doc ', s_suppkey) AS document, '/d.pdf' AS link FROM r WHERE s_suppkey % 3 = 1""")
def h8_document_links(spark, d):
    return dr.document_links(profiles(spark, d).where("origin = 'Europages'"))


_H12 = {  # field: value on a label/value page, on a class-driven page
    "streetAddress": ("s_address", "''"), "postalCode": ("'x'", "''"), "addressLocality": ("'x'", "''"), "addressRegion": ("'x'", "''"),
    "addressCountry": ("n_name", "n_name"), "addressRaw": ("''", "concat(s_address, ';Town')"), "telephone": ("s_phone", "s_phone"),
    "contactEmail": ("'x'", "''"), "website": ("'x'", "concat('http://s', s_suppkey, '.example')"),
    "registrationNumber": ("'x'", "''"), "facilitySize": ("'x'", "''"), "yearEstablished": ("CAST(yr AS INTEGER)", "CAST(yr AS INTEGER)"),
    "mainActivity": ("'Growing & trade, Export, more'", "''"), "vatId": ("''", "''"), "revenue": ("''", "''"), "employeesSite": ("''", "''"),
    "keywords": ("'export|growing & trade'", "'Tea|Oil'"), "certifications": ("'x'", "''"), "brands": ("''", "'A & B|C'"), "incoterms": ("''", "''"),
    "description": ("'x'", "''"), "logoUrl": ("''", "''")}
_H12_SQL = ",\n ".join(f'CASE s_suppkey % 3 WHEN 0 THEN {a} WHEN 1 THEN {b} END AS "{f}"' for f, (a, b) in _H12.items())


@register("H12_extract_by_origin", f"""{_ROWS}
SELECT url, CASE s_suppkey % 3 WHEN 0 THEN 'Organicbio' WHEN 1 THEN 'Europages' ELSE 'Kompass' END AS origin,
 CASE WHEN s_suppkey % 3 < 2 THEN s_name END AS name, CASE WHEN s_suppkey % 3 = 2 THEN 'unknown origin' END AS reason,
 {_H12_SQL} FROM r""")
def h12_extract_by_origin(spark, d):
    out = dr.extract_by_origin(profiles(spark, d))
    return out.select(*[F.array_join(c, "|").alias(c) if c in dr.LISTS else c for c in (*dr.FIELDS, "reason")])
