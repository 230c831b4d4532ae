"""Directory profile pages to supplier records (H5, H6, H8) and their routing
(H12).

Both page families have a fixed layout, so a page is read by column
expressions in the scan: label/value tables by cell position, class-driven
profiles by the class that marks a field.  Only the record leaves the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcinglens.functions import records as rc
from sourcinglens.functions.urls import fix_double_scheme
from sourcinglens.operators import elements as el
from sourcinglens.operators.html import decode_entities

# The cell of each field in a label/value profile (first is 0).
CELLS = {"name": 0, "streetAddress": 1, "postalCode": 2, "addressLocality": 3, "addressRegion": 4, "addressCountry": 5,
         "telephone": 6, "contactEmail": 8, "website": 9, "mainActivity": 10, "registrationNumber": 13, "certification": 15,
         "facilitySize": 16, "yearEstablished": 17, "keywords": 19, "description": 23}
CELL = r"(?is)</th>\s*<td\b[^>]*>(.*?)</td>"
# The class that marks a field of a class-driven profile.
CLASSES = {"name": "company-content__company-name", "telephone": "js-num-tel", "revenue": "icon-key-ca",
           "employeesSite": "icon-key-people", "description": "company-description"}
FIELDS = ("url", "origin", "name", "streetAddress", "postalCode", "addressLocality", "addressRegion", "addressCountry",
          "addressRaw", "telephone", "contactEmail", "website", "mainActivity", "registrationNumber", "vatId", "revenue",
          "employeesSite", "facilitySize", "yearEstablished", "keywords", "certifications", "brands", "incoterms",
          "description", "logoUrl")
LISTS = ("keywords", "certifications", "brands", "incoterms")


def plain(html: Column) -> Column:
    """Text of a piece of HTML: tags out, entities decoded, ends trimmed."""
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(html, r"<[^>]*>", "")), r"^\s+|\s+$", ""))


def by_class(html: Column, name: str) -> Column:
    """Inner HTML of every element that carries the class."""
    pattern = rf"""(?is)<(\w+)\b[^>]*\sclass\s*=\s*["'](?:[^"']*\s)?{name}(?:\s[^"']*)?["'][^>]*>(.*?)</\1\s*>"""
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(2))


def _first(html: Column, pattern: str) -> Column:
    return plain(F.regexp_extract(html, pattern, 1))


def _complete(df: DataFrame) -> DataFrame:
    """All FIELDS in order; what a page family lacks is '' or an empty list.
    The country's normal form is taken of the finished column: its Arrow
    function can't be planned over the expressions that find the cell."""
    have = set(df.columns)
    none = F.array().cast("array<string>")
    out = df.select(*[F.col(f) if f in have else (none if f in LISTS else F.lit(None).cast("int") if f == "yearEstablished" else F.lit("")).alias(f) for f in FIELDS])
    return out.withColumn("addressCountry", rc.normalise_country("addressCountry"))


def label_value_records(pages: DataFrame, cells: dict[str, int] = CELLS) -> DataFrame:
    """H5: th/td profiles -> one record per page (url, html, origin).  A cell
    that is missing gives ''; links inside locality and keywords are no text."""
    p = pages.withColumn("_cells", F.regexp_extract_all("html", F.lit(CELL), F.lit(1)))
    raw = {f: F.coalesce(F.get("_cells", F.lit(i)), F.lit("")) for f, i in cells.items()}
    unlinked = {f: F.regexp_replace(raw[f], r"(?is)<a\b[^>]*>.*?</a>", "") for f in ("addressLocality", "keywords")}
    out = {f: plain(v) for f, v in (raw | unlinked).items()}
    out["mainActivity"] = F.array_join(F.filter(F.transform(
        F.split(raw["mainActivity"], r"<[^>]*>"), lambda t: F.trim(decode_entities(t))), lambda t: t != ""), ", ")
    out["keywords"] = rc.clean_keywords(F.array_join(F.filter(F.transform(
        F.split(unlinked["keywords"], r"<[^>]*>"), lambda t: F.trim(decode_entities(t))), lambda t: t != ""), "|"))
    out["yearEstablished"] = rc.to_year(out["yearEstablished"])
    out["certifications"] = F.array_remove(F.array(out.pop("certification")), "")
    out["logoUrl"] = F.regexp_extract("html", r"""(?is)id\s*=\s*["']content2["'][^>]*>.*?<img\b[^>]*?\ssrc\s*=\s*["']([^"']*)["']""", 1)
    return _complete(p.select("url", "origin", *[v.alias(f) for f, v in out.items()]))


def directory_records(pages: DataFrame) -> DataFrame:
    """H6: class-driven profiles -> one record per page (url, html, origin)."""
    h = F.col("html")
    field = {f: plain(F.coalesce(F.get(by_class(h, c), F.lit(0)), F.lit(""))) for f, c in CLASSES.items()}
    items = r"(?is)<li\b[^>]*>(.*?)</li>"

    def organisation(label: str) -> Column:
        return rc.strip_controls(_first(h, rf"(?is)<span\b[^>]*>\s*{label}\s*</span>\s*<span\b[^>]*>(.*?)</span>"))

    out = field | {
        "addressCountry": _first(h, r"""(?is)class\s*=\s*["'][^"']*\bflag-1x\b[^"']*["'][^>]*>\s*(?:</\w+>)?\s*<span\b[^>]*>(.*?)</span>"""),
        "addressRaw": rc.normalise_raw_address(_first(h, r"(?is)<pre\b[^>]*>(.*?)</pre>")),
        "website": fix_double_scheme(F.regexp_extract("html", r"""(?is)<a\b(?=[^>]*\bpage-action\b)(?=[^>]*itemprop\s*=\s*["']url["'])[^>]*?\shref\s*=\s*["']([^"']*)["']""", 1)),
        "yearEstablished": rc.to_year(organisation("Year established")),
        "mainActivity": organisation("Main activity"),
        "vatId": _first(h, r"""(?is)itemprop\s*=\s*["']vatID["'][^>]*>(.*?)<"""),
        "keywords": F.transform(by_class(h, "keyword-tag"), plain),
        "brands": F.transform(F.regexp_extract_all(F.coalesce(F.get(by_class(h, "brand-list"), F.lit(0)), F.lit("")), F.lit(items), F.lit(1)), plain),
        "incoterms": F.transform(by_class(h, "u-biggest"), plain),
        "description": rc.clean_description(field["description"]),
        "logoUrl": F.regexp_extract("html", r"""(?is)company-logo--container\b[^>]*>.*?<img\b[^>]*?\ssrc\s*=\s*["']([^"']*)["']""", 1)}
    return _complete(pages.select("url", "origin", *[v.alias(f) for f, v in out.items()]))


def document_links(pages: DataFrame) -> DataFrame:
    """H8: (url, pos, document, link) of the documents a page offers."""
    each = F.posexplode(F.regexp_extract_all("html", F.lit(
        r"""(?is)(<(\w+)\b[^>]*\sclass\s*=\s*["'](?:[^"']*\s)?js-click-out(?:\s[^"']*)?["'][^>]*>.*?</\2\s*>)"""), F.lit(1))).alias("pos", "part")
    d = pages.select("url", each)
    label = F.replace(plain(F.coalesce(F.get(by_class(F.col("part"), "label"), F.lit(0)), F.lit(""))), F.lit(" "), F.lit(" "))
    return d.select("url", "pos", label.alias("document"), F.regexp_extract(
        "part", r"""(?is)<a\b[^>]*?\shref\s*=\s*["']([^"']*)["']""", 1).alias("link"))


# Fixed value: no further product page is read after this one.
PRODUCT_PAGES = 31


def product_lines(pages: DataFrame, key: str = "url") -> DataFrame:
    """H7: (key, products): "name (detail)" of every product of a supplier, in
    page order.  ``pages``: (key, page, html), page numbers from 1, one row each.

    Reading stops after the first page without a next button behind its page
    numbers, before a page that is missing, and after PRODUCT_PAGES pages.
    Pages are dealt to tasks one by one and reduced there to their lines; only
    lines and one flag per page, at most PRODUCT_PAGES of them, are gathered for
    a supplier.  A
    supplier whose first page is missing has no row; an item without name and
    detail is an empty line.
    """
    pieces = el.pieces_of(F.col("html"))
    items = el.inner(pieces, lambda p: el.has_class(p, "products-list--item"))

    def line(item: Column) -> Column:
        cut = F.split(item, "(?=<)")
        links = F.flatten(F.transform(el.inner(cut, lambda p: el.has_class(p, "ellipsis")), lambda e: el.inner(
            F.split(e, "(?=<)"), lambda p: el.is_tag(p, "a"))))
        detail = F.get(el.inner(cut, lambda p: el.has_class(p, "no-h")), F.lit(0))
        return F.concat(F.coalesce(plain(F.get(links, F.lit(0))), F.lit("")),
                        F.coalesce(F.concat(F.lit(" ("), plain(detail), F.lit(")")), F.lit("")))

    more = el.bound(pieces, lambda p: F.exists(el.ranges(p, lambda x: el.has_class(x, "page")), lambda r: F.coalesce(
        el.has_class(F.get(p, r["stop"] + 1), "prevnext"), F.lit(False))))
    # Reading pages is work for many tasks even where they come from few megabytes.
    spread = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pages.where(F.col("page").between(1, PRODUCT_PAGES)).repartition(spread, key, "page")
    each = dealt.select(key, F.struct(
        "page", F.transform(items, line).alias("lines"), more.alias("more")).alias("p"))
    merged = each.groupBy(key).agg(F.array_sort(F.collect_list("p")).alias("ps"))
    # Page k is reached if pages 1 to k - 1 are there and each of them has a next one.
    reached = F.aggregate("ps", F.lit(0), lambda n, p: F.when(
        (p["page"] == n + 1) & ((n == 0) | F.get(F.col("ps"), n - 1)["more"]), n + 1).otherwise(n))
    read = merged.withColumn("n", reached).where("n > 0")
    return read.select(key, F.flatten(F.transform(F.slice("ps", F.lit(1), F.col("n")), lambda p: p["lines"])).alias("products"))


def extract_by_origin(pages: DataFrame) -> DataFrame:
    """Each page by its directory's extractor -> FIELDS and ``reason``:
    why there is no record ('unknown origin', 'no profile'), else NULL."""
    known = {"Organicbio": label_value_records, "Europages": directory_records}
    out = None
    for origin, extract in known.items():
        rows = extract(pages.where(F.col("origin") == origin)).withColumn(
            "reason", F.when(F.col("name") == "", F.lit("no profile")))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    other = pages.where(~F.coalesce(F.col("origin").isin(*known), F.lit(False))).select("url", "origin", F.lit("unknown origin").alias("reason"))
    return out.unionByName(other, allowMissingColumns=True)
