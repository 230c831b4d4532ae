"""Record-cleaning column functions (T12-T17, T22-T24) and entity structs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcinglens.functions.urls import url_root

# Fixed values.
DESCRIPTION_MARKER = "Other companies in the same industry"
COUNTRY_ALIASES = (("USA", "United States"),)
EMAIL_STATUS = "Unclear"
DIRECTORY_ORIGINS = ("Organicbio", "Europages", "Kompass")

EMAIL_T = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("email", T.StringType()),
    T.StructField("origin", T.StructType([T.StructField("_type", T.StringType()),
                                          T.StructField("source", T.StringType())])),
    T.StructField("status", T.StringType()), T.StructField("dateCreated", T.TimestampType()),
])
WEBSITE_T = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("url_root", T.StringType()),
    T.StructField("origin", T.StringType()), T.StructField("probability", T.DoubleType()),
    T.StructField("dateCreated", T.TimestampType()), T.StructField("lastModified", T.TimestampType()),
])


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def title_case(col: Column | str) -> Column:
    """Collapse white space, trim, capitalise each space-separated word."""
    return F.initcap(F.trim(F.regexp_replace(_c(col), r"(?U)\s+", " ")))


@F.pandas_udf(T.StringType())
def nfkd(s: pd.Series) -> pd.Series:
    """NFKD normal form (no Spark built-in); Arrow batches, not rows."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


def normalise_country(col: Column | str) -> Column:
    """NFKD, trimmed, with country aliases applied."""
    c = F.trim(nfkd(_c(col)))
    for alias, name in COUNTRY_ALIASES:
        c = F.when(c == alias, F.lit(name)).otherwise(c)
    return c


def normalise_raw_address(col: Column | str) -> Column:
    """Raw address lines joined by ';' ('\\n' -> ';', ' ;' -> '; ')."""
    c = F.replace(_c(col), F.lit("\n"), F.lit(";"))
    return F.replace(c, F.lit(" ;"), F.lit("; "))


def clean_keywords(col: Column | str) -> Column:
    """Split on '|', strip trailing ' -', trim, lower, distinct (sorted)."""
    parts = F.split(_c(col), r"\|")
    cleaned = F.transform(parts, lambda k: F.lower(F.trim(F.regexp_replace(k, r"[ -]+$", ""))))
    return F.array_sort(F.array_distinct(F.filter(cleaned, lambda k: k != "")))


def clean_description(col: Column | str) -> Column:
    """Newlines to spaces, collapse runs of spaces, cut at the marker."""
    c = F.regexp_replace(F.replace(_c(col), F.lit("\n"), F.lit(" ")), " +", " ")
    return F.substring_index(c, DESCRIPTION_MARKER, 1)


def strip_controls(col: Column | str) -> Column:
    """T16: '\\n', '\\t', '\\r' to spaces, collapse runs of spaces."""
    return F.regexp_replace(F.translate(_c(col), "\n\t\r", "   "), " +", " ")


def to_year(col: Column | str) -> Column:
    """Integer year or NULL."""
    return F.trim(_c(col)).try_cast("int")


def make_email(email: Column | str, type_: Column | str, source: Column | str, now: Column | None = None) -> Column:
    """Email entity struct with a deterministic id."""
    e, t, s = _c(email), _c(type_), _c(source)
    now = F.current_timestamp() if now is None else now
    return F.struct(F.sha2(F.concat_ws("|", e, s), 256).alias("id"), e.alias("email"),
                    F.struct(t.alias("_type"), s.alias("source")).alias("origin"),
                    F.lit(EMAIL_STATUS).alias("status"), now.alias("dateCreated"))


def make_email_array(email: Column | str, type_: Column | str, source: Column | str,
                     now: Column | None = None) -> Column:
    """[email struct], or [] when the email or its origin is ''."""
    e, s = _c(email), _c(source)
    return F.when((F.coalesce(e, F.lit("")) != "") & (F.coalesce(s, F.lit("")) != ""),
                  F.array(make_email(e, type_, s, now))).otherwise(F.array().cast(T.ArrayType(EMAIL_T)))


def make_website(url: Column | str, origin: Column | str, now: Column | None = None,
                 probability: Column | None = None) -> Column:
    """Website entity struct (probability unknown = NULL)."""
    u, o = _c(url), _c(origin)
    now = F.current_timestamp() if now is None else now
    p = F.lit(None).cast("double") if probability is None else probability
    return F.struct(u.alias("url"), url_root(u).alias("url_root"), o.alias("origin"), p.alias("probability"),
                    now.alias("dateCreated"), now.alias("lastModified"))


def make_website_array(url: Column | str, origin: Column | str, now: Column | None = None) -> Column:
    """[website struct], or [] when the url or origin is ''."""
    u, o = _c(url), _c(origin)
    return F.when((F.coalesce(u, F.lit("")) != "") & (F.coalesce(o, F.lit("")) != ""),
                  F.array(make_website(u, o, now))).otherwise(F.array().cast(T.ArrayType(WEBSITE_T)))


def mark_discovered(ok: Column, now_epoch: Column) -> Column:
    """Epoch seconds on success, -2 on failure."""
    return F.when(ok, now_epoch.cast("double")).otherwise(F.lit(-2.0))


def request_name(product: Column | str, countries: Column | str) -> Column:
    """T24: 'product in A, B'."""
    return F.concat(_c(product), F.lit(" in "), F.concat_ws(", ", _c(countries)))
