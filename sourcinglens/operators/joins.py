"""Join operators (J1-J7, J9).  Catalyst picks the physical join; bounded
lookup sides are broadcast after a size check, the rest is left to AQE."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcinglens.functions.records import make_website

# Standard languages that may be added to every request, and
# the directory listing URL template.
STANDARD_LANGUAGES = ("en", "fr", "es", "de")
LISTING_BASE = "https://www.europages.co.uk/companies/"


def label_codes(counts: DataFrame, codes: DataFrame) -> DataFrame:
    """Code -> label lookup; unmatched codes kept with ``found`` = false.

    The lookup must be unique per (classification, code): duplicates are
    reported in ``dup`` (> 1) instead of multiplying rows.
    """
    lk = codes.groupBy("classification", "code").agg(
        F.first("label").alias("label"), F.first("relevant").alias("relevant"),
        F.count(F.lit(1)).alias("dup"))
    out = counts.join(lk, ["classification", "code"], "left")
    return out.withColumn("found", F.col("dup").isNotNull())


def request_languages(longlist: DataFrame, country_languages: DataFrame,
                      add_standard: bool = False) -> DataFrame:
    """Distinct language codes of the countries in each request's long list."""
    cl = country_languages.select(F.col("countryName").alias("country"), "languageCode")
    langs = (longlist.select("request_id", "country").distinct()
             .join(cl, "country")
             .select("request_id", F.explode(F.split("languageCode", ",")).alias("lang"))
             .select("request_id", F.trim("lang").alias("lang")))
    if add_standard:
        std = longlist.select("request_id").distinct().select(
            "request_id", F.explode(F.array(*[F.lit(x) for x in STANDARD_LANGUAGES])).alias("lang"))
        langs = langs.unionByName(std)
    return langs.distinct()


def new_documents(found: DataFrame, existing: DataFrame, key: str = "_id") -> DataFrame:
    """Discovered documents not stored yet (anti-join)."""
    return found.join(existing.select(key), key, "left_anti")


def url_quote(col) -> F.Column:
    """Percent-encode like a path quote: space -> %20, '/' and '~' kept."""
    e = F.url_encode(col)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        e = F.replace(e, F.lit(a), F.lit(b))
    return e


def listing_seeds(keywords: DataFrame, countries: DataFrame, base: str = LISTING_BASE) -> DataFrame:
    """Keyword x country listing URLs per request (joined on the request,
    never a cross join); keyword-only URL when a request has no countries."""
    k = keywords.select("request_id", "keyword")
    c = countries.select("request_id", "country")
    j = k.join(c, "request_id", "left")
    url = F.when(F.col("country").isNull(), F.concat(F.lit(base), F.col("keyword"), F.lit(".html"))).otherwise(
        F.concat(F.lit(base), url_quote(F.col("country")), F.lit("/"), F.col("keyword"), F.lit(".html")))
    return j.select("request_id", "keyword", "country", url.alias("url"), F.lit("Europages").alias("origin"))


def suppliers_with_hits(longlist: DataFrame, hits: DataFrame, keys: Sequence[str] = ("request_id",)) -> DataFrame:
    """Suppliers whose site has at least one hit, with their links (in
    result order) and hit totals.  One aggregation per (request, site), then
    an equi-join — the group-testing loop of the reference is not needed."""
    per_site = hits.groupBy(*keys, "site").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "link"))), lambda x: x["link"]).alias("links"),
        F.count(F.lit(1)).alias("n_hits"))
    return longlist.join(per_site.withColumnRenamed("site", "website"), [*keys, "website"])


def attach_candidates(suppliers: DataFrame, candidates: DataFrame, now=None) -> DataFrame:
    """Append found website structs to ``companydataEnriched``, in the
    order of url and origin, each pair once."""
    found = F.array_sort(F.collect_set(F.struct("url", "origin")))
    new = candidates.groupBy("_id").agg(
        F.transform(found, lambda c: make_website(c["url"], c["origin"], now)).alias("_new"))
    return (suppliers.join(new, "_id", "left")
            .withColumn("companydataEnriched",
                        F.concat(F.coalesce("companydataEnriched", F.array().cast("array<" + _website_ddl() + ">")),
                                 F.coalesce("_new", F.array().cast("array<" + _website_ddl() + ">"))))
            .drop("_new"))


def _website_ddl() -> str:
    from sourcinglens.functions.records import WEBSITE_T
    return WEBSITE_T.simpleString()


def expand_terms(groups: DataFrame, translations: DataFrame, languages: DataFrame) -> DataFrame:
    """Add each term's translation for each request language (trimmed);
    missing translations are skipped.  Output: (request_id, group_id, term)."""
    g = groups.select("request_id", "group_id", "term")
    tr = (g.join(languages.select("request_id", "lang"), "request_id")
          .join(translations.select("term", "lang", "text"), ["term", "lang"])
          .select("request_id", "group_id", F.trim("text").alias("term")))
    return g.unionByName(tr).distinct()


def candidate_pairs(names: DataFrame, domains: DataFrame, keys: Sequence[str] = ("request_id",)) -> DataFrame:
    """Company name x its candidate domain labels (equi-join on the request)."""
    return names.join(domains, list(keys))
