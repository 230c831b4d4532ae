"""Supplier statistics (A1-A8): one scan per question, no N+1 loops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcinglens.session import cut_lineage
from sourcinglens.operators.filters import is_nonempty, map_nonempty
from sourcinglens.operators.joins import label_codes

# Directory origins and their website probability.
DIRECTORY_PROBABILITY = 0.7
DIRECTORY_ORIGINS = ("Organicbio", "Europages", "Kompass")
KOMPASS = "Kompass"


def _country(df: DataFrame):
    return F.col("postalAddress.addressCountry")


def _filtered(df: DataFrame, countries: Sequence[str]) -> DataFrame:
    return df.where(_country(df).isin(list(countries))) if countries else df


def supplier_counts(df: DataFrame, countries: Sequence[str] = ()) -> DataFrame:
    """A1: total, and total within the countries (one pass)."""
    inside = _country(df).isin(list(countries)) if countries else F.lit(True)
    return df.agg(F.count(F.lit(1)).alias("nb_total"), F.count_if(inside).alias("nb_suppliers"))


def origin_coverage(df: DataFrame, countries: Sequence[str] = ()) -> DataFrame:
    """A2: per origin, rows and rows with non-empty classifications."""
    return _filtered(df, countries).groupBy("origin").agg(
        F.count(F.lit(1)).alias("all_count"),
        F.count_if(map_nonempty("classifications")).alias("with_classifications"))


def classification_coverage(df: DataFrame, classifications: Sequence[str], countries: Sequence[str] = ()) -> DataFrame:
    """A3: per origin x classification, suppliers with a non-empty value;
    origins without any classification are skipped (as A2 = 0)."""
    f = _filtered(df, countries)
    cls = F.array(*[F.lit(c) for c in classifications])
    rows = f.select("origin", "classifications", F.explode(cls).alias("classification"))
    val = F.element_at(F.col("classifications"), F.col("classification"))
    out = rows.groupBy("origin", "classification").agg(F.count_if(F.coalesce(is_nonempty(val), F.lit(False)))
                                                       .alias("non_empty"))
    cov = origin_coverage(df, countries).where(F.col("with_classifications") > 0).select("origin")
    return out.join(cov, "origin", "left_semi")


def top_codes(df: DataFrame, codes: DataFrame, k: int = 10, only_relevant: bool = True,
              countries: Sequence[str] = ()) -> DataFrame:
    """A4: per classification the k most frequent codes with label and count.

    Kompass values are unwound (one count per code); other classifications are
    grouped on the whole value and looked up by its first element.  Unknown
    codes count towards k; non-relevant ones are skipped and don't.
    Ties are broken by code.
    """
    f = _filtered(df, countries)
    nb = f.agg(F.count(F.lit(1)).alias("nb_suppliers"))
    entries = f.select(F.explode("classifications").alias("classification", "value")).where(is_nonempty("value"))
    kompass = entries.where(F.col("classification") == KOMPASS).select(
        "classification", F.explode("value").alias("code"), F.lit(None).cast("string").alias("value_key"))
    others = entries.where(F.col("classification") != KOMPASS).select(
        "classification", F.element_at("value", 1).alias("code"), F.array_join("value", ",").alias("value_key"))
    counts = kompass.unionByName(others).groupBy("classification", "value_key", "code").agg(
        F.count(F.lit(1)).alias("count"))
    labelled = label_codes(counts, codes)
    if only_relevant:
        labelled = labelled.where(~F.col("found") | (F.col("relevant") == 1))
    w = Window.partitionBy("classification").orderBy(F.col("count").desc(), F.col("code"),
                                                     F.col("value_key"))
    top = labelled.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.withColumn("_k", F.lit(0)).join(F.broadcast(nb.withColumn("_k", F.lit(0))), "_k").select(
        "classification", "code", "label", "found", "count", "rank", "nb_suppliers")


def suppliers_by_country(df: DataFrame) -> DataFrame:
    """A5: supplier count per country, descending (no country filter)."""
    return df.groupBy(_country(df).alias("country")).agg(F.count(F.lit(1)).alias("count")).orderBy(
        F.col("count").desc(), F.col("country"))


def website_probability(df: DataFrame, directory_p: float = DIRECTORY_PROBABILITY,
                        directories: Sequence[str] = DIRECTORY_ORIGINS) -> DataFrame:
    """Probability of each enrichment candidate: directory-sourced ones
    take ``directory_p``; others the share of their root among all roots.

    Root counts are a hash aggregate; the grand total is a one-row aggregate
    joined on a constant key (no global window)."""
    cands = df.select("_id", F.explode("companydataEnriched").alias("w")).select(
        "_id", F.col("w.url").alias("url"), F.col("w.url_root").alias("url_root"), F.col("w.origin").alias("origin"))
    roots = cands.groupBy("url_root").agg(F.count(F.lit(1)).alias("n_root"))
    total = cands.agg(F.count(F.lit(1)).alias("n_all")).withColumn("_k", F.lit(0))
    share = roots.withColumn("_k", F.lit(0)).join(F.broadcast(total), "_k").select(
        "url_root", (F.col("n_root") / F.col("n_all")).alias("share"))
    return cands.join(share, "url_root").select(
        "_id", "url", "url_root", "origin",
        F.when(F.col("origin").isin(list(directories)), F.lit(directory_p)).otherwise(F.col("share"))
        .alias("probability"))


def suppliers_without_text(shortlist: DataFrame, keys: Sequence[str] = ("request_id",)) -> DataFrame:
    """Per request, short-listed suppliers that got no text."""
    return shortlist.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_suppliers"),
        F.count_if(F.size(F.coalesce("text", F.array())) == 0).alias("n_without_text"))


def listing_page_count(pager: DataFrame) -> DataFrame:
    """Largest numeric pager label per listing URL, at least 1.

    ``pager``: (url, value) rows of the pager elements (from ``select_text``)."""
    num = F.when(F.col("value").rlike(r"^[0-9]+$"), F.col("value").try_cast("int"))
    return pager.groupBy("url").agg(F.greatest(F.lit(1), F.coalesce(F.max(num), F.lit(1))).alias("max_pages"))


def statistics(df: DataFrame, codes: DataFrame, classifications: Sequence[str], countries: Sequence[str] = (),
               k: int = 10) -> DataFrame:
    """A1 to A5 from one scan: (statistic, origin, classification, code,
    value_key, country, label, count, part, rank).

    Each supplier gives one short list of entries, an entry naming the keys of
    the one statistic that it counts for; a single aggregation, combined on the
    map side, counts them all.  ``part``: the suppliers inside ``countries``
    (total), with classifications (origin), with a value (classification).
    Origins without any classification have no classification rows; codes are
    ranked and cut as in A4.
    """
    inside = F.coalesce(_country(df).isin(list(countries)), F.lit(False)) if countries else F.lit(True)
    keys = ("statistic", "origin", "classification", "code", "value_key", "country")

    def entry(statistic: str, part: Column, **named: Column) -> Column:
        return F.struct(F.lit(statistic).alias("statistic"), *[named.get(c, F.lit(None)).cast("string").alias(c) for c in keys[1:]],
                        F.coalesce(part, F.lit(False)).alias("part"))

    values = F.col("classifications")
    covered = [entry("classification", is_nonempty(F.try_element_at(values, F.lit(c))), origin=F.col("origin"), classification=F.lit(c))
               for c in classifications]
    full = F.filter(F.coalesce(F.map_entries(values), F.array().cast("array<struct<key:string,value:array<string>>>")), lambda e: is_nonempty(e["value"]))
    counted = F.flatten(F.transform(full, lambda e: F.when(e["key"] == KOMPASS, F.transform(
        e["value"], lambda v: entry("code", F.lit(True), classification=e["key"], code=v))).otherwise(F.array(
            entry("code", F.lit(True), classification=e["key"], code=F.element_at(e["value"], 1), value_key=F.array_join(e["value"], ","))))))
    of_all = F.array(entry("total", inside), entry("country", F.lit(True), country=_country(df)))
    of_inside = F.concat(F.array(entry("origin", map_nonempty("classifications"), origin=F.col("origin")), *covered), counted)
    entries = df.select(F.explode(F.concat(of_all, F.when(inside, of_inside).otherwise(F.slice(of_inside, 1, 0)))).alias("e")).select("e.*")
    counts = cut_lineage(entries.groupBy(*keys).agg(F.count("*").alias("count"), F.count_if("part").alias("part")))

    known = counts.where("statistic = 'origin' AND part > 0").select("origin")
    others = counts.where("statistic IN ('total', 'origin', 'country')").unionByName(
        counts.where("statistic = 'classification'").join(known, "origin", "left_semi"))
    found = label_codes(counts.where("statistic = 'code'"), codes).where(~F.col("found") | (F.col("relevant") == 1))
    w = Window.partitionBy("classification").orderBy(F.col("count").desc(), F.col("code"), F.col("value_key"))
    top = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    none = {"label": F.lit(None).cast("string"), "rank": F.lit(None).cast("int")}
    return others.withColumns(none).unionByName(top.select(*others.columns, *none))
