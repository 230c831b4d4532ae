"""Directory discovery (P3): seeds to listing pages to company links to records.

All state is one queue table (_id, kind, origin, url, discovered): a wave takes
the pending rows, looks their pages up, and adds what they lead to unless the
queue or the store has it.  A run that is cut short goes on from the queue and
the records it has written; html is read in the lookup and never kept.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcinglens.operators import elements as el
from sourcinglens.operators.directories import extract_by_origin, plain
from sourcinglens.operators.html import PAGER_SEGMENT, decode_entities
from sourcinglens.operators.ingest import insert_if_absent, update_queue
from sourcinglens.session import cut_lineage

# Classes of the pager's labels and of a company's link.
PAGE_LABEL, COMPANY = "page", "company-name"
NEXT = {"seed": "listing", "listing": "profile"}
QUEUE = ("_id", "kind", "origin", "url", "discovered")


def seed_rows(seeds: DataFrame) -> DataFrame:
    """Listing seeds (url, origin; J4) as pending queue rows."""
    return seeds.select(F.concat(F.lit("seed:"), F.col("url")).alias("_id"), F.lit("seed").alias("kind"), "origin", "url",
                        F.lit(0.0).alias("discovered")).distinct()


def page_count(html: Column) -> Column:
    """A8 for one page: the largest whole number among the pager's labels, at least 1."""
    labels = F.transform(el.inner(el.pieces_of(html), lambda p: el.has_class(p, PAGE_LABEL)), lambda t: plain(t))
    numbers = F.transform(F.filter(labels, lambda t: t.rlike("^[0-9]{1,9}$")), lambda t: t.cast("int"))
    return F.greatest(F.lit(1), F.coalesce(F.array_max(numbers), F.lit(1)))


def company_links(html: Column) -> Column:
    """Targets of the elements that carry a company's class, in page order."""
    tags = F.filter(el.pieces_of(html), lambda p: el.has_class(p, COMPANY))
    return F.filter(F.transform(tags, lambda p: F.trim(decode_entities(F.regexp_extract(
        p, r"""(?is)\shref\s*=\s*["']([^"']*)["']""", 1)))), lambda u: u != "")


def _targets(kind: str) -> Column:
    """What a fetched page of a kind leads to: array of urls."""
    if kind == "seed":
        return F.transform(F.sequence(F.lit(1), page_count(F.col("html"))), lambda n: F.concat(
            F.regexp_extract("url", r"^(.*/)([^/]*)$", 1), F.lit(PAGER_SEGMENT), n.cast("string"), F.lit("/"),
            F.regexp_extract("url", r"^(.*/)([^/]*)$", 2)))
    return company_links(F.col("html"))


def discover_directory(queue: DataFrame, pages: DataFrame, stored: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(records, queue) once nothing is pending.

    ``queue``: QUEUE columns, from ``seed_rows`` or an earlier run; ``pages``:
    (url, html), one row per url; ``stored``: (_id) of records there already,
    which are not looked at again.  A row whose page is missing, and a profile
    that is none, gets discovered = -2; null and empty pages lead nowhere.
    Seeds lead to listing pages and these to profiles, so the waves end; a url
    that many pages lead to enters the queue once.
    """
    queue = cut_lineage(queue.select(*QUEUE))
    records = None
    while kinds := {r.kind for r in queue.where("discovered = 0").select("kind").distinct().collect()}:        # three at most
        wanted = queue.where("discovered = 0").select("_id", "kind", "origin", "url")
        found, outcomes = [], []
        for kind in sorted(kinds - {"profile"}):
            # Targets are taken in the scan: html is not shuffled into the queue.
            led = cut_lineage(pages.select("url", _targets(kind).alias("found")).join(wanted.where(F.col("kind") == kind), "url"))
            outcomes.append(led.select("_id", F.lit(True).alias("ok")))
            next_kind = NEXT[kind]
            found.append(led.select("origin", F.explode("found").alias("url")).select(
                F.concat(F.lit(next_kind + ":"), "url").alias("_id"), F.lit(next_kind).alias("kind"), "origin", "url", F.lit(0.0).alias("discovered")))
        if "profile" in kinds:
            read = cut_lineage(extract_by_origin(
                pages.join(wanted.where("kind = 'profile'").select("url", "origin"), "url").select("url", "origin", "html")))
            good = read.where("reason IS NULL").drop("reason")
            records = good if records is None else records.unionByName(good)
            outcomes.append(read.select(F.concat(F.lit("profile:"), "url").alias("_id"), F.col("reason").isNull().alias("ok")))
        met = functools.reduce(DataFrame.unionByName, outcomes)
        met = wanted.select("_id").join(met, "_id", "left").select("_id", F.coalesce("ok", F.lit(False)).alias("ok"))
        after = update_queue(queue, met, now).select(*QUEUE)
        if found:
            known = stored.select(F.concat(F.lit("profile:"), "_id").alias("_id")).unionByName(queue.select("_id"))
            new = functools.reduce(DataFrame.unionByName, found)
            after = after.unionByName(insert_if_absent(new, known, order=["origin"]).select(*QUEUE))
        queue = cut_lineage(after)
    if records is None:
        records = extract_by_origin(pages.limit(0).select("url", F.lit("").alias("origin"), "html")).drop("reason")
    return records, queue
