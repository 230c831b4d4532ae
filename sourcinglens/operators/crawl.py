"""Crawl closure over a link graph (R8) and site emails.

Breadth-first, level by level, all sites at once: frontier joined with edges,
minus visited (anti-join), ordered by (depth, parent order, link position).
The budget counts *successful* pages per site.  The counts so far are a table
of their own, one row per site; a site that has met its budget is not walked
further, and the walk ends when no site has a frontier.  Each new level is cut
on the shared checkpoint folder.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourcinglens.functions.records import make_email
from sourcinglens.operators.html import emails_in_pages
from sourcinglens.session import cut_lineage

# Fixed value: pages per email crawl (stop after the 31st success).
CRAWL_BUDGET = 31


def crawl_closure(edges: DataFrame, roots: DataFrame, ok: DataFrame, budget: int = CRAWL_BUDGET) -> DataFrame:
    """Pages visited per site: (site, page, depth, order, success).

    ``edges``: (src, dst, pos) links inside a site; ``roots``: (site, page);
    ``ok``: (page, success boolean).  Visiting stops once ``budget``
    successes are reached (the page that reaches it is the last visited).
    """
    known = ok.select("page", "success")

    def with_success(level: DataFrame) -> DataFrame:
        return cut_lineage(level.join(known, "page", "left").withColumn("success", F.coalesce("success", F.lit(False))))

    level = with_success(roots.select("site", "page", F.lit(0).alias("depth"), F.array(F.lit(0)).alias("order")))
    levels, reached = [level], None
    while not level.isEmpty():
        now = level.where("success").groupBy("site").agg(F.count("*").alias("n"))
        reached = cut_lineage(now if reached is None else reached.unionByName(now).groupBy("site").agg(F.sum("n").alias("n")))
        visited = functools.reduce(DataFrame.unionByName, levels)
        nxt = (level.join(reached.where(F.col("n") >= budget), "site", "left_anti")
               .select("site", F.col("page").alias("src"), F.col("order").alias("porder"))
               .join(edges.select("src", "dst", "pos"), "src")
               .select("site", F.col("dst").alias("page"), F.concat("porder", F.array("pos")).alias("order")))
        # first discovery of a page wins (lowest order)
        nxt = nxt.groupBy("site", "page").agg(F.min("order").alias("order"))
        nxt = nxt.join(visited.select("site", "page"), ["site", "page"], "left_anti")
        level = with_success(nxt.select("site", "page", (F.size("order") - 1).alias("depth"), "order"))
        levels.append(level)
    walked = functools.reduce(DataFrame.unionByName, levels)
    # the place of the success that meets the budget: a top-k per site, so a
    # long last level is cut to ``budget`` rows per task before it moves
    w = Window.partitionBy("site").orderBy("depth", "order")
    first = walked.where("success").select("site", "depth", "order", F.row_number().over(w).alias("_n")).where(F.col("_n") <= budget)
    last = first.groupBy("site").agg(F.count("*").alias("_n"), F.max(F.struct("depth", "order")).alias("_last"))
    met = last.where(F.col("_n") == budget).select("site", "_last")
    return walked.join(met, "site", "left").where(
        F.col("_last").isNull() | (F.struct("depth", "order") <= F.col("_last"))).drop("_last")


def site_emails(pages: DataFrame, closure: DataFrame, source: str = "site") -> DataFrame:
    """Distinct emails over each site's closure, as email structs.  Emails
    are taken from the html before the join, so html is never shuffled."""
    visited = closure.where("success").select("site", "page")
    found = emails_in_pages(pages.select(F.col("page_id").alias("page"), "html"), ["page"], text="html")
    em = found.join(visited, "page").select("site", "email").distinct()
    return em.select("site", "email", make_email(F.col("email"), F.lit("Website"), F.col(source)).alias("entity"))
