"""Search result pages (H9), paged product lines (H7) and directory discovery
(P3) over pages that Spark renders from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourcinglens.operators import directories as dr
from sourcinglens.operators import joins as jn
from sourcinglens.operators import search_pages as sp
from sourcinglens.plans import discovery as ds
from sourcinglens.plans.catalog import register
from sourcinglens.plans.q_directories import class_profile
from sourcinglens.sources.derived import SITE_RE
from sourcinglens.sources.tables import read_table

NOW = 1_700_000_000.0


def result_pages(spark, d):
    """(page_id, site, html): one search page per row of ``pages``: nested adverts, four results, a total."""
    def go(url):
        return F.concat(F.lit('<a class="d-ib mxw-100p" href="https://r.search.example/_ylt=A/RU='), F.url_encode(url), F.lit('/RK=2/RS=x">hit</a>'))

    ad = F.concat(F.lit("<div class='fc-smoke AdTop'><br><div><div>"), go(F.lit("https://ads.example/buy")),
                  F.lit("</div><span class='lh-22'>9,999 adverts</span></div>"))
    number = F.format_number(F.col("page_id") * 37 + 1000, 0)
    html = F.concat(F.lit("<html><body><!-- <a class='mxw-100p' href='/RU=x/'> --><div id=web>"), ad, F.lit("</div><ol><li>"), go(F.col("url")),
                    F.lit("</li><li><p>open "), go(F.concat(F.lit("https://other.example/?u="), "page_id")), F.lit("<li><a class='mxw-100p' href='/none'>x</a><li>"),
                    go(F.concat("site", F.lit("/a+b%20c"))), ad, F.lit("</ol><div class='pages fc-smoke'><b>1</b><span class=\"x lh-22\"> About <i>"),
                    number, F.lit("</i> results, page 2 </span></div></body></html>"))
    p = read_table(spark, d, "pages").select("page_id", "url", F.regexp_extract("url", SITE_RE, 1).alias("site"))
    return p.select("page_id", "site", html.alias("html"))


# The second advert is never closed: it ends with the list that holds it.
@register("H9_search_results", """
SELECT page_id, page_id * 37 + 1000 AS total, 0 AS pos, url AS link FROM pages
UNION ALL SELECT page_id, page_id * 37 + 1000, 2, concat(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1), '/a+b%20c') FROM pages""")
def h9_search_results(spark, d):
    pages = result_pages(spark, d)
    return sp.search_results(pages, pages.select("page_id", "site"))


def product_pages(spark, d):
    """(url, page, html): k % 35 product pages of supplier k; every tenth supplier lacks page 3, every tenth has no next
    button on page 2."""
    s = read_table(spark, d, "supplier").select("s_suppkey", "s_name")
    k, page = F.col("s_suppkey"), F.col("page")
    s = s.where(k % 35 > 0).select("*", F.explode(F.sequence(F.lit(1), (k % 35).cast("int"))).alias("page"))
    s = s.where(~((k % 10 == 3) & (page == 3)))
    item = F.concat(F.lit("<li class='products-list--item'><div class='ellipsis'><h3><a href='#'>"), "s_name", F.lit(" &amp; "), page)
    more = (page < k % 35) & ~((k % 10 == 7) & (page == 2))
    html = F.concat(F.lit("<ul>"), item, F.lit("</a></h3></div><p class='b no-h'>in <b>bulk</b></p></li>"), item,
                    F.lit(" b</a><a>not this</a></div></li></ul><p class='no-h'>outside</p><ul><li class='page current'><a>"), page,
                    F.lit("</a></li>"), F.when(more, "\n<li class='prevnext'><a>Next</a></li>").otherwise("<li class='end'></li>"), F.lit("</ul>"))
    return s.select(F.concat(F.lit("https://dir.example/"), k).alias("url"), "page", html.alias("html"))


@register("H7_product_lines", """
WITH n AS (SELECT concat('https://dir.example/', s_suppkey) AS url, s_name, s_suppkey AS k, least(31, CASE
  WHEN s_suppkey % 10 IN (3, 7) AND s_suppkey % 35 > 2 THEN 2 ELSE s_suppkey % 35 END) AS n FROM supplier)
SELECT url, CAST(2 * n AS INTEGER) AS n_lines,
 (SELECT string_agg(concat(s_name, ' & ', i, ' (in bulk)|', s_name, ' & ', i, ' b'), '|' ORDER BY i) FROM range(1, n.n + 1) t(i)) AS products
FROM n WHERE n > 0""")
def h7_product_lines(spark, d):
    out = dr.product_lines(product_pages(spark, d))
    return out.select("url", F.size("products").alias("n_lines"), F.array_join("products", "|").alias("products"))


def directory(spark, d):
    """Seeds, pages (url, html) and stored ids of a directory: the suppliers of
    each nation, by ranges of 50 keys a listing page, and their profiles.
    Every eleventh profile is missing, every seventh stored already."""
    n = read_table(spark, d, "nation").select("n_nationkey", "n_name")
    s = read_table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    s = s.withColumns({"url": F.concat(F.lit("https://dir.example/"), k), "year": (1900 + k % 120).cast("string"), "page": F.floor(k / 50) + 1,
                       "s_address": F.concat(F.lit("Rue "), k), "s_phone": F.concat(F.lit("+33 "), k)})
    request = F.lit("r").alias("request_id")
    seeds = jn.listing_seeds(n.select(request, F.lit("widgets").alias("keyword")).distinct(), n.select(request, F.col("n_name").alias("country")))
    place = F.concat(F.lit(jn.LISTING_BASE), jn.url_quote(F.col("n_name")), F.lit("/"))
    last = n.join(s.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.max("page").alias("last")), "n_nationkey", "left")
    labels = F.transform(F.sequence(F.lit(1), F.coalesce("last", F.lit(1)).cast("int")), lambda i: F.concat(F.lit("<a class='page'>"), i, F.lit("</a>")))
    first = last.select(F.concat(place, F.lit("widgets.html")).alias("url"), F.concat(F.lit("<div>"), F.array_join(labels, " "), F.lit(
        " <a class='page'>next</a></div>")).alias("html"))
    links = F.array_join(F.collect_list(F.concat(F.lit("<h2><a class='x company-name' href='"), "url", F.lit("'>c</a></h2>"))), "")
    listing = s.groupBy("n_name", "page").agg(links.alias("html")).select(
        F.concat(place, F.lit("pg-"), F.col("page").cast("string"), F.lit("/widgets.html")).alias("url"), F.concat("html", "html").alias("html"))
    profile = s.where(k % 11 != 0).select("url", class_profile().alias("html"))
    stored = s.where(k % 7 == 0).select(F.col("url").alias("_id"))
    return seeds, first.unionByName(listing).unionByName(profile), stored


def _discovered(spark, d):
    seeds, pages, stored = directory(spark, d)
    return ds.discover_directory(ds.seed_rows(seeds), pages, stored, F.lit(NOW))


@register("P3_discover_directory", """
SELECT concat('https://dir.example/', s_suppkey) AS url, 'Europages' AS origin, s_name AS name, n_name AS "addressCountry",
 concat('+33 ', s_suppkey) AS telephone, concat('http://s', s_suppkey, '.example') AS website
FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0""")
def p3_discover_directory(spark, d):
    return _discovered(spark, d)[0].select("url", "origin", "name", "addressCountry", "telephone", "website")


@register("P3_discovery_queue", """
WITH s AS (SELECT s_suppkey AS k, s_nationkey, s_suppkey // 50 + 1 AS page FROM supplier),
n AS (SELECT n_name, n_nationkey, concat('https://www.europages.co.uk/companies/', n_name, '/') AS place,
 (SELECT coalesce(max(page), 1) FROM s WHERE s_nationkey = n_nationkey) AS last FROM nation),
l AS (SELECT place, n_nationkey, unnest(range(1, last + 1)) AS page FROM n)
SELECT concat('seed:', place, 'widgets.html') AS _id, 'seed' AS kind, 1700000000.0::DOUBLE AS discovered FROM n
UNION ALL SELECT concat('listing:', place, 'pg-', page, '/widgets.html'), 'listing',
 CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.s_nationkey = l.n_nationkey AND s.page = l.page) THEN 1700000000.0 ELSE -2.0 END::DOUBLE FROM l
UNION ALL SELECT concat('profile:https://dir.example/', k), 'profile', CASE WHEN k % 11 = 0 THEN -2.0 ELSE 1700000000.0 END::DOUBLE
FROM s WHERE k % 7 <> 0""")
def p3_discovery_queue(spark, d):
    return _discovered(spark, d)[1].select("_id", "kind", "discovered")
