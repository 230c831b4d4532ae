"""Queries of operators that other modules only use inside a flow: J5, J9, A8,
U2, T11, R7, M4 and M5."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourcinglens.functions import text as tx
from sourcinglens.functions import urls
from sourcinglens.operators import filters as fl
from sourcinglens.operators import ingest as ig
from sourcinglens.operators import joins as jn
from sourcinglens.operators import stats as st
from sourcinglens.operators.linkage import best_domain
from sourcinglens.plans.catalog import register
from sourcinglens.plans.q_html import _DOMAIN_SQL, resolve_sql, visible_tokens_sql
from sourcinglens.sources import derived as dv
from sourcinglens.sources.fixture_sql import token_rows_sql, with_ctes
from sourcinglens.sources.tables import read_table


def company_hits(spark, d):
    """One result list per company: (request_id, pos, link); every page stands
    in the list of one company, so lists grow in number with the suppliers."""
    p = read_table(spark, d, "pages").select("page_id", "url")
    n = read_table(spark, d, "supplier").agg(F.count("*").alias("n"))
    return p.join(n).select(F.concat(F.lit("q"), (F.col("page_id") % F.col("n")).cast("string")).alias("request_id"),
                            F.col("page_id").alias("pos"), F.col("url").alias("link"))


def companies(spark, d):
    return read_table(spark, d, "supplier").select(
        F.concat(F.lit("q"), F.col("s_suppkey").cast("string")).alias("request_id"), F.col("s_name").alias("name"))


_LISTS = f"""lists AS (SELECT concat('q', CAST(page_id % (SELECT count(*) FROM supplier) AS VARCHAR)) AS request_id,
 page_id AS pos, url AS link FROM pages),
labelled AS (SELECT request_id, pos, {_DOMAIN_SQL} AS domain FROM (SELECT *,
 regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS h FROM lists) x),
names AS (SELECT concat('q', CAST(s_suppkey AS VARCHAR)) AS request_id, s_name AS name FROM supplier)"""


def company_pairs(spark, d):
    hits = company_hits(spark, d).withColumn("domain", urls.domain_label("link")).where("domain IS NOT NULL")
    return jn.candidate_pairs(companies(spark, d), hits.select("request_id", "pos", "domain"))


@register("J9_candidate_pairs", f"""
WITH {_LISTS} SELECT request_id, name, pos, domain FROM names JOIN labelled USING (request_id) WHERE domain IS NOT NULL""")
def j9_candidate_pairs(spark, d):
    return company_pairs(spark, d)


@register("R7_best_domain_distance", f"""
WITH {_LISTS},
p AS (SELECT request_id, name, min(levenshtein(name, domain)) AS distance FROM names JOIN labelled USING (request_id)
 WHERE domain IS NOT NULL GROUP BY request_id, name)
SELECT request_id, CAST(distance AS INTEGER) AS distance FROM p""")
def r7_best_domain_distance(spark, d):
    """The label that is chosen is one of least distance (how ties are broken
    by the gestalt ratio is held by a golden test)."""
    best = best_domain(company_pairs(spark, d))
    return best.join(companies(spark, d), "request_id").select("request_id", F.levenshtein("name", "domain").alias("distance"))


@register("A8_listing_page_count", """
SELECT regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS url, greatest(1, max(CAST(page_id % 40 AS INTEGER))) AS max_pages
FROM pages GROUP BY 1""")
def a8_listing_page_count(spark, d):
    p = dv.site_page(spark, d, with_html=False)
    pager = p.select(F.col("site").alias("url"), F.explode(F.array(
        (F.col("page_id") % 40).cast("string"), F.lit("next"), F.concat(F.lit("p"), F.col("page_id")))).alias("value"))
    return st.listing_page_count(pager)


@register("U2_term_groups", with_ctes(["requests", "stopword"], f"""
SELECT DISTINCT request_id, term, CASE WHEN suffix(term, 's') AND length(term) > 3 THEN concat(term, '|', left(term, length(term) - 1))
 ELSE term END AS "group" FROM {token_rows_sql("requests", "request_id", "product")} t"""))
def u2_term_groups(spark, d):
    terms = dv.requests(spark, d).select("request_id", F.explode(tx.preprocess("product")).alias("term")).distinct()
    lemma = F.when(F.col("term").endswith("s") & (F.length("term") > 3), F.expr("left(term, length(term) - 1)")).otherwise(F.col("term"))
    return fl.term_groups(terms.withColumn("lemma", lemma)).select("request_id", "term", F.array_join("group", "|").alias("group"))


@register("T11_resolve_link", rf"""
WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\b[^>]*?\shref\s*=\s*["'']([^"'']*)["'']', 1)) AS href FROM pages),
k AS (SELECT page_id, url, unnest([href, 'x/' || href, '#' || href, 'mailto:' || href, 'http:/' || href]) AS href FROM a)
SELECT DISTINCT page_id, href, {resolve_sql('url', 'href')} AS link FROM k""")
def t11_resolve_link(spark, d):
    p = read_table(spark, d, "pages")
    a = p.select("page_id", "url", F.explode(F.regexp_extract_all(
        "html", F.lit(r"""<a\b[^>]*?\shref\s*=\s*["']([^"']*)["']"""), F.lit(1))).alias("h"))
    kinds = F.array(F.col("h"), *[F.concat(F.lit(x), F.col("h")) for x in ("x/", "#", "mailto:", "http:/")])
    a = a.select("page_id", "url", F.explode(kinds).alias("href"))
    return a.select("page_id", "href", urls.resolve_link("url", "href").alias("link")).distinct()


_SUPPLIER_HITS = """hits AS (SELECT concat('q', CAST(page_id % 10 AS VARCHAR)) AS request_id, page_id AS pos, url AS link,
 regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS site FROM pages),
per AS (SELECT request_id, site, count(*) AS n_hits, string_agg(link, '|' ORDER BY pos) AS links, arg_min(link, pos) AS first
 FROM hits GROUP BY ALL),
asked AS (SELECT concat('q', CAST(s.s_suppkey % 10 AS VARCHAR)) AS request_id, b.* FROM supplier s
 JOIN supplier_base b ON b.id = concat('sup-', CAST(s.s_suppkey AS VARCHAR)) WHERE b.website <> '')"""


def asked_suppliers(spark, d):
    """(request_id, supplier...): each supplier is asked for once."""
    s = read_table(spark, d, "supplier").select(
        F.concat(F.lit("sup-"), F.col("s_suppkey").cast("string")).alias("_id"),
        F.concat(F.lit("q"), (F.col("s_suppkey") % 10).cast("string")).alias("request_id"))
    sup = dv.suppliers(spark, d).where("website <> ''").select(
        "_id", "name", "website", F.col("postalAddress.addressCountry").alias("country"), "contactEmails")
    return s.join(sup, "_id")


def result_lists(spark, d):
    p = dv.site_page(spark, d, with_html=False)
    return p.select(F.concat(F.lit("q"), (F.col("page_id") % 10).cast("string")).alias("request_id"),
                    F.col("page_id").alias("pos"), F.col("url").alias("link"), "site")


@register("J5_suppliers_with_hits", with_ctes(["supplier_base"], f""", {_SUPPLIER_HITS}
SELECT a.request_id, a.id AS _id, p.n_hits, p.links FROM asked a JOIN per p ON p.request_id = a.request_id AND p.site = a.website"""))
def j5_suppliers_with_hits(spark, d):
    out = jn.suppliers_with_hits(asked_suppliers(spark, d), result_lists(spark, d))
    return out.select("request_id", "_id", "n_hits", F.array_join("links", "|").alias("links"))


@register("M4_assemble_shortlist", with_ctes(["supplier_base"], f""", {_SUPPLIER_HITS}
SELECT a.request_id, a.id AS mongo_id, a.name AS supplier_name,
 concat(CASE WHEN starts_with(p.first, 'https://') THEN 'https://' WHEN starts_with(p.first, 'http://') THEN 'http://' ELSE '' END,
  replace(replace(a.website, 'https://', ''), 'http://', '')) AS website, a.country, '' AS email, p.n_hits
FROM asked a JOIN per p ON p.request_id = a.request_id AND p.site = a.website"""))
def m4_assemble_shortlist(spark, d):
    out = ig.assemble_shortlist(jn.suppliers_with_hits(asked_suppliers(spark, d), result_lists(spark, d)))
    return out.drop("subDomains")


@register("M5_supplier_text", f"""
WITH p AS (SELECT concat('q', page_id % (SELECT count(*) FROM supplier)) AS mongo_id, page_id, url, html FROM pages),
c AS (SELECT *, row_number() OVER (PARTITION BY mongo_id ORDER BY md5(concat(url, '|42')), url) AS r FROM p),
t AS (SELECT mongo_id, page_id, {visible_tokens_sql('html')} AS tokens FROM c WHERE r <= 2)
SELECT mongo_id, CAST(sum(len(tokens)) AS INTEGER) AS n_tokens,
 md5(string_agg(array_to_string(tokens, ' '), ' ' ORDER BY page_id) FILTER (WHERE len(tokens) > 0)) AS text_md5 FROM t GROUP BY mongo_id""")
def m5_supplier_text(spark, d):
    """Two pages of every supplier's list, in list order; pages are dealt to suppliers by id."""
    hits = company_hits(spark, d)
    lists = hits.groupBy(F.col("request_id").alias("mongo_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "link"))), lambda x: x["link"]).alias("subDomains"))
    pages = read_table(spark, d, "pages").select("url", "html")
    out = ig.supplier_text(lists, pages, ["mongo_id"], max_pages=2)
    return out.select("mongo_id", F.size("text").alias("n_tokens"), F.md5(F.array_join("text", " ").cast("binary")).alias("text_md5"))
