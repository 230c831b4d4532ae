"""Queries for the relational core: filters, joins, statistics, windows, sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sourcinglens.functions import text as tx
from sourcinglens.functions import urls
from sourcinglens.operators import filters as fl
from sourcinglens.operators import joins as jn
from sourcinglens.operators import stats as st
from sourcinglens.operators import windows as wn
from sourcinglens.plans.catalog import register
from sourcinglens.sources import derived as dv
from sourcinglens.sources.fixture_sql import preprocess_sql, token_rows_sql, with_ctes
from sourcinglens.sources.tables import read_table

HOST_SQL = r"lower(regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)', 1))"
STAT_COUNTRIES = ("NATION_1", "NATION_2", "NATION_3")


# --- shared Spark inputs --------------------------------------------------------

def request_terms(spark, d):
    """(request_id, term) of the part-name requests (T1 -> T3 of the product)."""
    return dv.requests(spark, d).select("request_id", F.explode(tx.preprocess("product")).alias("term")).distinct()


def label_matches(spark, d):
    """(request_id, classification, code): relevant codes whose label equals the product."""
    codes = dv.industry_code(spark, d).where(F.col("relevant") == 1)
    reqs = dv.requests(spark, d).select("request_id", "product")
    return reqs.join(codes, reqs.product == codes.label).select("request_id", "classification", "code")


def search_hits(spark, d):
    """Search results stand-in: 10 result lists over the page table,
    (request_id, pos, link, site)."""
    p = dv.site_page(spark, d, with_html=False)
    return p.select(F.concat(F.lit("q"), (F.col("page_id") % 10).cast("string")).alias("request_id"),
                    F.col("page_id").alias("pos"), F.col("url").alias("link"), "site")


def search_sites(spark, d):
    """(request_id, site): requested supplier sites per result list."""
    s = read_table(spark, d, "supplier").select("s_suppkey")
    sb = dv.supplier_base(spark, d)
    return sb.join(s, sb.id == F.concat(F.lit("sup-"), F.col("s_suppkey").cast("string"))).where(
        F.col("website") != "").select(F.concat(F.lit("q"), (F.col("s_suppkey") % 10).cast("string"))
                                       .alias("request_id"), F.col("website").alias("site"))


_RT = token_rows_sql("requests", "request_id", "product")
_REQ_TERMS = f"rt AS (SELECT DISTINCT request_id, term FROM {_RT} t)"
_CM = """cm AS (SELECT r.request_id, ic.classification, ic.code FROM requests r
 JOIN industry_code ic ON ic.label = r.product AND ic.relevant = 1)"""
_HITS = """hits AS (SELECT concat('q', CAST(page_id % 10 AS VARCHAR)) AS request_id, page_id AS pos, url AS link,
 regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS site FROM pages)"""
_SITES = """sites AS (SELECT concat('q', CAST(s.s_suppkey % 10 AS VARCHAR)) AS request_id, b.website AS site
 FROM supplier s JOIN supplier_base b ON b.id = concat('sup-', CAST(s.s_suppkey AS VARCHAR)) WHERE b.website <> '')"""


# --- F ---------------------------------------------------------------------------

@register("F1_filter_suppliers", with_ctes(["supplier_base", "supplier_code", "supplier_keyword", "industry_code",
                                            "request_country", "requests", "stopword"], f""", {_REQ_TERMS}, {_CM}
SELECT DISTINCT rc.request_id, s.id AS _id
FROM request_country rc JOIN supplier_base s ON s.country = rc.country
WHERE NOT (s.website IS NOT DISTINCT FROM '') AND (
  (NOT EXISTS (SELECT 1 FROM cm WHERE cm.request_id = rc.request_id)
   AND NOT EXISTS (SELECT 1 FROM rt WHERE rt.request_id = rc.request_id))
  OR EXISTS (SELECT 1 FROM supplier_code sc JOIN cm ON cm.classification = sc.classification AND cm.code = sc.code
             WHERE sc.id = s.id AND cm.request_id = rc.request_id)
  OR EXISTS (SELECT 1 FROM rt WHERE rt.request_id = rc.request_id AND (
        coalesce(contains(lower(s.description), rt.term), false)
        OR EXISTS (SELECT 1 FROM supplier_keyword k WHERE k.id = s.id AND contains(lower(k.keyword), rt.term)))))"""))
def f1_filter_suppliers(spark, d):
    return fl.filter_suppliers(dv.suppliers(spark, d), dv.requests(spark, d), label_matches(spark, d),
                               request_terms(spark, d))


@register("F2_project_supplier", with_ctes(["supplier_base", "supplier_code", "supplier_keyword"], """
SELECT b.id AS _id, b.name, b.country AS addressCountry, b.website,
 coalesce((SELECT string_agg(DISTINCT keyword, '|' ORDER BY keyword) FROM supplier_keyword k WHERE k.id = b.id), '')
   AS keywords,
 coalesce((SELECT string_agg(DISTINCT code, '|' ORDER BY code) FROM supplier_code c
           WHERE c.id = b.id AND c.classification = 'Kompass'), '') AS kompass
FROM supplier_base b"""))
def f2_project_supplier(spark, d):
    p = fl.project_supplier(dv.suppliers(spark, d))
    return p.select("_id", "name", "addressCountry", "website", F.array_join("keywords", "|").alias("keywords"),
                    F.coalesce(F.array_join(F.element_at("classifications", F.lit("Kompass")), "|"), F.lit(""))
                    .alias("kompass"))


@register("F3_pending", with_ctes(["crawl_queue"], """
SELECT _id, origin, url, discovered FROM (
 SELECT *, row_number() OVER (PARTITION BY origin ORDER BY _id) AS r FROM crawl_queue WHERE discovered = 0) x
WHERE r <= 10"""))
def f3_pending(spark, d):
    return fl.pending(dv.crawl_queue(spark, d), 10)


@register("F4_missing_website", with_ctes(["supplier_base"], """
SELECT id AS _id, name FROM supplier_base WHERE website = ''"""))
def f4_missing_website(spark, d):
    return fl.missing_website(dv.suppliers(spark, d)).select("_id", "name")


@register("F5_is_nonempty", with_ctes(["supplier_base", "supplier_code"], """
SELECT b.id AS _id,
 EXISTS (SELECT 1 FROM supplier_code c WHERE c.id = b.id) AS has_classifications,
 EXISTS (SELECT 1 FROM supplier_code c WHERE c.id = b.id AND c.classification = 'Kompass') AS has_kompass,
 EXISTS (SELECT 1 FROM supplier_code c WHERE c.id = b.id AND c.classification = 'SIC') AS has_sic
FROM supplier_base b"""))
def f5_is_nonempty(spark, d):
    s = dv.suppliers(spark, d)
    return s.select("_id", fl.map_nonempty("classifications").alias("has_classifications"),
                    F.coalesce(fl.is_nonempty(F.element_at("classifications", F.lit("Kompass"))), F.lit(False))
                    .alias("has_kompass"),
                    F.coalesce(fl.is_nonempty(F.element_at("classifications", F.lit("SIC"))), F.lit(False))
                    .alias("has_sic"))


@register("F6_name_lookup", with_ctes(["supplier_base"], """
SELECT id AS _id, name FROM supplier_base WHERE name IN (SELECT s_name FROM supplier WHERE s_acctbal > 5000)"""))
def f6_name_lookup(spark, d):
    names = read_table(spark, d, "supplier").where(F.col("s_acctbal") > 5000).select(F.col("s_name").alias("name"))
    return fl.name_lookup(dv.suppliers(spark, d), names).select("_id", "name")


@register("F7_links_for_domain", with_ctes(["site_page"], f""", {_HITS},
lab AS (SELECT request_id, pos, link, CASE WHEN instr(h, '.') > 0 THEN replace(left(h, instr(h, split_part(h, '.', 2)) - 1
   + length(split_part(h, '.', 2))), 'www.', '') END AS domain
 FROM (SELECT *, regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS h FROM hits) x),
chosen AS (SELECT request_id, min(domain) AS domain FROM lab GROUP BY request_id)
SELECT l.request_id, l.pos, l.link, l.domain FROM lab l JOIN chosen c ON l.request_id = c.request_id AND l.domain = c.domain"""))
def f7_links_for_domain(spark, d):
    hits = search_hits(spark, d).withColumn("domain", urls.domain_label("link"))
    chosen = hits.groupBy("request_id").agg(F.min("domain").alias("domain"))
    return fl.links_for_domain(hits, chosen).select("request_id", "pos", "link", "domain")


@register("F8_in_site", with_ctes(["supplier_base"], f""", {_HITS}, {_SITES}
SELECT DISTINCT h.request_id, h.pos, h.link FROM hits h JOIN sites s ON h.request_id = s.request_id
WHERE {HOST_SQL.format(x='h.link')} = lower(replace(replace(s.site, 'https://', ''), 'http://', ''))
   OR suffix({HOST_SQL.format(x='h.link')}, '.' || lower(replace(replace(s.site, 'https://', ''), 'http://', '')))"""))
def f8_in_site(spark, d):
    return fl.in_site(search_hits(spark, d), search_sites(spark, d)).select("request_id", "pos", "link")


@register("F9_usable_pages", with_ctes(["page_status"], r"""
SELECT page_id, url FROM page_status WHERE status = 200
 AND NOT coalesce(regexp_matches(html, '<div[^>]*\sclass\s*=\s*["'']alert alert-info["'']'), false)"""))
def f9_usable_pages(spark, d):
    return fl.usable_pages(dv.page_status(spark, d)).select("page_id", "url")


# --- J ---------------------------------------------------------------------------

@register("J1_label_codes", with_ctes(["supplier_code", "industry_code"], """
SELECT c.classification, c.code, CAST(c.n AS BIGINT) AS count, i.label, i.code IS NOT NULL AS found
FROM (SELECT classification, code, count(*) AS n FROM supplier_code GROUP BY ALL) c
LEFT JOIN industry_code i ON i.classification = c.classification AND i.code = c.code"""))
def j1_label_codes(spark, d):
    counts = dv.supplier_code(spark, d).groupBy("classification", "code").agg(F.count(F.lit(1)).alias("count"))
    return jn.label_codes(counts, dv.industry_code(spark, d)).select("classification", "code", "count", "label", "found")


@register("J2_request_languages", with_ctes(["request_country", "country_languages"], """
SELECT DISTINCT rc.request_id, trim(unnest(string_split(cl.languageCode, ','))) AS lang
FROM request_country rc JOIN country_languages cl ON cl.countryName = rc.country"""))
def j2_request_languages(spark, d):
    longlist = dv.requests(spark, d).select("request_id", F.explode("countries").alias("country"))
    return jn.request_languages(longlist, dv.country_languages(spark, d))


@register("J3_new_documents", with_ctes(["crawl_queue", "page_status"], """
SELECT _id, origin FROM crawl_queue WHERE _id NOT IN (SELECT url FROM page_status WHERE status = 200)"""))
def j3_new_documents(spark, d):
    stored = fl.usable_pages(dv.page_status(spark, d)).select(F.col("url").alias("_id"))
    return jn.new_documents(dv.crawl_queue(spark, d), stored).select("_id", "origin")


@register("J4_listing_seeds", with_ctes(["requests", "request_country", "stopword"], f""", {_REQ_TERMS}
SELECT rt.request_id, rt.term AS keyword, rc.country,
 'https://www.europages.co.uk/companies/' || replace(url_encode(rc.country), '+', '%20') || '/' || rt.term || '.html' AS url
FROM rt JOIN request_country rc ON rc.request_id = rt.request_id"""))
def j4_listing_seeds(spark, d):
    kw = request_terms(spark, d).withColumnRenamed("term", "keyword")
    countries = dv.requests(spark, d).select("request_id", F.explode("countries").alias("country"))
    return jn.listing_seeds(kw, countries).select("request_id", "keyword", "country", "url")


# --- A ---------------------------------------------------------------------------

@register("A1_supplier_counts", with_ctes(["supplier_base"], f"""
SELECT CAST(count(*) AS BIGINT) AS nb_total,
 CAST(count(*) FILTER (WHERE country IN {STAT_COUNTRIES}) AS BIGINT) AS nb_suppliers FROM supplier_base"""))
def a1_supplier_counts(spark, d):
    return st.supplier_counts(dv.suppliers(spark, d), STAT_COUNTRIES)


@register("A2_origin_coverage", with_ctes(["supplier_base", "supplier_code"], """
SELECT origin, CAST(count(*) AS BIGINT) AS all_count,
 CAST(count(*) FILTER (WHERE id IN (SELECT id FROM supplier_code)) AS BIGINT) AS with_classifications
FROM supplier_base GROUP BY origin"""))
def a2_origin_coverage(spark, d):
    return st.origin_coverage(dv.suppliers(spark, d))


@register("A3_classification_coverage", with_ctes(["supplier_base", "supplier_code"], """
SELECT b.origin, c.classification,
 CAST(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM supplier_code x WHERE x.id = b.id
                                     AND x.classification = c.classification)) AS BIGINT) AS non_empty
FROM supplier_base b CROSS JOIN (SELECT unnest(['Kompass', 'SIC', 'NACE']) AS classification) c
WHERE b.origin IN (SELECT b2.origin FROM supplier_base b2 WHERE b2.id IN (SELECT id FROM supplier_code))
GROUP BY b.origin, c.classification"""))
def a3_classification_coverage(spark, d):
    return st.classification_coverage(dv.suppliers(spark, d), ["Kompass", "SIC", "NACE"])


@register("A4_top_codes", with_ctes(["supplier_base", "supplier_code", "industry_code"], """,
vals AS (
  SELECT classification, NULL::VARCHAR AS value_key, code FROM supplier_code WHERE classification = 'Kompass'
  UNION ALL
  SELECT classification, string_agg(code, ',' ORDER BY code) AS value_key, min(code) AS code
  FROM supplier_code WHERE classification <> 'Kompass' GROUP BY id, classification),
cnt AS (SELECT classification, value_key, code, count(*) AS n FROM vals GROUP BY ALL),
lab AS (SELECT c.*, i.label, i.relevant, i.code IS NOT NULL AS found FROM cnt c
        LEFT JOIN industry_code i ON i.classification = c.classification AND i.code = c.code),
kept AS (SELECT * FROM lab WHERE NOT found OR relevant = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY classification ORDER BY n DESC, code, value_key NULLS FIRST) AS rank
       FROM kept)
SELECT classification, code, label, found, CAST(n AS BIGINT) AS count, rank,
 CAST((SELECT count(*) FROM supplier_base) AS BIGINT) AS nb_suppliers FROM rk WHERE rank <= 10"""))
def a4_top_codes(spark, d):
    out = st.top_codes(dv.suppliers(spark, d), dv.industry_code(spark, d), k=10)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@register("A5_suppliers_by_country", with_ctes(["supplier_base"], """
SELECT country, CAST(count(*) AS BIGINT) AS count FROM supplier_base GROUP BY country"""))
def a5_suppliers_by_country(spark, d):
    return st.suppliers_by_country(dv.suppliers(spark, d))


@register("P4_supplier_statistics", with_ctes(["supplier_base", "supplier_code", "industry_code"], f""",
b AS (SELECT * FROM supplier_base WHERE country IN {STAT_COUNTRIES}),
sc AS (SELECT * FROM supplier_code WHERE id IN (SELECT id FROM b)),
vals AS (SELECT classification, NULL::VARCHAR AS value_key, code FROM sc WHERE classification = 'Kompass'
  UNION ALL SELECT classification, string_agg(code, ',' ORDER BY code), min(code) FROM sc WHERE classification <> 'Kompass' GROUP BY id, classification),
cnt AS (SELECT classification, value_key, code, count(*) AS n FROM vals GROUP BY ALL),
kept AS (SELECT c.*, i.label FROM cnt c LEFT JOIN industry_code i ON i.classification = c.classification AND i.code = c.code
  WHERE i.code IS NULL OR i.relevant = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY classification ORDER BY n DESC, code, value_key NULLS FIRST) AS rank FROM kept),
o AS (SELECT origin, count(*) AS n, count(*) FILTER (WHERE id IN (SELECT id FROM sc)) AS part FROM b GROUP BY origin),
long(statistic, origin, classification, code, value_key, country, label, count, part, rank) AS (
 SELECT 'total', NULL, NULL, NULL, NULL, NULL, NULL, count(*), count(*) FILTER (WHERE country IN {STAT_COUNTRIES}), NULL FROM supplier_base
 UNION ALL SELECT 'origin', origin, NULL, NULL, NULL, NULL, NULL, n, part, NULL FROM o
 UNION ALL SELECT 'classification', b.origin, c.classification, NULL, NULL, NULL, NULL, count(*), count(*) FILTER (WHERE EXISTS (
   SELECT 1 FROM sc x WHERE x.id = b.id AND x.classification = c.classification)), NULL
   FROM b CROSS JOIN (SELECT unnest(['Kompass', 'SIC', 'NACE']) AS classification) c
   WHERE b.origin IN (SELECT origin FROM o WHERE part > 0) GROUP BY b.origin, c.classification
 UNION ALL SELECT 'code', NULL, classification, code, value_key, NULL, label, n, n, rank FROM rk WHERE rank <= 10
 UNION ALL SELECT 'country', NULL, NULL, NULL, NULL, country, NULL, count(*), count(*), NULL FROM supplier_base GROUP BY country)
SELECT statistic, origin, classification, code, value_key, country, label, CAST(count AS BIGINT) AS count, CAST(part AS BIGINT) AS part,
 CAST(rank AS INTEGER) AS rank FROM long"""))
def p4_supplier_statistics(spark, d):
    return st.statistics(dv.suppliers(spark, d), dv.industry_code(spark, d), ["Kompass", "SIC", "NACE"], STAT_COUNTRIES)


@register("A6_website_probability", with_ctes(["supplier_base"], r"""
, w AS (SELECT id AS _id, website AS url, origin,
  CASE WHEN starts_with(website, 'www.') THEN regexp_replace(website, '^www\.', '')
       WHEN lower(regexp_extract(website, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)', 1)) <> ''
       THEN regexp_replace(lower(regexp_extract(website, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)', 1)), '^www\.', '')
       ELSE website END AS url_root
  FROM supplier_base WHERE website <> '' AND origin <> ''),
sh AS (SELECT url_root, count(*) / (SELECT count(*) FROM w) AS share FROM w GROUP BY url_root)
SELECT w._id, w.url, w.url_root, w.origin, round(CASE WHEN origin IN ('Organicbio', 'Europages', 'Kompass')
  THEN 0.7 ELSE sh.share END, 6) AS probability FROM w JOIN sh USING (url_root)"""))
def a6_website_probability(spark, d):
    out = st.website_probability(dv.suppliers(spark, d))
    return out.withColumn("probability", F.round("probability", 6))


# --- W ---------------------------------------------------------------------------

@register("W2_first_by", with_ctes(["supplier_base"], """
SELECT website, _id, name FROM (SELECT website, id AS _id, name,
 row_number() OVER (PARTITION BY website ORDER BY id) AS r FROM supplier_base) x WHERE r = 1"""))
def w2_first_by(spark, d):
    s = dv.suppliers(spark, d).select("website", "_id", "name")
    return wn.first_by(s, ["website"], ["_id"])


@register("W3_cap_pages", with_ctes(["site_page"], """
SELECT site, page_id, url FROM (SELECT site, page_id, url,
 row_number() OVER (PARTITION BY site ORDER BY md5(url || '|42'), url) AS r FROM site_page) x WHERE r <= 7"""))
def w3_cap_pages(spark, d):
    return wn.cap_pages(dv.site_page(spark, d, with_html=False), ["site"], "url", 7).select("site", "page_id", "url")


@register("W5_top_links", with_ctes(["site_page"], f""", {_HITS}
SELECT request_id, pos, link FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY pos) AS r FROM hits) x
WHERE r <= 3"""))
def w5_top_links(spark, d):
    return wn.top_links(search_hits(spark, d), ["request_id"], ["pos"], 3).select("request_id", "pos", "link")


@register("W6_sample_records", with_ctes(["supplier_base"], """
SELECT id AS _id, name FROM supplier_base ORDER BY md5(id || '|7'), id LIMIT 10"""))
def w6_sample_records(spark, d):
    return wn.sample_records(dv.suppliers(spark, d), 10, seed=7).select("_id", "name")


@register("W7_chunk", with_ctes(["supplier_base"], """
SELECT country, id AS _id, CAST(floor((row_number() OVER (PARTITION BY country ORDER BY id) - 1) / 2) AS INTEGER)
 AS chunk FROM supplier_base"""))
def w7_chunk(spark, d):
    s = dv.suppliers(spark, d).select(F.col("postalAddress.addressCountry").alias("country"), "_id")
    return wn.chunk(s, ["country"], ["_id"], 2)


@register("W8_page_of_results", with_ctes(["site_page"], f""", {_HITS},
ranked AS (SELECT request_id, link, row_number() OVER (PARTITION BY request_id ORDER BY pos) AS pos FROM hits),
pg AS (SELECT request_id, pos, link, 1 AS page FROM ranked WHERE pos <= 49
 UNION ALL SELECT request_id, pos, link, CAST(floor((pos - 11) / 49) + 2 AS INTEGER) FROM ranked
 WHERE pos >= 11 AND floor((pos - 11) / 49) + 2 <= 21)
SELECT request_id, CAST(pos AS INTEGER) AS pos, link, page FROM pg"""))
def w8_page_of_results(spark, d):
    # nothing after the pager's last result is on a page, so each task cuts a
    # list there before it moves
    ranked = search_hits(spark, d).withColumn(
        "pos", F.row_number().over(Window.partitionBy("request_id").orderBy("pos"))).where(F.col("pos") <= wn.last_position())
    return wn.page_of_results(ranked).select("request_id", F.col("pos").cast("int").alias("pos"), "link", "page")


# --- U ---------------------------------------------------------------------------

@register("U1_expand_codes", with_ctes(["industry_code", "requests", "stopword"], f""", {_REQ_TERMS}, {_CM},
seeds AS (SELECT * FROM cm UNION ALL SELECT request_id, classification, left(code, 5) FROM cm WHERE length(code) = 7),
a AS (SELECT s.request_id, i.classification, i.code, i.label FROM seeds s
      JOIN industry_code i ON i.classification = s.classification AND i.code = s.code),
b AS (SELECT DISTINCT rt.request_id, i.classification, i.code, i.label FROM rt
      JOIN (SELECT DISTINCT request_id, classification FROM cm) c ON c.request_id = rt.request_id
      JOIN industry_code i ON i.classification = c.classification AND contains(i.label, rt.term))
SELECT DISTINCT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) u"""))
def u1_expand_codes(spark, d):
    words = request_terms(spark, d).withColumnRenamed("term", "word")
    return fl.expand_codes(dv.industry_code(spark, d), label_matches(spark, d), keywords=words)
