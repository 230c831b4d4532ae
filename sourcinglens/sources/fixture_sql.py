"""SQL twins of the derived tables and text functions, for the DuckDB oracle.

Each ``*_SQL`` string is a SELECT over the driver's views; ``with_ctes``
prefixes a query with the CTEs it names.  Regexes stay in the Java ∩ RE2
subset; lambdas use DuckDB's ``lambda x: ...`` form.
"""

from __future__ import annotations

from sourcinglens.functions.stopwords import sql_list_literal

SITE_RE = r"^([a-z]+://[^/?#]+)"

CTES: dict[str, str] = {
    "supplier_base": """
SELECT concat('sup-', CAST(s.s_suppkey AS VARCHAR(20))) AS id, s.s_name AS name, n.n_name AS country,
 CASE s.s_suppkey % 3 WHEN 0 THEN 'Organicbio' WHEN 1 THEN 'Europages' ELSE 'Kompass' END AS origin,
 CASE WHEN s.s_suppkey % 7 = 0 THEN '' ELSE p.site END AS website, d.text AS description
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
LEFT JOIN (SELECT doc_id % (SELECT count(*) FROM supplier) AS dealt, string_agg(text, chr(10) ORDER BY doc_id) AS text
 FROM documents GROUP BY 1) d ON d.dealt = s.s_suppkey
LEFT JOIN (SELECT page_id % (SELECT count(*) FROM supplier) AS dealt, arg_min(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1), page_id) AS site
 FROM pages GROUP BY 1) p ON p.dealt = s.s_suppkey""",
    "supplier_code": """
SELECT DISTINCT concat('sup-', CAST(l_suppkey AS VARCHAR(20))) AS id, 'Kompass' AS classification, p_brand AS code
FROM lineitem JOIN part ON l_partkey = p_partkey
UNION ALL SELECT DISTINCT concat('sup-', CAST(l_suppkey AS VARCHAR(20))), 'SIC', p_type
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "supplier_keyword": """
SELECT DISTINCT concat('sup-', CAST(l_suppkey AS VARCHAR(20))) AS id, p_name AS keyword
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "industry_code": """
SELECT 'Kompass' AS classification, p_brand AS code, min(p_name) AS label,
 CASE WHEN count(*) % 2 = 0 THEN 1 ELSE 0 END AS relevant FROM part GROUP BY p_brand
UNION ALL SELECT 'SIC', p_type, concat(lower(p_type), ' ', min(p_name)), 1 FROM part GROUP BY p_type
UNION ALL SELECT 'NAME', p_name, p_name, 1 FROM part GROUP BY p_name""",
    "site_page": """
SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS site, html FROM pages""",
    "page_status": """
SELECT page_id, url, CASE WHEN page_id % 10 = 9 THEN 404 ELSE 200 END AS status, html,
 CASE page_id % 3 WHEN 0 THEN 'Organicbio' WHEN 1 THEN 'Europages' ELSE 'Kompass' END AS origin FROM pages""",
    "crawl_queue": """
SELECT url AS _id, CASE page_id % 3 WHEN 0 THEN 'Organicbio' WHEN 1 THEN 'Europages' ELSE 'Kompass' END AS origin,
 url, CASE page_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN -2.0 ELSE CAST(1600000000 + page_id * 60 AS DOUBLE) END AS discovered
FROM pages""",
    "country_languages": """
SELECT n_name AS countryName, CASE n_regionkey WHEN 0 THEN 'en' WHEN 1 THEN 'fr,en' WHEN 2 THEN 'de'
 WHEN 3 THEN 'es,pt' ELSE 'it,fr,de' END AS languageCode FROM nation""",
    # long form of requests: one row per (request, country)
    "request_country": """
SELECT r.request_id, n.n_name AS country FROM
 (SELECT p_name AS request_id, CAST(min(p_partkey) % 5 AS INTEGER) AS region FROM part GROUP BY p_name) r
 JOIN nation n ON n.n_regionkey = r.region""",
    "requests": """
SELECT p_name AS request_id, p_name AS product FROM part GROUP BY p_name""",
    "page_request": """
SELECT concat('page-', CAST(page_id AS VARCHAR)) AS request_id,
 regexp_extract(html, '<title>([^<]*)</title>', 1) AS product, CAST(page_id % 5 AS INTEGER) AS region FROM pages""",
    "page_request_country": """
SELECT r.request_id, n.n_name AS country FROM page_request r JOIN nation n ON n.n_regionkey = r.region""",
    "stopword": f"""
SELECT unnest({sql_list_literal()}) AS word""",
}

# Dependencies between CTEs (emitted in this order).
ORDER = ["supplier_base", "supplier_code", "supplier_keyword", "industry_code", "site_page", "page_status",
         "crawl_queue", "country_languages", "request_country", "requests", "page_request",
         "page_request_country", "stopword"]
DEPS = {"page_request_country": ["page_request"]}


def with_ctes(names: list[str], body: str) -> str:
    need: set[str] = set()

    def add(n: str) -> None:
        for d in DEPS.get(n, []):
            add(d)
        need.add(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({CTES[n].strip()})" for n in ORDER if n in need]
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body


# --- text twins ---------------------------------------------------------------

def clean_markup_sql(x: str) -> str:
    c = f"regexp_replace({x}, '<img[^<>]+(>|$)', ' image_token ', 'g')"
    c = f"regexp_replace({c}, '<[^<>]+(>|$)', ' ', 'g')"
    c = f"regexp_replace({c}, '\\[img_assist[^\\]]*?\\]', ' ', 'g')"
    url = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\(\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
    return f"regexp_replace({c}, '{url}', ' url_token ', 'g')"


def tokenize_sql(x: str) -> str:
    """T2 twin: letter-only word runs of lower(x) (array)."""
    return (f"list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{Nl}}\\p{{No}}_]+'), "
            f"lambda t: regexp_full_match(t, '\\p{{L}}+'))")


def preprocess_sql(x: str) -> str:
    """T1 -> T2 -> T3 twin (array, order and duplicates kept)."""
    return f"list_filter({tokenize_sql(clean_markup_sql(x))}, lambda t: NOT list_contains({sql_list_literal()}, t))"


def token_rows_sql(source: str, keys: str, text: str) -> str:
    """Long form of preprocess: one row per kept token occurrence, with its
    1-based position ``pos`` among tokens (before stopword removal)."""
    return f"""(SELECT {keys}, u.term, u.pos FROM (
  SELECT {keys}, unnest({tokenize_sql(clean_markup_sql(text))}) AS term,
         generate_subscripts({tokenize_sql(clean_markup_sql(text))}, 1) AS pos FROM {source}) u
  WHERE u.term NOT IN (SELECT word FROM stopword))"""
