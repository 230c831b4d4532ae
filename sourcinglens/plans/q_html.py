"""Queries for HTML extraction (H*) and the column-function library (T*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sourcinglens.functions import records as rc
from sourcinglens.functions import text as tx
from sourcinglens.functions import urls
from sourcinglens.functions.similarity import gestalt_ratio
from sourcinglens.operators import html as hx
from sourcinglens.plans.catalog import register
from sourcinglens.plans.q_text import doc_tokens
from sourcinglens.sources import derived as dv
from sourcinglens.sources.fixture_sql import tokenize_sql, token_rows_sql, with_ctes
from sourcinglens.sources.tables import read_table

_SPACE = r"[\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _decode_sql(x: str) -> str:
    for ent, ch in hx.ENTITIES:
        x = f"replace({x}, '{ent}', '{ch.replace(chr(39), chr(39) * 2)}')"
    return x


def visible_sql(x: str) -> str:
    c = x
    for pat in hx.INVISIBLE_BLOCKS:
        c = f"regexp_replace({c}, '{pat}', ' ', 'g')"
    return _decode_sql(f"regexp_replace({c}, '<[^>]*>', chr(10), 'g')")


def visible_tokens_sql(x: str) -> str:
    return (f"list_filter(string_split(trim(regexp_replace({visible_sql(x)}, '{_SPACE}', ' ', 'g')), ' '), "
            f"lambda t: t <> '')")


# --- H ---------------------------------------------------------------------------

@register("H1_visible_tokens", f"""
SELECT page_id, array_to_string({visible_tokens_sql('html')}, ' ') AS tokens FROM pages""")
def h1_visible_tokens(spark, d):
    p = read_table(spark, d, "pages")
    return p.select("page_id", F.array_join(hx.visible_tokens("html"), " ").alias("tokens"))


@register("H2_image_sources", rf"""
SELECT page_id, src FROM (SELECT page_id, trim(unnest(regexp_extract_all(html,
 '<img\b[^>]*?\ssrc\s*=\s*["'']([^"'']*)["'']', 1))) AS src FROM pages) x WHERE src <> ''""")
def h2_image_sources(spark, d):
    p = read_table(spark, d, "pages")
    return p.select("page_id", F.explode(hx.image_sources("html")).alias("src"))


_ORIGIN_SQL = "regexp_extract({b}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
_PATH_SQL = "regexp_extract({b}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def resolve_sql(b: str, h: str) -> str:
    return (f"CASE WHEN {h} IS NULL OR {h} = '' OR starts_with({h}, '#') OR starts_with(lower({h}), 'mailto:') "
            f"OR starts_with(lower({h}), 'javascript:') THEN NULL "
            f"WHEN starts_with({h}, '/') THEN {_ORIGIN_SQL.format(b=b)} || {h} "
            f"WHEN NOT starts_with({h}, 'http') THEN (CASE WHEN contains({_PATH_SQL.format(b=b)}, '/') "
            f"THEN regexp_extract({b}, '^(.*/)', 1) ELSE {b} || '/' END) || {h} ELSE {h} END")


@register("H3_page_links", rf"""
WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\b[^>]*?\shref\s*=\s*["'']([^"'']*)["'']', 1)) AS href,
  generate_subscripts(regexp_extract_all(html, '<a\b[^>]*?\shref\s*=\s*["'']([^"'']*)["'']', 1), 1) - 1 AS pos
  FROM pages),
r AS (SELECT page_id, url, pos, {resolve_sql('url', _decode_sql('href'))} AS link FROM a)
SELECT page_id, CAST(pos AS INTEGER) AS pos, link FROM r
WHERE link IS NOT NULL AND NOT suffix(link, '.gz') AND contains(link, {_ORIGIN_SQL.format(b='url')})""")
def h3_page_links(spark, d):
    return hx.page_links(read_table(spark, d, "pages"))


@register("H4_select_text", r"""
SELECT page_id, 'ad' AS rule, 0 AS pos,
 trim(replace(replace(replace(replace(regexp_extract(html, '<div class="ad">([^<]*)</div>', 1), '&lt;', '<'), '&gt;', '>'),
   '&quot;', '"'), '&amp;', '&')) AS value
FROM pages WHERE regexp_matches(html, '<div class="ad">')""")
def h4_select_text(spark, d):
    p = read_table(spark, d, "pages")
    return hx.select_text(p, [("ad", "ad", "div", None)], key=["page_id"])


@register("H10_listing_pages", with_ctes(["site_page"], r""",
seeds AS (SELECT url, 'Europages' AS origin FROM site_page),
counts AS (SELECT url, CAST(length(url) % 4 + 1 AS INTEGER) AS max_pages FROM site_page)
SELECT s.url AS seed, s.origin, CAST(g.page AS INTEGER) AS page,
 regexp_replace(s.url, '^(.*/)([^/]*)$', '\1pg-' || CAST(g.page AS VARCHAR) || '/\2') AS url
FROM seeds s JOIN counts c USING (url), LATERAL (SELECT unnest(range(1, c.max_pages + 1)) AS page) g"""))
def h10_listing_pages(spark, d):
    sp = dv.site_page(spark, d, with_html=False)
    seeds = sp.select("url", F.lit("Europages").alias("origin"))
    counts = sp.select("url", (F.length("url") % 4 + 1).cast("int").alias("max_pages"))
    return hx.listing_pages(seeds, counts)


_EMAIL_SQL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+"


@register("H11_emails_in_pages", rf"""
SELECT DISTINCT 'page' AS src, page_id AS id, unnest(regexp_extract_all(html, '{_EMAIL_SQL}')) AS email FROM pages
UNION SELECT DISTINCT 'doc', doc_id, unnest(regexp_extract_all(text, '{_EMAIL_SQL}')) FROM documents""")
def h11_emails_in_pages(spark, d):
    p = read_table(spark, d, "pages").select(F.lit("page").alias("src"), F.col("page_id").alias("id"),
                                             F.col("html").alias("t"))
    docs = read_table(spark, d, "documents").select(F.lit("doc").alias("src"), F.col("doc_id").alias("id"),
                                                    F.col("text").alias("t"))
    return hx.emails_in_pages(p.unionByName(docs), ["src", "id"], text="t")


@register("H11_emails_strict", r"""
SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(text, '(?i)[a-z0-9.\-+_]+@[a-z0-9.\-+_]+\.com')) AS email
FROM documents""")
def h11_emails_strict(spark, d):
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return hx.emails_in_pages(docs, ["id"], text="text", strict=True)


# --- T ---------------------------------------------------------------------------

_TITLE_TERMS = token_rows_sql("page_request", "request_id", "product")
_DOC_VOCAB = token_rows_sql("documents", "doc_id", "text")


def _lemma_sql() -> str:
    cands = ["SELECT term, 0 AS k, term AS cand FROM vocab"]
    for i, (old, new) in enumerate(tx.NOUN_SUFFIX_RULES, start=1):
        cands.append(f"SELECT term, {i}, left(term, length(term) - {len(old)}) || '{new}' FROM vocab "
                     f"WHERE suffix(term, '{old}')")
    return f"""vocab AS (SELECT DISTINCT term FROM {_TITLE_TERMS} t),
lex AS (SELECT DISTINCT term AS cand FROM {_DOC_VOCAB} t),
cands AS ({' UNION ALL '.join(cands)}),
best AS (SELECT term, arg_min(cand, length(cand) * 100 + k) AS lemma FROM cands WHERE cand IN (SELECT cand FROM lex)
         GROUP BY term)"""


def title_terms(spark, d):
    return dv.page_requests(spark, d).select("request_id", F.posexplode(tx.preprocess("product")).alias("pos", "term"))


def doc_lexicon(spark, d):
    return doc_tokens(spark, d).select(F.explode("tokens").alias("word"))


@register("T4_lemmatize", with_ctes(["page_request", "stopword"], f""", {_lemma_sql()}
SELECT v.term, coalesce(b.lemma, v.term) AS lemma FROM vocab v LEFT JOIN best b USING (term)"""))
def t4_lemmatize(spark, d):
    return tx.lemma_table(title_terms(spark, d), doc_lexicon(spark, d))


@register("T5_stem_terms")
def t5_stem_terms(spark, d):
    return tx.stem_table(title_terms(spark, d))


@register("T6_render_boolean", with_ctes(["page_request", "stopword"], f""", {_lemma_sql()},
tt AS (SELECT request_id, term, min(pos) AS pos FROM {_TITLE_TERMS} t GROUP BY request_id, term),
g AS (SELECT tt.request_id, tt.pos, CASE WHEN coalesce(b.lemma, tt.term) = tt.term THEN tt.term
        ELSE tt.term || ' OR ' || b.lemma END AS grp FROM tt LEFT JOIN best b USING (term))
SELECT request_id, '(' || string_agg(grp, ') AND (' ORDER BY pos) || ')' AS searchterm FROM g GROUP BY request_id"""))
def t6_render_boolean(spark, d):
    from sourcinglens.plans.q_flow import term_groups_for
    groups = term_groups_for(title_terms(spark, d), doc_lexicon(spark, d))
    agg = groups.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("pos", "group"))).alias("g"))
    return agg.select("request_id", tx.render_boolean(F.transform("g", lambda x: x["group"])).alias("searchterm"))


_DOMAIN_SQL = """CASE WHEN instr(h, '.') > 0 THEN replace(left(h, instr(h, split_part(h, '.', 2)) - 1
   + length(split_part(h, '.', 2))), 'www.', '') END"""


@register("T7_domain_label", f"""
SELECT page_id, {_DOMAIN_SQL} AS domain FROM (SELECT page_id,
 regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS h FROM pages) x""")
def t7_domain_label(spark, d):
    return read_table(spark, d, "pages").select("page_id", urls.domain_label("url").alias("domain"))


_HOST = "lower(regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)', 1))"


def _root_sql(x: str, legacy: bool = False) -> str:
    strip = "'^[w.]+'" if legacy else r"'^www\.'"
    h = _HOST.format(x=x)
    return (f"CASE WHEN starts_with({x}, 'www.') THEN regexp_replace({x}, {strip}, '') "
            f"WHEN {h} <> '' THEN regexp_replace({h}, {strip}, '') ELSE {x} END")


_WWW = "CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^[a-z]+://', 'www.') ELSE regexp_replace(url, '^[a-z]+://', 'http://www.') END"


@register("T8_url_root", f"""
SELECT page_id, u, {_root_sql('u')} AS url_root, {_root_sql('u', True)} AS url_root_legacy
FROM (SELECT page_id, {_WWW} AS u FROM pages) x""")
def t8_url_root(spark, d):
    p = read_table(spark, d, "pages").select("page_id", "url")
    k = F.col("page_id") % 3
    u = (F.when(k == 0, F.col("url")).when(k == 1, F.regexp_replace("url", "^[a-z]+://", "www."))
         .otherwise(F.regexp_replace("url", "^[a-z]+://", "http://www.")))
    p = p.select("page_id", u.alias("u"))
    return p.select("page_id", "u", urls.url_root("u").alias("url_root"),
                    urls.url_root("u", legacy=True).alias("url_root_legacy"))


@register("T9_align_scheme", with_ctes(["supplier_base", "site_page"], """
SELECT b.id AS _id, p.url AS first_link, CASE WHEN starts_with(p.url, 'http://') THEN 'http://'
  WHEN starts_with(p.url, 'https://') THEN 'https://' ELSE '' END
  || replace(replace(b.website, 'http://', ''), 'https://', '') AS website
FROM supplier_base b JOIN site_page p ON p.page_id = CAST(substr(b.id, 5) AS BIGINT)"""))
def t9_align_scheme(spark, d):
    b = dv.supplier_base(spark, d)
    p = dv.site_page(spark, d, with_html=False)
    j = b.join(p, p.page_id == F.substring("id", 5, 20).cast("bigint"))
    return j.select(F.col("id").alias("_id"), F.col("url").alias("first_link"),
                    urls.align_scheme("website", "url").alias("website"))


@register("T10_fix_double_scheme", """
SELECT page_id, replace(replace(replace(replace(lower(u), 'http://http://', 'http://'), 'https://https://', 'https://'),
 'https://http://', 'http://'), 'http://https://', 'https://') AS website
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'HTTP://' || url ELSE url END AS u FROM pages) x""")
def t10_fix_double_scheme(spark, d):
    p = read_table(spark, d, "pages")
    u = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("HTTP://"), F.col("url"))).otherwise(F.col("url"))
    return p.select("page_id", urls.fix_double_scheme(u).alias("website"))


@register("T12_title_case", """
SELECT page_id, array_to_string(list_transform(string_split(trim(regexp_replace(lower(t), '\\s+', ' ', 'g')), ' '),
  lambda w: (CASE WHEN left(w, 1) = 'ß' THEN 'Ss' ELSE upper(left(w, 1)) END) || substr(w, 2)), ' ') AS title
FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages) x""")
def t12_title_case(spark, d):
    p = read_table(spark, d, "pages")
    return p.select("page_id", rc.title_case(F.regexp_extract("html", r"<title>([^<]*)</title>", 1)).alias("title"))


@register("T13_normalise_address", with_ctes(["supplier_base"], """
SELECT id AS _id, CASE WHEN trim(country) = 'USA' THEN 'United States' ELSE trim(country) END AS country,
 replace(replace(concat_ws(chr(10), name, country), chr(10), ';'), ' ;', '; ') AS "addressRaw" FROM supplier_base"""))
def t13_normalise_address(spark, d):
    b = dv.supplier_base(spark, d)
    return b.select(F.col("id").alias("_id"), rc.normalise_country("country").alias("country"),
                    rc.normalise_raw_address(F.concat_ws("\n", "name", "country")).alias("addressRaw"))


@register("T14_clean_keywords", with_ctes(["supplier_keyword"], """
SELECT id AS _id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(s, '|'),
   lambda k: lower(trim(regexp_replace(k, '[ -]+$', '')))), lambda k: k <> ''))), ',') AS keywords
FROM (SELECT id, string_agg(keyword || ' -', '|' ORDER BY keyword) AS s FROM supplier_keyword GROUP BY id) x"""))
def t14_clean_keywords(spark, d):
    kw = dv.supplier_keyword(spark, d).groupBy("id").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat("keyword", F.lit(" -")))), "|").alias("s"))
    return kw.select(F.col("id").alias("_id"), F.array_join(rc.clean_keywords("s"), ",").alias("keywords"))


@register("T15_clean_description", """
SELECT doc_id, split_part(regexp_replace(replace(text, chr(10), ' '), ' +', ' ', 'g'),
 'Other companies in the same industry', 1) AS description FROM documents""")
def t15_clean_description(spark, d):
    return read_table(spark, d, "documents").select("doc_id", rc.clean_description("text").alias("description"))


@register("T16_strip_controls", """
SELECT doc_id, regexp_replace(translate(text, chr(10) || chr(9) || chr(13), '   '), ' +', ' ', 'g') AS text
FROM documents""")
def t16_strip_controls(spark, d):
    return read_table(spark, d, "documents").select("doc_id", rc.strip_controls("text").alias("text"))


@register("T17_to_year", """
SELECT p_partkey,
 CASE WHEN regexp_full_match(trim(a), '[+-]?[0-9]+') THEN TRY_CAST(trim(a) AS INTEGER) END AS year_a,
 CASE WHEN regexp_full_match(trim(b), '[+-]?[0-9]+') THEN TRY_CAST(trim(b) AS INTEGER) END AS year_b
FROM (SELECT p_partkey, ' ' || CAST(p_size + 1990 AS VARCHAR) || ' ' AS a, CAST(p_retailprice AS VARCHAR) AS b
      FROM part) x""")
def t17_to_year(spark, d):
    p = read_table(spark, d, "part")
    return p.select("p_partkey",
                    rc.to_year(F.concat(F.lit(" "), (F.col("p_size") + 1990).cast("string"), F.lit(" "))).alias("year_a"),
                    rc.to_year(F.col("p_retailprice").cast("string")).alias("year_b"))


@register("T18_decode_redirect", """
SELECT page_id, url AS link FROM pages""")
def t18_decode_redirect(spark, d):
    p = read_table(spark, d, "pages")
    href = F.concat(F.lit("https://r.search.example/RU="), F.url_encode("url"), F.lit("/RK=2/RS=x"))
    return p.select("page_id", urls.decode_redirect(href).alias("link"))


@register("T19_total_hits", """
SELECT l_suppkey, CAST(count(*) AS BIGINT) AS total FROM lineitem GROUP BY l_suppkey""")
def t19_total_hits(spark, d):
    li = read_table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    text = F.concat(F.lit("About "), F.format_number("n", 0), F.lit(" results"))
    return li.select("l_suppkey", urls.total_hits(text).alias("total"))


@register("T20_edit_distance", """
SELECT s_suppkey, CAST(levenshtein(lower(s.s_name), lower(n.n_name)) AS INTEGER) AS distance
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey""")
def t20_edit_distance(spark, d):
    s = read_table(spark, d, "supplier")
    n = read_table(spark, d, "nation")
    j = s.join(n, s.s_nationkey == n.n_nationkey)
    return j.select("s_suppkey", F.levenshtein(F.lower("s_name"), F.lower("n_name")).alias("distance"))


@register("T21_gestalt_ratio")
def t21_gestalt_ratio(spark, d):
    s = read_table(spark, d, "supplier")
    n = read_table(spark, d, "nation")
    j = s.join(n, s.s_nationkey == n.n_nationkey)
    return j.select("s_suppkey", gestalt_ratio(F.lower("s_name"), F.lower("n_name")).alias("ratio"))


@register("T22_make_email", """
SELECT doc_id, email, sha256(email || '|' || 'doc-' || CAST(doc_id AS VARCHAR)) AS id, 'Website' AS _type,
 'Unclear' AS status FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text,
 '[\\p{L}\\p{N}_.+-]+@[\\p{L}\\p{N}_-]+\\.[\\p{L}\\p{N}_.-]+')) AS email FROM documents) x""")
def t22_make_email(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    em = hx.emails_in_pages(docs, ["doc_id"], text="text")
    s = em.select("doc_id", rc.make_email(F.col("email"), F.lit("Website"),
                                          F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("e"))
    return s.select("doc_id", F.col("e.email").alias("email"), F.col("e.id").alias("id"),
                    F.col("e.origin._type").alias("_type"), F.col("e.status").alias("status"))


@register("T23_mark_discovered", with_ctes(["crawl_queue", "page_status"], """
SELECT q._id, CASE WHEN p.status = 200 THEN CAST(1700000000 AS DOUBLE) ELSE CAST(-2 AS DOUBLE) END AS discovered
FROM crawl_queue q JOIN page_status p ON p.url = q.url"""))
def t23_mark_discovered(spark, d):
    q = dv.crawl_queue(spark, d)
    p = dv.page_status(spark, d).select("url", "status")
    return q.join(p, "url").select("_id", rc.mark_discovered(F.col("status") == 200, F.lit(1_700_000_000))
                                   .alias("discovered"))


@register("T24_request_name", """
SELECT r.request_id, r.request_id || ' in ' || string_agg(n.n_name, ', ' ORDER BY n.n_nationkey) AS request_name
FROM (SELECT p_name AS request_id, CAST(min(p_partkey) % 5 AS INTEGER) AS region FROM part GROUP BY p_name) r
JOIN nation n ON n.n_regionkey = r.region GROUP BY r.request_id""")
def t24_request_name(spark, d):
    r = dv.requests(spark, d)
    return r.select("request_id", rc.request_name("product", "countries").alias("request_name"))


@register("T25_request_terms", with_ctes(["page_request", "stopword"], f""", {_lemma_sql()}
SELECT t.request_id, CAST(t.pos - 1 AS INTEGER) AS pos, t.term, coalesce(b.lemma, t.term) AS lemma
FROM (SELECT request_id, term, row_number() OVER (PARTITION BY request_id ORDER BY pos) AS pos FROM {_TITLE_TERMS} x) t
LEFT JOIN best b USING (term)"""))
def t25_request_terms(spark, d):
    terms = title_terms(spark, d)
    lem = tx.lemma_table(terms, doc_lexicon(spark, d))
    return terms.join(lem, "term", "left").select("request_id", "pos", "term", "lemma")
