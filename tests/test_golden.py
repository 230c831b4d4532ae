"""Golden rows (FIXTURES.md §3) and the N-notes, one check each."""

import pytest
from pyspark.sql import functions as F

from sourcinglens.functions import records as rc
from sourcinglens.functions import text as tx
from sourcinglens.functions import urls
from sourcinglens.functions.porter import stem
from sourcinglens.operators import html as hx
from sourcinglens.operators import relevance as rv
from sourcinglens.operators import windows as wn
from sourcinglens.operators.joins import listing_seeds
from sourcinglens.operators.linkage import best_domain


def one(spark, expr, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"x {dtype}")
    return df.select(expr(F.col("x")).alias("y")).first()["y"]


def test_tokenize_golden(spark):
    assert one(spark, tx.tokenize, "B2B image_token Café m² ½x ÉTÉ_1 don't") == ["b", "b", "café", "don", "t"]


def test_clean_markup_drops_urls_and_placeholders(spark):
    assert one(spark, lambda c: tx.tokenize(tx.clean_markup(c)), "see https://a.com/x_y?q=1 ~z") == ["see", "z"]


DOMAIN_GOLDEN = [
    ("https://www.bbb.org/us/wa/seattle/profile/beauty-salon/ed-wyse-beauty-supply-1296-22178881", "bbb"),
    ("https://www.yelp.com/biz/wyse-ed-beauty-supply-eugene", "yelp"),
    ("https://cobiz123.com/b/17716826-ed-wyse-beauty-supply", "cobiz123.com"),
    ("https://cobiz123.com/b/22886439-ed-wyse-beauty-supply", "cobiz123.com"),
    ("https://www.yelp.com/biz/ed-wyse-beauty-supply-kent", "yelp"),
    ("https://www.yellowpages.com/seattle-wa/mip/ed-wyse-beauty-supply-6525381", "yellowpages"),
    ("https://wikizer.com/us/ed-wyse-beauty-supply-12333205", "wikizer.com"),
]


@pytest.mark.parametrize("link,label", DOMAIN_GOLDEN)
def test_domain_label_golden(spark, link, label):
    assert one(spark, urls.domain_label, link) == label


def test_url_root(spark):
    assert one(spark, urls.url_root, "https://www.walmart.com/a") == "walmart.com"
    assert one(spark, lambda c: urls.url_root(c, legacy=True), "https://www.walmart.com/a") == "almart.com"
    assert one(spark, urls.url_root, "www.foo.com/bar") == "foo.com/bar"
    assert one(spark, urls.url_root, "foo.com/bar") == "foo.com/bar"


def test_scheme_functions(spark):
    df = spark.createDataFrame([("http://a.com", "https://a.com/x")], "w string, l string")
    assert df.select(urls.align_scheme("w", "l")).first()[0] == "https://a.com"
    assert one(spark, urls.fix_double_scheme, "https://http://a.com") == "http://a.com"


def test_resolve_link(spark):
    df = spark.createDataFrame([("https://a.com/b/c", h) for h in ("/x", "y", "https://z.com", "mailto:a@b")],
                               "b string, h string")
    got = [r[0] for r in df.select(urls.resolve_link("b", "h")).collect()]
    assert got == ["https://a.com/x", "https://a.com/b/y", "https://z.com", None]


def test_record_functions(spark):
    assert one(spark, rc.title_case, "  new   YORK city-hall o'neil ") == "New York City-hall O'neil"
    assert one(spark, rc.normalise_country, "USA") == "United States"
    assert one(spark, rc.to_year, " 1998 ") == 1998
    assert one(spark, rc.to_year, "n/a") is None


def test_redirect_and_total(spark):
    assert one(spark, urls.decode_redirect, "https://r.search.x/RU=https%3a%2f%2fa.com%2fb+c/RK=2") == "https://a.com/b+c"
    assert one(spark, urls.total_hits, "About 12,400 results") == 12400


def test_emails(spark):
    text = "write to A.b+c@Shop-1.co.uk. or sales@nuts.com, x@y"
    assert one(spark, hx.emails_in_text, text) == ["A.b+c@Shop-1.co.uk.", "sales@nuts.com"]
    assert one(spark, lambda c: hx.emails_in_text(c, strict=True), text) == ["sales@nuts.com"]


def test_edit_distance_and_best_domain(spark):
    name = "ed wyse beauty supply"
    rows = [("q", name, d, i) for i, d in enumerate(["bbb", "yelp", "wysebeauty"])]
    pairs = spark.createDataFrame(rows, "request_id string, name string, domain string, pos int")
    d = [r[0] for r in pairs.select(F.levenshtein("name", "domain")).collect()]
    assert d == [20, 18, 11]
    assert best_domain(pairs).first()["domain"] == "wysebeauty"
    assert best_domain(pairs, legacy=True).first()["domain"] == "bbb"


def test_listing_seed_encoding(spark):
    kw = spark.createDataFrame([("r", "almonds")], "request_id string, keyword string")
    c = spark.createDataFrame([("r", "United Kingdom")], "request_id string, country string")
    assert "United%20Kingdom/almonds.html" in listing_seeds(kw, c).first()["url"]


def test_pager_offsets():
    assert [wn.page_start(p) for p in (1, 2, 3)] == [1, 11, 60]
    assert wn.max_result_pages() == 21


def test_porter_stems():
    for w, s in [("caresses", "caress"), ("ponies", "poni"), ("motoring", "motor"), ("hopping", "hop"),
                 ("relational", "relat"), ("happy", "happi"), ("generalizations", "gener")]:
        assert stem(w) == s


def test_tfidf_cosine_golden(spark):
    docs = spark.createDataFrame([(1, "almond almond butter"), (2, "almond milk"), (3, "steel bolt")],
                                 "doc int, text string").select("doc", tx.preprocess("text").alias("tokens"))
    q = spark.createDataFrame([("a", "almond"), ("b", "organic almond milk"), ("c", "granite")],
                              "q string, text string").select("q", tx.preprocess("text").alias("tokens"))
    got = {(r.q, r.doc): round(r.score, 6) for r in rv.tfidf_cosine(docs, q, ["doc"], ["q"]).collect()}
    assert got[("a", 1)] == pytest.approx(0.593876, abs=1e-6)
    assert got[("a", 2)] == pytest.approx(0.346242, abs=1e-6)
    assert got[("b", 1)] == pytest.approx(0.205625, abs=1e-6)
    assert got[("b", 2)] == pytest.approx(1.0, abs=1e-6)
    assert ("c", 1) not in got and ("a", 3) not in got  # zero scores are implicit


def test_soft_cosine_golden(spark):
    vec = spark.createDataFrame([("almond", [1.0, 0.0]), ("nut", [0.8, 0.6]), ("steel", [0.0, 1.0])],
                                "term string, embedding array<float>")
    s = rv.term_similarity(vec)
    sims = {(r.t1, r.t2): round(r.sim, 6) for r in s.collect()}
    assert sims[("almond", "nut")] == pytest.approx(0.64) and sims[("nut", "steel")] == pytest.approx(0.36)
    assert ("almond", "steel") not in sims and sims[("nut", "nut")] == 1.0
    d = spark.createDataFrame([("L1", "nut", 1.0)], "doc string, term string, w double")
    q = spark.createDataFrame([("q", "almond", 1.0), ("q", "steel", 1.0)], "q string, term string, w double")
    got = rv.soft_cosine(q, d, s, ["q"], ["doc"]).first()["score"]
    assert got == pytest.approx(0.707107, abs=1e-6)


def test_group_row_number_matches_window(spark):
    from pyspark.sql import Window
    df = spark.range(0, 500).select((F.col("id") % 3).alias("g"), F.col("id"))
    a = wn.group_row_number(df, ["g"], ["id"], "rn")
    b = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("id")))
    assert sorted(map(tuple, a.select("g", "id", "rn").collect())) == sorted(map(tuple, b.collect()))


def test_keep_matches_prefix(spark):
    rows = [("r", "c", "a", 0.9), ("r", "c", "b", 0.7), ("r", "c", "c", 0.2), ("s", "c", "a", 0.1)]
    df = spark.createDataFrame(rows, "request_id string, classification string, code string, score double")
    kept = {(r.request_id, r.code) for r in wn.keep_matches(df, ["request_id", "classification"]).collect()}
    assert kept == {("r", "a"), ("r", "b"), ("s", "a")}


def test_visible_tokens_skip_script_and_title(spark):
    html = ('<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>'
            '<body><!-- c --><p>a &amp; b</p></body></html>')
    assert one(spark, hx.visible_tokens, html) == ["a", "&", "b"]


def test_select_text_rules(spark):
    html = '<div class="company-name x"><a class="company-name" href="/p1">Acme</a></div><span class="page">3</span>'
    pages = spark.createDataFrame([("u", html)], "url string, html string")
    rows = hx.select_text(pages, [("link", "company-name", "a", "href"), ("pager", "page", "", None)]).collect()
    got = {(r.rule, r.value) for r in rows}
    assert ("link", "/p1") in got and ("pager", "3") in got
