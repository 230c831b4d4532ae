"""Filters, predicates, projections (F1-F9) and set operators.

Document-store null rules: ``$ne ''`` keeps missing values
(``NOT (x <=> '')``); array predicates match any element; SQL OR with NULL
is coalesced to false.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcinglens.functions import urls
from sourcinglens.session import cut_lineage

# Fixed value: a page showing this block is a captcha wall.
CAPTCHA_DIV = r"""<div[^>]*\sclass\s*=\s*["']alert alert-info["']"""
BEHIND = "\x00\x00"           # no character of a text
LISTED = 10_000               # about so many terms are looked up in a text at a time
HANDS = 256                   # shares that suppliers are dealt into where every request gets all of them


def is_nonempty(col: Column | str) -> Column:
    """F5 for arrays/strings: not NULL, not '', not [], and no NULL/'' element."""
    c = F.col(col) if isinstance(col, str) else col
    return c.isNotNull() & (F.size(c) > 0) & ~F.exists(c, lambda e: e.isNull() | (e == ""))


def map_nonempty(col: Column | str) -> Column:
    """F5 for maps ({} is empty)."""
    c = F.col(col) if isinstance(col, str) else col
    return c.isNotNull() & (F.size(c) > 0)


def filter_suppliers(suppliers: DataFrame, requests: DataFrame, code_matches: DataFrame,
                     terms: DataFrame) -> DataFrame:
    """the long list, ``(request_id, _id)``.

    Per request: country IN countries (when any) AND (some supplier code is
    matched OR the description or a keyword contains a term, when any codes
    or terms exist) AND website is not ''.  A NULL country list is an empty
    one; a request with no condition at all gets every supplier.

    Codes are an equi-join.  Terms are one too, over the n-grams of up to three
    letters that terms and texts share (``_holders``).
    """
    sup = suppliers.select("_id", F.col("postalAddress.addressCountry").alias("country"),
                           F.lower(F.col("description")).alias("_desc"),
                           F.transform("keywords", lambda k: F.lower(k)).alias("_kw"),
                           "website", "classifications")
    sup = sup.where(~F.col("website").eqNullSafe(""))
    place = sup.select("_id", "country")
    req_country = requests.select("request_id", F.explode("countries").alias("country")).distinct()
    no_country = requests.where(F.coalesce(F.size("countries"), F.lit(0)) <= 0).select("request_id")

    codes = cut_lineage(code_matches.select("request_id", "classification", "code"))      # read twice, as are the terms
    sup_codes = sup.select("_id", F.explode("classifications").alias("classification", "codes")).select(
        "_id", "classification", F.explode("codes").alias("code"))
    by_code = sup_codes.join(codes, ["classification", "code"]).select("request_id", "_id").distinct()

    t = cut_lineage(terms.select("request_id", F.lower("term").alias("term")).where(F.length("term") > 0).distinct())
    by_term = _holders(sup.select("_id", F.concat(F.coalesce("_kw", F.array().cast("array<string>")),
                                                  F.array(F.coalesce("_desc", F.lit("")))).alias("texts")), "_id",
                       t.select("term").distinct()).join(t, "term").select("request_id", "_id")

    matched = by_code.unionByName(by_term).distinct().join(place, "_id")
    has_or = codes.select("request_id").unionByName(t.select("request_id")).distinct()
    plain = requests.select("request_id").join(has_or, "request_id", "left_anti")
    in_country = matched.join(req_country, ["request_id", "country"], "left_semi").select("request_id", "_id")
    free = matched.join(no_country, "request_id", "left_semi").select("request_id", "_id")
    by_country = place.join(req_country.join(plain, "request_id", "left_semi"), "country").select("request_id", "_id")
    # No condition: the result is requests x suppliers.  Suppliers are dealt by a hash, the requests go to each hand.
    every = plain.join(no_country, "request_id", "left_semi").select("request_id", F.explode(F.sequence(F.lit(0), F.lit(HANDS - 1))).alias("_hand"))
    everything = place.select("_id", F.pmod(F.xxhash64("_id"), F.lit(HANDS)).cast("int").alias("_hand")).join(every, "_hand").select("request_id", "_id")
    return (in_country.unionByName(free).unionByName(by_country).unionByName(everything)).distinct()


def _ngrams(text: Column, longest_only: bool = False) -> Column:
    """Distinct n-grams of up to three characters; ``longest_only``: those of
    length min(3, length of the text), which any text that contains it has.
    One pass over the text, whatever its length: shorter n-grams are the starts
    of the longest ones of the text with two more characters behind it."""
    def longest(x: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(F.concat(x, F.lit(BEHIND)), F.lit("(?s)(?=(...))"), F.lit(1)))

    def real(grams: Column) -> Column:
        return F.filter(F.array_distinct(grams), lambda g: ~F.contains(g, F.lit(BEHIND[0])))

    def all_of(threes: Column) -> Column:
        shorter = F.flatten(F.array(*[F.array_distinct(F.transform(threes, lambda g: F.left(g, F.lit(n)))) for n in (1, 2)]))
        return real(F.concat(threes, shorter))

    bound = F.transform(F.array(longest(text)), lambda threes: all_of(threes))
    grams = F.get(bound, F.lit(0))
    return F.filter(grams, lambda g: F.length(g) == F.least(F.lit(3), F.length(text))) if longest_only else grams


def _holders(texts: DataFrame, key: str, terms: DataFrame) -> DataFrame:
    """(key, term): rows of ``texts`` (key, array texts; one row per key) of which
    a text contains the term.

    The index holds the terms' own n-grams only.  A term's rarest n-gram gives
    candidates, the index must have all of its others for them too, and only
    then does ``contains`` read a text, for all terms of a list at once.
    """
    of_term = cut_lineage(terms.select("term", F.explode(_ngrams(F.col("term"), longest_only=True)).alias("gram")))
    grams = F.array_distinct(F.flatten(F.transform("texts", lambda x: _ngrams(x))))
    # Cutting texts is work for many tasks even where the texts are few megabytes.
    texts = texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    index = cut_lineage(texts.select(key, F.explode(grams).alias("gram")).join(of_term.select("gram").distinct(), "gram", "left_semi"))
    held = index.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = of_term.join(held, "gram", "left").groupBy("term").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"), F.count("*").alias("wanted"))
    found = cut_lineage(index.join(rarest, "gram").select(key, "term", "wanted"))
    whole = found.join(of_term, "term").join(index, [key, "gram"], "left_semi").groupBy(key, "term", "wanted").agg(
        F.count("*").alias("n")).where("n = wanted")
    # A term of up to three characters is its only n-gram.  A text meets the others in lists, not once for each.
    lists = int(terms.count() // LISTED + 1)
    asked = whole.where(F.length("term") > 3).groupBy(key, F.pmod(F.xxhash64("term"), F.lit(lists)).alias("_list")).agg(
        F.collect_list("term").alias("asked"))
    held_terms = F.filter("asked", lambda t: F.exists("texts", lambda x: x.contains(t)))
    return whole.where(F.length("term") <= 3).select(key, "term").unionByName(
        asked.join(texts, key).select(key, F.explode(held_terms).alias("term")))


def project_supplier(df: DataFrame) -> DataFrame:
    """the nested 7-field projection (nested column pruning)."""
    return df.select("_id", "name", "keywords", "description", "classifications",
                     F.col("postalAddress.addressCountry").alias("addressCountry"), "website", "contactEmails")


def pending(queue: DataFrame, limit: int, origin: str | None = None) -> DataFrame:
    """queue rows with discovered = 0, the first ``limit`` by _id per
    origin (or for one origin)."""
    q = queue.where(F.col("discovered") == 0)
    if origin is not None:
        q = q.where(F.col("origin") == origin)
    w = Window.partitionBy("origin").orderBy("_id")
    return q.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def missing_website(df: DataFrame) -> DataFrame:
    """website = '' and no enrichment candidates."""
    enr = F.coalesce(F.col("companydataEnriched"), F.array())
    return df.where((F.col("website") == "") & (F.size(enr) == 0))


def name_lookup(df: DataFrame, names: DataFrame, name_col: str = "name") -> DataFrame:
    """records carrying one of the given exact names (semi-join)."""
    return df.join(names.select(name_col).distinct(), name_col, "left_semi")


def links_for_domain(hits: DataFrame, chosen: DataFrame, keys: Sequence[str] = ("request_id",)) -> DataFrame:
    """links whose domain label equals the chosen one (equi-join)."""
    return hits.join(chosen.select(*keys, "domain"), [*keys, "domain"], "left_semi")


def host_suffixes(host: Column) -> Column:
    """'a.b.c' -> ['a.b.c', 'b.c', 'c']."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)),
                       lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def in_site(hits: DataFrame, sites: DataFrame, keys: Sequence[str] = ("request_id",),
            legacy: bool = False) -> DataFrame:
    """F8: keep a hit when its host is a requested site or a subdomain of it.

    Equi-join on host suffixes.  ``legacy`` keeps the substring rule (the
    site text anywhere in the link), joined on the request key only.
    """
    s = sites.select(*keys, F.lower(urls.site_host(F.col("site"))).alias("_site")).distinct()
    if legacy:
        return hits.join(s, list(keys)).where(F.col("link").contains(F.col("_site"))).drop("_site").distinct()
    h = hits.withColumn("_site", F.explode(host_suffixes(urls.hostname("link"))))
    return h.join(s, [*keys, "_site"], "left_semi").drop("_site")


def usable_pages(pages: DataFrame) -> DataFrame:
    """status 200 and no captcha block."""
    return pages.where((F.col("status") == 200) & ~F.coalesce(F.col("html").rlike(CAPTCHA_DIV), F.lit(False)))


# --- set operators ------------------------------------------------------------

def expand_codes(codes: DataFrame, seeds: DataFrame, keywords: DataFrame | None = None,
                 stems: DataFrame | None = None, parents: bool = True) -> DataFrame:
    """Union of the given codes, the 5-character parents of 7-character
    codes, codes whose label contains the keyword and codes whose label
    contains its stem; distinct ``(request_id, classification, code, label)``.

    ``seeds``: (request_id, classification, code); ``keywords``/``stems``:
    (request_id, word).  Words find labels as terms find suppliers in F1.
    """
    cb = codes.select("classification", "code", "label")
    wanted = seeds.select("request_id", "classification", "code")
    seeded = wanted.select("request_id", "classification").distinct()
    if parents:
        wanted = wanted.unionByName(wanted.where(F.length("code") == 7).withColumn("code", F.left("code", F.lit(5))))
    out = wanted.join(cb, ["classification", "code"]).select("request_id", "classification", "code", "label")
    labels = cb.select("label").distinct().select("label", F.array("label").alias("texts"))
    for words in (keywords, stems):
        if words is None:
            continue
        w = words.select("request_id", "word").distinct()
        hit = _holders(labels, "label", w.select(F.col("word").alias("term")).distinct()).select("label", F.col("term").alias("word"))
        found = cb.join(hit, "label").join(w, "word").join(seeded, ["request_id", "classification"], "left_semi")
        out = out.unionByName(found.select("request_id", "classification", "code", "label"))
    return out.distinct()


def term_groups(terms: DataFrame) -> DataFrame:
    """Per term the OR-group [term] or [term, lemma]."""
    return terms.withColumn("group", F.array_distinct(F.array("term", "lemma")))


def email_union(emails: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct emails over all pages of a key."""
    return emails.select(*keys, "email").distinct()
