"""Element ranges, search pages, product lines, directory discovery and the
profile records on pages that are nested, broken or cut short."""
import pytest
from pyspark.sql import functions as F

from sourcinglens.operators import elements as el
from sourcinglens.operators import filters as fl
from sourcinglens.operators.directories import FIELDS, product_lines
from sourcinglens.operators.search_pages import search_pages, search_results
from sourcinglens.plans import discovery as ds


def one(spark, html, column):
    return spark.createDataFrame([(html,)], "html string").select(column.alias("c")).first().c


@pytest.mark.parametrize("html, want", [
    ("<div class='a'>x<div>y</div>z</div>t", ["x<div>y</div>z"]),
    ("<div class='a'><br>1<p>2</div>3", ["<br>1<p>2"]),                          # closed by its own end tag, with an open <p>
    ("<ul><li class='a'>1<li>2</ul>3", ["1<li>2"]),                              # ended by the list that holds it
    ("</div><b class=\"x a\">1</i></b><b class=ab>2</b>", ["1</i>"]),            # end tags without a start
    ("<p class='a'>open <i>to the end", ["open <i>to the end"]),
    ("<!-- <p class='a'>no</p> --><script>'<p class=\"a\">'</script>", []),
    ("<img class='a'><i class='a' title='x > y'>t</i>", ["t"]), ("", []), (None, [])])
def test_inner(spark, html, want):
    assert one(spark, html, el.inner(el.pieces_of(F.col("html")), lambda p: el.has_class(p, "a"))) == want


def test_without_keeps_outer_elements(spark):
    html = "<div class='k'>1<div class='a'><div>2</div></div>3</div><p>4"
    left = F.array_join(el.without(el.pieces_of(F.col("html")), lambda p: el.has_class(p, "a")), "")
    assert one(spark, html, left) == "<div class='k'>13</div><p>4"
    open_ad = "<ol><li class='a'>1<b>2</b></ol>3"
    assert one(spark, open_ad, left) == "<ol></ol>3"


def test_long_page(spark):
    html = "<div class='a'>" * 3 + "<p>x</p>" * 3000 + "</div>" * 3
    assert one(spark, html, F.size(el.ranges(el.pieces_of(F.col("html")), lambda p: el.has_class(p, "a")))) == 1


def test_search_pages(spark):
    pages = spark.createDataFrame([
        (1, "<div class='AdTop'><a class='mxw-100p' href='/RU=https%3a%2f%2fad.example/'>a</a></div>"
            "<a class='mxw-100p' href='/RU=https%3a%2f%2fs.example%2fx/'>a</a><a class='mxw-100p' href='/RU=https%3a%2f%2fo.example/'>b</a>"
            "<div class='fc-smoke'><span class='lh-22'>About 1,234 results</span></div>"),
        (2, "<p>none</p>"), (3, None)], "page_id int, html string")
    got = {r.page_id: (r.total, r.links) for r in search_pages(pages).collect()}
    assert got == {1: (1234, ["https://s.example/x", "https://o.example"]), 2: (None, []), 3: (None, [])}
    sites = spark.createDataFrame([(1, "https://s.example")], "page_id int, site string")
    assert [tuple(r) for r in search_results(pages, sites).collect()] == [(1, 1234, 0, "https://s.example/x")]


def test_product_lines_stop(spark):
    def page(n, more):
        return f"<i class='products-list--item'><b class='ellipsis'><a>p{n}</a></b></i><a class='page'>1</a>{'<a class=prevnext>n</a>' if more else ''}"
    rows = [("all", n, page(n, n < 40)) for n in range(1, 41)]                   # 31 pages are read
    rows += [("gap", n, page(n, True)) for n in (1, 2, 4)] + [("last", 1, page(1, False)), ("last", 2, page(2, True))]
    rows += [("late", 2, page(2, True)), ("empty", 1, ""), ("null", 1, None)]
    got = {r.url: r.products for r in product_lines(spark.createDataFrame(rows, "url string, page int, html string").repartition(5)).collect()}
    assert got == {"all": [f"p{n}" for n in range(1, 32)], "gap": ["p1", "p2"], "last": ["p1"], "empty": [], "null": []}


def test_discovery_goes_on_from_its_queue(spark):
    profile = "<div><h1 class='company-content__company-name'>{}</h1></div>"
    pages = spark.createDataFrame([
        ("http://d/w.html", "<a class='page'>1</a><a class='page'>2</a><a class='page'>next</a>"),
        ("http://d/pg-1/w.html", "<a class='company-name' href='http://d/a'>a</a><a class='company-name' href='http://d/b'>b</a>"),
        ("http://d/pg-2/w.html", "<a class='company-name' href='http://d/b'>b</a><a class='company-name' href='http://d/c'>c</a>"),
        ("http://d/a", profile.format("A")), ("http://d/b", profile.format("B")), ("http://d/c", "no profile")], "url string, html string")
    seeds = spark.createDataFrame([("http://d/w.html", "Europages")] * 2, "url string, origin string")
    stored = spark.createDataFrame([("http://d/a",)], "_id string")
    records, queue = ds.discover_directory(ds.seed_rows(seeds), pages, stored, F.lit(5.0))
    assert [(r.url, r.name) for r in records.collect()] == [("http://d/b", "B")] and records.columns == list(FIELDS)
    state = {r._id: r.discovered for r in queue.collect()}
    assert state == {"seed:http://d/w.html": 5, "listing:http://d/pg-1/w.html": 5, "listing:http://d/pg-2/w.html": 5,
                     "profile:http://d/b": 5, "profile:http://d/c": -2}
    # Cut short after the first wave: the queue says what is left.
    half = queue.withColumn("discovered", F.when(F.col("_id") == "listing:http://d/pg-2/w.html", 0.0).otherwise(F.col("discovered"))).where("url <> 'http://d/c'")
    again, after = ds.discover_directory(half, pages, stored, F.lit(9.0))
    assert again.collect() == [] and {r._id: r.discovered for r in after.collect() if r.discovered != 5} == {
        "listing:http://d/pg-2/w.html": 9, "profile:http://d/c": -2}
    nothing, _ = ds.discover_directory(queue, pages, stored, F.lit(9.0))
    assert nothing.collect() == []


def test_filter_suppliers_long_text(spark):
    """A text of 200,000 characters, terms of one, two and more characters, and suppliers for requests without a condition."""
    long = "lorem ipsum dolor " * 11_000 + "Ünïque😀word z"
    rows = [("a", "", long, None, "w"), ("b", "X", "q", ["Zinc plate"], "w"), ("c", "X", None, None, "w"), ("d", "X", long, None, "")]
    sup = spark.createDataFrame([(i, (c,), t, k, w, {"K": ["1"]} if i == "c" else {}) for i, c, t, k, w in rows],
                                "_id string, postalAddress struct<addressCountry:string>, description string, keywords array<string>, website string, classifications map<string,array<string>>")
    requests = spark.createDataFrame([(n, []) for n in ("r1", "r2", "r3", "r4", "r5", "none")] + [("x", ["X"])], "request_id string, countries array<string>")
    codes = spark.createDataFrame([("r5", "K", "1")], "request_id string, classification string, code string")
    terms = spark.createDataFrame([("r1", "ünïque😀word"), ("r2", "z"), ("r3", "nc"), ("r4", "absent word"), ("x", "lorem ips")], "request_id string, term string")
    got = {(r.request_id, r._id) for r in fl.filter_suppliers(sup, requests, codes, terms).collect()}
    assert got == {("r1", "a"), ("r2", "a"), ("r2", "b"), ("r3", "b"), ("r5", "c"), ("none", "a"), ("none", "b"), ("none", "c")}


def test_every_field_of_both_page_families(spark):
    """All fields can be selected, and both families normalise the country."""
    from sourcinglens.operators.directories import extract_by_origin
    cells = "".join(f"<tr><th>l</th><td> {'USA' if i == 5 else 1999 if i == 17 else f'v{i}'}</td></tr>" for i in range(24))
    by_class = "<h1 class='company-content__company-name'>N</h1><i class='flag-1x'></i><span>USA</span>"
    pages = spark.createDataFrame([("a", "Organicbio", f"<table>{cells}</table>"), ("b", "Europages", by_class), ("c", "x", "")], "url string, origin string, html string")
    got = {r.url: r for r in extract_by_origin(pages).select(*FIELDS, "reason").collect()}
    assert {u: got[u].addressCountry for u in got} == {"a": "United States", "b": "United States", "c": None}
    assert (got["a"].name, got["a"].yearEstablished, got["a"].certifications) == ("v0", 1999, ["v15"]) and got["c"].reason == "unknown origin"
