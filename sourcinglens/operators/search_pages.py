"""Search result pages (H9): adverts go with all that they hold, result links
are decoded, the total is read, and links of other sites are left out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcinglens.functions.urls import decode_redirect, total_hits
from sourcinglens.operators import elements as el
from sourcinglens.operators.directories import plain
from sourcinglens.operators.filters import in_site
from sourcinglens.operators.html import decode_entities

# The classes of an advert, a result link, and of the total in its bar.
ADVERT, RESULT, BAR, TOTAL = "AdTop", "mxw-100p", "fc-smoke", "lh-22"
HREF = r"""(?is)\shref\s*=\s*(?:"([^"]*)"|'([^']*)')"""


def search_pages(pages: DataFrame, key: Sequence[str] = ("page_id",)) -> DataFrame:
    """One row per page: (key..., total, links): links in page order, those
    that hold no redirect target left out; total NULL where there is none.

    A null or empty page has no links.  An unclosed advert reaches to the end
    of the element that holds it.
    """
    def of(kept: F.Column) -> F.Column:
        tags = F.filter(kept, lambda p: el.has_class(p, RESULT))
        hrefs = F.transform(tags, lambda p: decode_entities(F.concat(F.regexp_extract(p, HREF, 1), F.regexp_extract(p, HREF, 2))))
        bars = el.inner(kept, lambda p: el.has_class(p, BAR))
        totals = F.flatten(F.transform(bars, lambda b: el.inner(F.split(b, "(?=<)"), lambda p: el.has_class(p, TOTAL))))
        return F.struct(total_hits(plain(F.get(totals, F.lit(0)))).alias("total"),
                        F.filter(F.transform(hrefs, decode_redirect), lambda x: x.isNotNull()).alias("links"))

    found = el.bound(el.without(el.pieces_of(F.col("html")), lambda p: el.has_class(p, ADVERT)), of)
    return pages.select(*key, found.alias("_f")).select(*key, "_f.total", "_f.links")


def search_results(pages: DataFrame, sites: DataFrame | None = None, key: Sequence[str] = ("page_id",)) -> DataFrame:
    """H9: (key..., total, pos, link), one row per result link; with ``sites``
    (key..., site) only links into a site of the page's request (F8)."""
    hits = search_pages(pages, key).select(*key, "total", F.posexplode("links").alias("pos", "link"))
    return hits if sites is None else in_site(hits, sites, key)
