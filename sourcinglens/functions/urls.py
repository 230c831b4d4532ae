"""URL column functions (T7-T11, T18, T19), all built-in expressions.

Hosts are taken with a regex rather than ``parse_url`` because ``parse_url``
returns NULL for non-ASCII hosts and keeps the host's case.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns.
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"
NETLOC = SCHEME + r"([^/?#]*)"                 # group 1: user@host:port
HOSTNAME = SCHEME + r"(?:[^@/?#]*@)?([^:/?#]*)"  # group 1: host without user/port
ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def netloc(url: Column | str) -> Column:
    return F.regexp_extract(_c(url), NETLOC, 1)


def hostname(url: Column | str) -> Column:
    """Lower-cased host, NULL when the URL has no scheme or no host."""
    h = F.lower(F.regexp_extract(_c(url), HOSTNAME, 1))
    return F.when(h != "", h)


def domain_label(url: Column | str) -> Column:
    """Host text up to and including its 2nd dot-separated part (found
    by its first occurrence in the host), with 'www.' removed.  NULL when
    the host has no dot."""
    host = netloc(url)
    second = F.split_part(host, F.lit("."), F.lit(2))
    pos = F.instr(host, second)
    return F.when(F.instr(host, ".") > 0,
                  F.replace(F.left(host, pos - 1 + F.length(second)), F.lit("www."), F.lit("")))


def url_root(website: Column | str, legacy: bool = False) -> Column:
    """Host without 'www.'; input starting 'www.' keeps its path; input
    without a host is returned unchanged.  ``legacy`` strips the character
    set {w, .} from the left instead of the 'www.' prefix."""
    w = _c(website)
    strip = (lambda c: F.regexp_replace(c, r"^[w.]+", "")) if legacy else (
        lambda c: F.regexp_replace(c, r"^www\.", ""))
    host = hostname(w)
    return (F.when(w.startswith("www."), strip(w))
            .when(host.isNotNull(), strip(host))
            .otherwise(w))


def align_scheme(website: Column | str, first_link: Column | str) -> Column:
    """Strip http(s):// from the website and take the first hit's scheme."""
    bare = F.replace(F.replace(_c(website), F.lit("http://"), F.lit("")), F.lit("https://"), F.lit(""))
    fl = _c(first_link)
    return (F.when(fl.startswith("http://"), F.concat(F.lit("http://"), bare))
            .when(fl.startswith("https://"), F.concat(F.lit("https://"), bare))
            .otherwise(bare))


def fix_double_scheme(website: Column | str) -> Column:
    """Lower-case, collapse doubled schemes (four fixed rewrites, in order)."""
    c = F.lower(_c(website))
    for old, new in (("http://http://", "http://"), ("https://https://", "https://"),
                     ("https://http://", "http://"), ("http://https://", "https://")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def resolve_link(base: Column | str, href: Column | str) -> Column:
    """T11: '/x' -> origin + x; non-http -> directory of base + x; else as is.

    A base without a path joins with '/' inserted; 'mailto:', 'javascript:'
    and '#' links give NULL.
    """
    b, h = _c(base), _c(href)
    origin = F.regexp_extract(b, ORIGIN, 1)
    path = F.regexp_extract(b, SCHEME + r"[^/?#]*([^?#]*)", 1)
    directory = F.when(path.contains("/"), F.regexp_extract(b, r"^(.*/)", 1)).otherwise(F.concat(b, F.lit("/")))
    return (F.when(h.isNull() | (h == "") | h.startswith("#") | F.lower(h).startswith("mailto:")
                   | F.lower(h).startswith("javascript:"), F.lit(None).cast("string"))
            .when(h.startswith("/"), F.concat(origin, h))
            .when(~h.startswith("http"), F.concat(directory, h))
            .otherwise(h))


def decode_redirect(href: Column | str) -> Column:
    """Percent-decoded text between 'RU=' and the next '/'; '+' is kept
    (escaped before decoding); undecodable text is returned raw."""
    raw = F.regexp_extract(_c(href), r"RU=([^/]*)/", 1)
    decoded = F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    return F.when(_c(href).rlike(r"RU=[^/]*/"), F.coalesce(decoded, raw))


def total_hits(text: Column | str) -> Column:
    """First whole-digit word once commas are removed (bigint)."""
    t = F.replace(_c(text), F.lit(","), F.lit(""))
    num = F.regexp_extract(t, r"(?:^|\s)(\d+)(?:\s|$)", 1)
    return F.when(num != "", num.cast("bigint"))


def site_host(site: Column | str) -> Column:
    """Requested site without scheme (in-site tests)."""
    return F.replace(F.replace(_c(site), F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
