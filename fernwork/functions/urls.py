"""URL parsing and normalization as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: query parameters that only track visits
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term",
    "fbclid", "gclid", "msclkid", "dclid",
    "mc_cid", "mc_eid",
    "ref", "source", "referrer",
    "_ga", "_gl",
    "hsctatracking",
]

_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?"


def netloc(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME + r"//([^/?#]*)", 1))


def host(url: Column) -> Column:
    """Lower-case host without www. and port-insensitive prefix rules of links."""
    return F.replace(netloc(url), F.lit("www."), F.lit(""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, _SCHEME + r"(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def _quote(c: Column) -> Column:
    encoded = F.url_encode(F.coalesce(F.try_url_decode(c), c))
    return F.replace(F.replace(encoded, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def normalize_url(url: Column) -> Column:
    """https, lower-case host without www/default port, no trailing slash,
    tracking parameters dropped, the rest sorted, fragment dropped."""
    site = F.regexp_replace(netloc(url), r"^www\.", "")
    site = F.regexp_replace(site, r":(443|80)$", "")
    p = path(url)
    p = F.when(p != "/", F.regexp_replace(p, r"/+$", "")).otherwise(p)
    p = F.when(p == "", F.lit("/")).otherwise(p)
    pairs = F.transform(
        F.filter(F.split(query(url), "&"), lambda kv: kv.rlike("^[^=]*=.+$")),
        lambda kv, i: F.struct(
            _quote(F.substring_index(kv, "=", 1)).alias("k"),
            i.alias("i"),
            _quote(F.regexp_extract(kv, "^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda s: ~F.lower(s["k"]).isin(TRACKING_PARAMS))
    qs = F.array_join(F.transform(F.array_sort(kept), lambda s: F.concat(s["k"], F.lit("="), s["v"])), "&")
    out = F.concat(F.lit("https://"), site, p, F.when(qs != "", F.concat(F.lit("?"), qs)).otherwise(""))
    return F.when(F.coalesce(url, F.lit("")) == "", url).otherwise(out)


def slug(url: Column) -> Column:
    """Last path segment, null for the root."""
    p = F.regexp_replace(path(url), r"^/+|/+$", "")
    return F.nullif(F.substring_index(p, "/", -1), F.lit(""))


def depth(url: Column) -> Column:
    return F.regexp_count(path(url), F.lit("/"))


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of a link found on the page ``base``."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(path(base), r"^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, "^([^#]*)", 1), href))
        .when(href.startswith("?"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), href))
        .when(href == "", base)
        .otherwise(F.concat(origin, folder, href))
    )
