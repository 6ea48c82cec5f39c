"""HTML extraction as column expressions over the raw markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_match, let, squeeze, strip


def unescape(c: Column) -> Column:
    for entity, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def drop_code(html: Column) -> Column:
    """Remove script, style and comment blocks."""
    html = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", "")
    html = F.regexp_replace(html, r"(?is)<style[^>]*>.*?</style>", "")
    return F.regexp_replace(html, r"(?s)<!--.*?-->", "")


def inner_text(html: Column) -> Column:
    """Text of one small element: tags removed, trimmed, entities decoded."""
    return unescape(strip(F.regexp_replace(html, r"<[^>]+>", "")))


def visible_text(html: Column) -> Column:
    """Text of a page or section: code dropped, tags become blanks."""
    return unescape(squeeze(F.regexp_replace(drop_code(html), r"<[^>]+>", " ")))


def opening_text(html: Column, n: int) -> Column:
    """The first ``n`` characters of ``visible_text``, mostly from the first part of the page.

    A part reads as it does within the page if it ends with a tag, leaves no
    script, style or comment open and gives more than ``n`` characters (16
    more, as an entity may be cut); otherwise the whole page is read.
    """
    part = F.regexp_extract(F.left(html, F.lit(2 * n)), r"(?s)^.*>", 0)
    bare = F.regexp_replace(part, r"(?is)<script[^>]*>.*?</script>", "")
    text = F.when(~bare.rlike(r"(?i)<script|<style|<!--|<[^>]*$"), unescape(squeeze(F.regexp_replace(bare, r"<[^>]+>", " "))))
    whole = F.left(visible_text(html), F.lit(n))
    return F.when(F.length(html) <= 2 * n, whole).otherwise(let(text, lambda t: F.when(F.length(t) >= n + 16, F.left(t, F.lit(n))).otherwise(whole)))


def main_content(html: Column) -> Column:
    """main, else article, else a content/post/entry div, else body, else all."""
    return F.coalesce(
        first_match(html, r"(?is)<main[^>]*>(.*)</main>"),
        first_match(html, r"(?is)<article[^>]*>(.*)</article>"),
        first_match(html, r"(?is)<div[^>]*class=[\"'][^\"']*(?:content|post|entry)[^\"']*[\"'][^>]*>(.*)</div>"),
        first_match(html, r"(?is)<body[^>]*>(.*)</body>"),
        html,
    )


def attr(tag: Column, name: str) -> Column:
    pattern = r"(?is)\s" + name + r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    return F.coalesce(first_match(tag, pattern, 1), first_match(tag, pattern, 2))


def meta(html: Column, key: str, value: str) -> Column:
    """content= of the first <meta key="value">."""
    # quoted values may hold a ">" of their own
    rest = r"(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+>"
    tag = F.regexp_extract(html, rf"(?is)<meta[^>]*\s{key}\s*=\s*[\"']{value}[\"']{rest}", 0)
    return attr(tag, "content")


def title(html: Column, url: Column) -> Column:
    return F.coalesce(
        F.nullif(inner_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")),
        F.nullif(inner_text(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)), F.lit("")),
        url,
    )


def meta_description(html: Column) -> Column:
    cleaned = squeeze(F.regexp_replace(unescape(meta(html, "name", "description")), r"<[^>]+>", ""))
    return F.nullif(cleaned, F.lit(""))


def headings(html: Column) -> Column:
    """h1–h6 in document order; short all-title-case h4–h6 are bylines and go."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6](?:\s[^>]*)?>.*?</h[1-6]>"), F.lit(0))
    parsed = F.transform(
        found,
        lambda t: F.struct(
            F.lower(F.regexp_extract(t, r"(?i)^<(h[1-6])", 1)).alias("level"),
            inner_text(t).alias("text"),
        ),
    )
    byline = lambda h: (h["level"] >= "h4") & h["text"].rlike(
        r"(?U)^(?:\p{Lu}[^\p{Lu}\s]*\p{Ll}[^\p{Lu}\s]*|\S)(?:\s+(?:\p{Lu}[^\p{Lu}\s]*\p{Ll}[^\p{Lu}\s]*|\S)){0,2}$"
    )
    return F.filter(parsed, lambda h: (h["text"] != "") & ~byline(h))


def anchors(html: Column) -> Column:
    """Every <a href> as (href, anchor text)."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*>.*?</a>"), F.lit(0))
    parsed = F.transform(
        found,
        lambda t: F.struct(
            unescape(attr(F.regexp_extract(t, r"(?is)^<a\s[^>]*>", 0), "href")).alias("href"),
            inner_text(t).alias("text"),
        ),
    )
    return F.filter(parsed, lambda a: a["href"].isNotNull())


def iso_timestamp(c: Column) -> Column:
    """Local part of an ISO date or date-time; the zone is dropped."""
    return F.try_to_timestamp(first_match(c, r"^(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?)"))


def jsonld_types(html: Column) -> Column:
    """@type values inside JSON-LD blocks, one level, string or array form."""
    blocks = F.regexp_extract_all(
        html, F.lit(r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1)
    )
    return F.filter(
        F.flatten(
            F.transform(
                blocks,
                lambda b: F.flatten(
                    F.transform(
                        F.regexp_extract_all(b, F.lit(r"\"@type\"\s*:\s*(\[[^\]]*\]|\"[^\"]*\")"), F.lit(1)),
                        lambda t: F.regexp_extract_all(t, F.lit(r"\"([^\"]*)\""), F.lit(1)),
                    )
                ),
            )
        ),
        lambda t: t != "",
    )
