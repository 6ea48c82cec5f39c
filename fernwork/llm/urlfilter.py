"""URL filter: host and path rules, then a weighted vocabulary found by Aho-Corasick.

A rule (host, path, verdict) fits its host and all its subdomains if the url's
path starts with the rule's path; the longest fitting rule decides. Elsewhere
the vocabulary does: its terms are counted in the lower-cased url by one
Aho-Corasick pass, where a term counts only between boundaries (the url's ends
or characters other than a-z and 0-9). One strict term, or ``soft_limit``
distinct soft terms, block the url.

Terms and rules are settings, not data: their number is bounded by ``MOST``
and they travel with the task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

MOST = 100_000
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
STRICT = ("porn", "xxx", "hardcore", "camgirls", "escorts", "bestiality", "warez", "keygen")
SOFT = ("adult", "sex", "sexy", "nude", "casino", "poker", "betting", "slots", "viagra", "cialis", "payday", "torrent", "crack", "hentai", "dating", "singles")
SOFT_LIMIT = 2
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
PARTS = re.compile(r"^.*?://([^/?#]*)([^?#]*)", re.S)


def automaton(strict: Sequence[str], soft: Sequence[str]) -> ahocorasick.Automaton | None:
    if len(strict) + len(soft) > MOST:
        raise ValueError(f"more than {MOST} terms")
    found = ahocorasick.Automaton()
    for hard, terms in ((False, soft), (True, strict)):
        for term in terms:
            if term:
                found.add_word(term.translate(LOWER), (term.translate(LOWER), hard))
    if not len(found):
        return None
    found.make_automaton()
    return found


def count_terms(url: str, terms: ahocorasick.Automaton | None) -> tuple[set[str], set[str]]:
    """Distinct strict and soft terms that stand between boundaries."""
    strict, soft = set(), set()
    if terms is None:
        return strict, soft
    word = lambda c: "a" <= c <= "z" or "0" <= c <= "9"
    for end, (term, hard) in terms.iter(url):
        start = end - len(term) + 1
        if (start == 0 or not word(url[start - 1])) and (end + 1 == len(url) or not word(url[end + 1])):
            (strict if hard else soft).add(term)
    return strict, soft


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lowered) and path; both empty without ``://``."""
    m = PARTS.match(url or "")
    return (m[1].translate(LOWER), m[2]) if m else ("", "")


def best_rule(host: str, path: str, by_host: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits; equal lengths go to the first in string order."""
    found = []
    tail = host
    while tail:
        found += [(tail + p, v) for p, v in by_host.get(tail, ()) if path.startswith(p)]
        tail = tail.partition(".")[2]
    return min(found, key=lambda x: (-len(x[0]), x[0])) if found else None


def judge(pages: DataFrame, url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """Adds host, path, rule, verdict, strict_hits, soft_hits to the columns of ``pages``.

    Null and empty urls have empty host and path, no hits and the verdict
    allow. Columns of ``pages`` named like a result column are replaced.
    """
    if len(rules) > MOST:
        raise ValueError(f"more than {MOST} rules")
    by_host: dict[str, list[tuple[str, str]]] = {}
    for host, path, verdict in rules:
        by_host.setdefault(host.translate(LOWER), []).append((path, verdict))
    made = pa.schema([("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("strict_hits", pa.int32()), ("soft_hits", pa.int32())])
    kept = [c for c in pages.columns if c.lower() not in made.names]
    if url_col not in kept:
        raise ValueError(f"the url column can't be called {url_col}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = automaton(strict, soft)
        for batch in batches:
            rows = []
            for url in batch.column(url_col).to_pylist():
                host, path = split_url(url)
                rule = best_rule(host, path, by_host)
                hard, mild = count_terms((url or "").translate(LOWER), terms)
                own = "block" if hard or len(mild) >= soft_limit else "allow"
                rows.append((host, path, rule and rule[0], rule[1] if rule else own, len(hard), len(mild)))
            columns = list(zip(*rows)) if rows else [()] * len(made)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(c, f.type) for c, f in zip(columns, made)], names=kept + made.names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*[f"`{c}`" for c in kept]).schema)
    return pages.select(*[f"`{c}`" for c in kept]).mapInArrow(run, f"{schema}, host string, path string, rule string, verdict string, strict_hits int, soft_hits int")


def op7(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits")


def _hits(terms: Sequence[str]) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"len(list_filter([{listed}], lambda t: regexp_matches(low, '(^|[^a-z0-9])' || t || '($|[^a-z0-9])')))::INTEGER"


ORACLE = f"""
WITH u AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, coalesce(url, '') AS url,
    position('://' IN coalesce(url, '')) AS mark FROM pages
),
p AS (
  SELECT *, CASE WHEN mark > 0 THEN regexp_extract(low[mark + 3:], '^[^/?#]*') ELSE '' END AS host,
    CASE WHEN mark > 0 THEN regexp_extract(url[mark + 3:], '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u
),
r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule,
    {_hits(STRICT)} AS strict_hits, {_hits(SOFT)} AS soft_hits
  FROM p
)
SELECT page_id, host, path, rule, strict_hits, soft_hits,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN strict_hits > 0 OR soft_hits >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
