"""Small builders for the DuckDB side of the checks."""


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def unescape(x: str) -> str:
    for a, b in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")]:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def nocode(x: str) -> str:
    x = f"regexp_replace({x}, '(?is)<script[^>]*>.*?</script>', '', 'g')"
    x = f"regexp_replace({x}, '(?is)<style[^>]*>.*?</style>', '', 'g')"
    return f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"


def visible(x: str) -> str:
    return unescape(squeeze(f"regexp_replace({nocode(x)}, '<[^>]+>', ' ', 'g')"))


def inner(x: str) -> str:
    return unescape(strip(f"regexp_replace({x}, '<[^>]+>', '', 'g')"))


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '\\S+'))"


def n(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def plain(x: str) -> str:
    """Accented letters become underscores so ASCII word boundaries hold."""
    return f"regexp_replace({x}, '[À-ÖØ-öø-ÿ]', '_', 'g')"


def netloc(u: str) -> str:
    return f"lower(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1))"


def path(u: str) -> str:
    return f"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


TRACKING = (
    "'utm_source','utm_medium','utm_campaign','utm_content','utm_term','fbclid','gclid','msclkid','dclid',"
    "'mc_cid','mc_eid','ref','source','referrer','_ga','_gl','hsctatracking'"
)


def normalize(u: str) -> str:
    site = f"regexp_replace(regexp_replace({netloc(u)}, '^www\\.', ''), ':(443|80)$', '')"
    p = f"CASE WHEN {path(u)} IN ('', '/') THEN '/' ELSE rtrim({path(u)}, '/') END"
    qs = (
        f"array_to_string(list_sort(list_filter(string_split(regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1), '&'), "
        f"lambda kv: regexp_matches(kv, '^[^=]*=.+$') AND lower(split_part(kv, '=', 1)) NOT IN ({TRACKING}))), '&')"
    )
    return f"('https://' || {site} || {p} || CASE WHEN {qs} <> '' THEN '?' || {qs} ELSE '' END)"


def main_content(h: str) -> str:
    return (
        f"coalesce(nullif(regexp_extract({h}, '(?is)<main[^>]*>(.*)</main>', 1), ''), "
        f"nullif(regexp_extract({h}, '(?is)<article[^>]*>(.*)</article>', 1), ''), "
        f"nullif(regexp_extract({h}, '(?is)<body[^>]*>(.*)</body>', 1), ''), {h})"
    )
