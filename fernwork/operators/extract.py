"""Page markup → posts, headings, links and text chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as hx
from ..functions import text as tx
from ..functions import urls as ux
from ..plans.scale import latest

# fixed values: URL pieces that name a page type, in order of precedence
PAGE_TYPE_PATHS = [
    ("product", ["/product/", "/products/", "/shop/", "/store/", "/p/", "/item/"]),
    ("documentation", ["/docs/", "/doc/", "/api/", "/reference/", "/changelog/", "/sdk/", "/guide/"]),
    ("glossary", ["/glossary/", "/terms/", "/definitions/", "/what-is-", "/what-is/"]),
    ("landing", ["/features", "/pricing", "/enterprise", "/solutions/"]),
    ("index", ["/category/", "/tag/", "/tags/", "/archive/", "/page/"]),
]
# fixed values: structured-data types that name a page type
PAGE_TYPE_SCHEMA = {
    "Product": "product", "SoftwareApplication": "product",
    "TechArticle": "documentation", "APIReference": "documentation",
    "FAQPage": "blog", "HowTo": "blog", "Recipe": "blog",
    "Article": "blog", "BlogPosting": "blog", "NewsArticle": "blog",
}
# fixed values: markup that shows a product page, and short landing paths
PRODUCT_SIGNS = [
    'class="price"', 'class="product-price"', "add-to-cart", "add to cart", "buy now", 'itemprop="price"',
]
LANDING_PATHS = ["", "about", "contact", "team", "careers", "privacy", "terms"]
# fixed values: domains counted as credible sources
CREDIBLE_DOMAINS = [
    "gov", "edu", "who.int", "nature.com", "pubmed", "harvard.edu", "mit.edu", "stanford.edu", "reuters.com",
]
MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z.]*"
VISIBLE_DATE = rf"(?i)(?:{MONTH}\s+\d{{1,2}},?\s+\d{{4}})|(?:published|posted|updated|modified)\s*[:\s]*\d"
# fixed values: where an update date shows in the markup, in order of trust
UPDATE_DATE_PATTERNS = [
    r"(?is)updated?\s*(?:on\s*)?:?\s*([A-Z][a-z]+ \d{1,2},?\s+\d{4})",
    r"(?is)last\s+updated?\s*:?\s*([A-Z][a-z]+ \d{1,2},?\s+\d{4})",
    r"(?is)revised?\s*:?\s*([A-Z][a-z]+ \d{1,2},?\s+\d{4})",
    r"(?is)modified?\s*:?\s*([A-Z][a-z]+ \d{1,2},?\s+\d{4})",
    r"(?is)<time[^>]+datetime=[\"'](\d{4}-\d{2}-\d{2}[T\d:+Z.-]*)[\"']",
    r"(?is)dateModified[\"']?\s*:\s*[\"'](\d{4}-\d{2}-\d{2}[T\d:+Z.-]*)[\"']",
    r"(?is)\"@type\"\s*:\s*\"Article\".*?\"dateModified\"\s*:\s*\"(\d{4}-\d{2}-\d{2})",
]


def internal_links(html: Column, url: Column, domain: Column) -> Column:
    """array<struct<target_url, anchor_text>> of links that stay on the domain."""
    resolved = F.transform(
        hx.anchors(html),
        lambda a: F.struct(
            ux.resolve(url, a["href"]).alias("target_url"), F.nullif(a["text"], F.lit("")).alias("anchor_text")
        ),
    )
    site = F.replace(F.lower(domain), F.lit("www."), F.lit(""))
    return F.filter(resolved, lambda a: ux.host(a["target_url"]) == site)


def canonical_url(html: Column, url: Column, domain: Column) -> Column:
    """Declared canonical URL when it is on the same domain, else the URL."""
    tag = F.regexp_extract(html, r"(?is)<link[^>]*\srel\s*=\s*[\"']canonical[\"'][^>]*>", 0)
    href = tx.strip(hx.attr(tag, "href"))
    site = F.replace(F.lower(domain), F.lit("www."), F.lit(""))
    return F.when(ux.host(href) == site, href).otherwise(url)


def _first_time(html: Column, marks: str) -> Column:
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<time\s[^>]*>"), F.lit(0))
    named = F.filter(tags, lambda t: F.lower(F.coalesce(hx.attr(t, "class"), F.lit(""))).rlike(marks))
    stamps = F.filter(F.transform(named, lambda t: hx.iso_timestamp(hx.attr(t, "datetime"))), lambda x: x.isNotNull())
    return F.try_element_at(stamps, F.lit(1))


def publish_date(html: Column) -> Column:
    tag = F.coalesce(
        hx.meta(html, "property", "article:published_time"),
        hx.meta(html, "property", "og:published_time"),
        hx.meta(html, "itemprop", "datePublished"),
    )
    return F.coalesce(hx.iso_timestamp(tag), _first_time(html, "publish|created|entry-date"))


def modified_date(html: Column) -> Column:
    tag = F.coalesce(
        hx.meta(html, "property", "article:modified_time"),
        hx.meta(html, "property", "og:updated_time"),
        hx.meta(html, "name", "last-modified"),
        hx.meta(html, "itemprop", "dateModified"),
    )
    return F.coalesce(hx.iso_timestamp(tag), _first_time(html, "modif|update"))


def freshness_from_body(html: Column, as_of: str) -> Column:
    """First believable update date named in the body (2010 … as_of)."""
    last = F.lit(as_of).cast("date")

    def parse(m: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(m, ",", ""), r"\s+", " ")
        iso = F.to_date(hx.iso_timestamp(m))
        return F.coalesce(iso, F.to_date(F.try_to_timestamp(bare, F.lit("MMMM d yyyy"))))

    found = []
    for pattern in UPDATE_DATE_PATTERNS:
        dates = F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), parse)
        good = F.filter(dates, lambda d: d.isNotNull() & (F.year(d) >= 2010) & (d <= last))
        found.append(F.try_element_at(good, F.lit(1)))
    return F.coalesce(*found)


def language(html: Column) -> Column:
    lang = hx.attr(F.regexp_extract(html, r"(?is)<html[^>]*>", 0), "lang")
    alt = hx.attr(F.regexp_extract(html, r"(?is)<link[^>]*\shreflang\s*=[^>]*>", 0), "hreflang")
    code = F.coalesce(lang, F.when(alt != "x-default", alt))
    return F.nullif(F.left(F.lower(F.substring_index(code, "-", 1)), F.lit(10)), F.lit(""))


def page_type(url: Column, html: Column, headings: Column) -> Column:
    p = F.lower(ux.path(url))
    low = F.lower(html)
    types = F.regexp_extract_all(html, F.lit(r"\"@type\"\s*:\s*\"([^\"]+)\""), F.lit(1))
    lookup = F.create_map(*[F.lit(x) for kv in PAGE_TYPE_SCHEMA.items() for x in kv])
    by_schema = F.try_element_at(F.filter(F.transform(types, lambda t: F.try_element_at(lookup, t)), lambda t: t.isNotNull()), F.lit(1))
    code = tx.count_matches(low, "<pre") + tx.count_matches(low, "<code")
    out = None
    for kind, needles in PAGE_TYPE_PATHS:
        out = (F if out is None else out).when(tx.any_of(p, needles), F.lit(kind))
    return (
        out.when(by_schema.isNotNull(), by_schema)
        .when(tx.any_of(low, PRODUCT_SIGNS), F.lit("product"))
        .when(code >= 3, F.lit("documentation"))
        .when((F.size(headings) == 1) & (tx.count_matches(low, "<a ") > 20) & (F.length(html) < 5000), F.lit("index"))
        .when(F.regexp_replace(p, r"^/+|/+$", "").isin(LANDING_PATHS), F.lit("landing"))
        .otherwise(F.lit("blog"))
    )


def trust_metadata(html: Column, *fields: str, opening: Column | None = None) -> Column:
    """Author, structured-data types, dates and links that sit in page chrome; only ``fields``, where any are named.

    ``opening``: the page's ``opening_text`` of 3000 characters, where it is at hand.
    """
    byline = F.regexp_extract(
        html, r"(?is)<div[^>]*class\s*=\s*[\"'][^\"']*(?:post-author|byline|entry-author)[^\"']*[\"'][^>]*>(.*?)</div>", 1
    )
    byline_link = F.nullif(hx.inner_text(F.regexp_extract(byline, r"(?is)<a[^>]*>(.*?)</a>", 1)), F.lit(""))
    author_link = F.nullif(
        hx.inner_text(F.regexp_extract(html, r"(?is)<a[^>]*href\s*=\s*[\"'][^\"']*/authors?/[^/\"']+[^\"']*[\"'][^>]*>(.*?)</a>", 1)),
        F.lit(""),
    )
    types = hx.jsonld_types(html)
    ld = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    links = hx.anchors(html)
    dated_class = F.nullif(
        hx.inner_text(
            F.regexp_extract(html, r"(?is)<[a-z][a-z0-9]*[^>]*class\s*=\s*[\"'][^\"']*(?:date|published)[^\"']*[\"'][^>]*>(.*?)</", 1)
        ),
        F.lit(""),
    )
    found = {
        "author_name": F.left(tx.strip(F.coalesce(hx.meta(html, "name", "author"), byline_link, author_link)), F.lit(60)),
        "schema_types": types,
        "has_author_schema": F.exists(ld, lambda b: b.rlike(r"\"author\"\s*:")),
        "has_visible_date": (
            html.rlike(r"(?is)<time[^>]*\sdatetime\s*=")
            | html.rlike(r"(?is)<meta[^>]*property\s*=\s*[\"']article:(published|modified)_time[\"']")
            | dated_class.isNotNull()
            | (hx.opening_text(html, 3000) if opening is None else opening).rlike(tx.beginning("jfmasondpu", VISIBLE_DATE))
        ),
        "has_contact_link": F.exists(
            links,
            lambda a: tx.any_of(F.lower(a["href"]), ["contact", "about", "team"])
            | tx.any_of(F.lower(a["text"]), ["contact", "about", "team"]),
        ),
        "credible_link_count": F.size(F.filter(links, lambda a: tx.any_of(F.lower(a["href"]), CREDIBLE_DOMAINS))),
        "has_og_tags": html.rlike(r"(?is)<meta[^>]*property\s*=\s*[\"']og:"),
        "has_canonical": html.rlike(r"(?is)<link[^>]*rel\s*=\s*[\"']canonical[\"']"),
        "has_jsonld": F.size(types) > 0,
    }
    return F.struct(*[found[f].alias(f) for f in fields or found])


def skip_reason(text: Column) -> Column:
    """Why a page is not kept; null when it passes the content gate."""
    n = F.length(tx.strip(text))
    w = tx.word_count(text)
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit("body_text_empty"))
        .when(n < 50, F.format_string("body_text_too_short (%d chars)", n))
        .when(w < 100, F.format_string("too_few_words (%d words)", w))
    )


def extract_posts(pages: DataFrame) -> DataFrame:
    """Raw pages(page_id, url, html) → one row per page with every derived column."""
    html, url = F.col("html"), F.col("url")
    step = pages.select(
        "page_id", url, html, hx.main_content(html).alias("body_html"),
        canonical_url(html, url, ux.netloc(url)).alias("final_url"),
    )
    body = F.col("body_html")
    step = step.withColumns({"body_text": hx.visible_text(body), "headings": hx.headings(body)})
    return step.select(
        "page_id",
        ux.normalize_url(F.col("final_url")).alias("url"),
        ux.host(F.col("final_url")).alias("site"),
        ux.slug(F.col("final_url")).alias("slug"),
        strip_site_name(hx.title(html, F.col("final_url"))).alias("title"),
        hx.meta_description(html).alias("meta_description"),
        "body_text", "body_html", "headings",
        internal_links(body, F.col("final_url"), ux.netloc(F.col("final_url"))).alias("links"),
        publish_date(html).alias("publish_date"),
        modified_date(html).alias("modified_date"),
        language(html).alias("language"),
        page_type(F.col("final_url"), body, F.col("headings")).alias("page_type"),
        trust_metadata(html).alias("trust"),
        tx.word_count(F.col("body_text")).alias("word_count"),
        tx.content_hash(F.col("body_text")).alias("content_hash"),
        skip_reason(F.col("body_text")).alias("skip_reason"),
    )


def dedup_urls(posts: DataFrame, order: str) -> DataFrame:
    """First occurrence of each normalized URL."""
    return latest(posts.withColumn("url", ux.normalize_url(F.col("url"))), ["url"], [F.asc(order)])


def strip_site_name(title: Column) -> Column:
    """Drop a trailing ' | Site' part of at most four words."""
    sep = r"\s+[|–—]\s+|\s+-\s+"
    parts = F.split(title, sep)
    last = tx.word_count(F.element_at(parts, -1))
    return F.when((F.size(parts) >= 2) & (last <= 4), tx.strip(F.element_at(parts, 1))).otherwise(title)


def _share_of_posts(items: DataFrame, keys: list[str], posts: DataFrame, site: str) -> DataFrame:
    """n posts per item and the site's post count (sites of three posts or more)."""
    total = posts.groupBy(site).agg(F.count("*").alias("_total")).filter("_total >= 3")
    seen = items.select(site, "post_id", *keys).distinct().groupBy(site, *keys).agg(F.count("*").alias("_n"))
    return seen.join(total, site)


def filter_nav_links(links: DataFrame, posts: DataFrame, site: str = "site", share: float = 0.8) -> DataFrame:
    """Drop links whose target appears on at least ``share`` of the site's posts."""
    keyed = links.withColumn("_key", F.lower(F.rtrim("target_url", F.lit("/"))))
    nav = _share_of_posts(keyed, ["_key"], posts, site).filter(F.col("_n") / F.col("_total") >= share)
    return keyed.join(nav.select(site, "_key"), [site, "_key"], "left_anti").drop("_key")


def filter_sitewide_headings(posts: DataFrame, site: str = "site", h1: float = 0.8, rest: float = 0.9) -> DataFrame:
    """Remove headings found on almost every page of a site.

    A site has at most (headings per page / 0.8) such headings, so they are
    attached as one small array and each post filters its own list in place,
    which keeps the order without exploding and regrouping.
    """
    items = posts.select(site, "post_id", F.explode("headings").alias("h")).select(
        site, "post_id", F.col("h.level").alias("level"), F.lower(tx.strip(F.col("h.text"))).alias("_text")
    ).filter("_text <> ''")
    shares = _share_of_posts(items, ["level", "_text"], posts, site)
    limit = F.when(F.col("level") == "h1", F.lit(h1)).otherwise(F.lit(rest))
    chrome = shares.filter(F.col("_n") / F.col("_total") >= limit).groupBy(site).agg(F.collect_set("_text").alias("_chrome"))
    return posts.join(chrome, site, "left").withColumn(
        "headings",
        F.filter(
            "headings",
            lambda h: ~F.coalesce(F.array_contains("_chrome", F.lower(tx.strip(h["text"]))), F.lit(False)),
        ),
    ).drop("_chrome")


def resolve_link_targets(links: DataFrame, posts: DataFrame, site: str = "site") -> DataFrame:
    """Exact match of normalized link targets to posts of the same site."""
    t = posts.groupBy(site, F.col("url").alias("_t")).agg(F.min("post_id").alias("target_post_id"))
    keyed = links.withColumn("_t", ux.normalize_url(F.col("target_url")))
    return keyed.join(t, [site, "_t"], "left").withColumnRenamed("_t", "target_norm")


def heading_counts(headings: Column, html: Column) -> list[Column]:
    n = lambda level: F.size(F.filter(headings, lambda h: h["level"] == level))
    return [
        n("h1").alias("h1_count"), n("h2").alias("h2_count"), n("h3").alias("h3_count"),
        tx.count_matches(html, r"(?i)<img[\s>]").alias("image_count"),
    ]


def section_chunks(html: Column, title: Column) -> Column:
    """Text chunks at h2/h3 boundaries; short pages with many headings stay whole."""
    clean = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", "")
    clean = F.regexp_replace(clean, r"(?is)<style[^>]*>.*?</style>", "")
    flat = lambda c: tx.squeeze(F.regexp_replace(c, r"<[^>]+>", " "))
    full = flat(clean)
    marked = F.regexp_replace(clean, r"(?is)<h[23][^>]*>(.*?)</h[23]>", "\u0001$1\u0002")
    parts = F.split(marked, "\u0001")
    sections = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    whole = F.array(F.when(full != "", F.concat(title, F.lit(": "), F.left(full, F.lit(800)))).otherwise(title))
    intro = flat(F.element_at(parts, 1))
    first = F.when(
        F.length(intro) > 100, F.array(F.concat(title, F.lit(" [intro]: "), F.left(intro, F.lit(600))))
    ).otherwise(F.array().cast("array<string>"))

    def chunk(s: Column) -> Column:
        head = tx.strip(F.regexp_replace(F.substring_index(s, "\u0002", 1), r"<[^>]+>", ""))
        body = flat(F.translate(s, "\u0002", " "))
        return F.when(F.length(body) > 80, F.concat(head, F.lit(": "), F.left(body, F.lit(700))))

    rest = F.filter(F.transform(sections, chunk), lambda x: x.isNotNull())
    chunks = F.concat(first, rest)
    return (
        F.when(F.coalesce(html, F.lit("")) == "", F.array(title))
        .when((F.size(sections) == 0) | ((tx.word_count(full) < 300) & (F.size(sections) > 5)), whole)
        .when(F.size(chunks) == 0, F.array(title))
        .otherwise(chunks)
    )


def overlap_chunks(posts: DataFrame, key: str = "post_id", size: int = 20000, overlap: int = 500) -> DataFrame:
    """(key, i, chunk): overlapping windows over the whole text, the title repeated in each, up to the first one too short.

    A title that leaves a window no more room than the overlap gives the first
    window alone, a text that is null gives none. Windows are cut from the text
    one by one, so a text of very many is never a row of all of them.
    """
    c = F.col
    prefix = F.when(F.coalesce("title", F.lit("")) != "", F.concat("title", F.lit("\n\n"))).otherwise(F.lit(""))
    rows = posts.filter(c("body_text").isNotNull()).select(key, prefix.alias("_pre"), F.concat(prefix, "body_text").alias("_t"))
    width, start = F.lit(size) - F.length("_pre"), size - overlap
    step = width - overlap
    more = F.when((F.length("_t") > size) & (step > 0), F.ceil(F.try_divide(F.length("_t") - start, step)).cast("int")).otherwise(0)
    window = lambda i: c("_t").substr(start + (i - 1) * step + 1, width)
    # an array of flags, not of windows
    short = F.array_position(F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda i: F.length(tx.strip(window(i))) < 200), F.lit(True)).cast("int")
    last = F.when(more == 0, 0).when(short == 0, more).otherwise(short - 1)
    first = tx.strip(F.left("_t", F.lit(size)))
    cut = rows.select(key, "_pre", "_t", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    return cut.select(key, "i", F.when(c("i") == 0, first).otherwise(tx.strip(F.concat("_pre", window(c("i"))))).alias("chunk"))


def smart_truncate(body: Column, headings: Column, limit: int = 4000) -> Column:
    """Intro, headings, sentences with figures and the end of a long text."""
    n = F.length(body)
    heads = F.transform(F.slice(headings, 1, 15), lambda h: F.concat(F.lit("\n["), h["level"], F.lit("] "), h["text"]))
    middle = F.when(n > 800, body.substr(F.lit(501), n - 800)).otherwise(F.lit(""))
    stats = F.filter(
        F.split(middle, r"[.!?]\s+"), lambda s: s.rlike(r"\d+%|\$\d|increase|decrease|improve|reduce")
    )
    sentences = F.transform(F.slice(stats, 1, 5), lambda s: F.left(tx.strip(s), F.lit(150)))
    tail = F.when(n > 300, F.array(F.concat(F.lit("\n..."), F.right(body, F.lit(300))))).otherwise(
        F.array().cast("array<string>")
    )
    joined = F.array_join(F.concat(F.array(F.left(body, F.lit(500))), heads, sentences, tail), "\n")
    return F.when(n <= limit, body).otherwise(F.left(joined, F.lit(limit)))


def smart_excerpt(text: Column, limit: int = 800) -> Column:
    """First and last half of a long text."""
    t = tx.strip(text)
    half = limit // 2
    head = F.regexp_replace(F.left(t, F.lit(half)), r"\s+$", "")
    tail = F.regexp_replace(F.right(t, F.lit(half)), r"^\s+", "")
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(head, F.lit("\n[...]\n"), tail))
