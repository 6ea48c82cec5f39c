"""Checks of the ingest operators (group A)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import extract as ex
from ..operators import ingest as ig
from ..sources import files
from . import sqltext as q
from .oracle import cte, query
from .scale import shared_folder
from .tables import AS_OF, Tables

ROOT = "https://site.example.com"

cte("pg", f"""
SELECT page_id, url, html, {q.main_content('html')} AS body_html, {q.netloc('url')} AS netloc FROM pages
""")
cte("pt", f"SELECT *, {q.visible('body_html')} AS body_text FROM pg", "pg")


@query("a1_extract_posts", f"""
SELECT page_id, {q.normalize('url')} AS url, sha256({q.squeeze('body_text')}) AS content_hash,
  {q.words('body_text')}::INTEGER AS word_count, lower(regexp_extract(html, '(?is)<html[^>]*\\slang="([^"]*)"', 1)) AS language,
  {q.n('body_html', '(?is)<h[1-6](?:\\s[^>]*)?>.*?</h[1-6]>')}::INTEGER AS n_headings
FROM pt WHERE {q.words('body_text')} >= 100 AND length({q.strip('body_text')}) >= 50
""", "pt")
def a1(t: Tables):
    p = ex.extract_posts(t.pages).filter("skip_reason IS NULL")
    return p.select("page_id", "url", "content_hash", "word_count", "language", F.size("headings").alias("n_headings"))


def _cms_json(t: Tables):
    d = t.posts
    return d.select(
        "post_id",
        F.to_json(
            F.struct(
                F.col("url").alias("link"),
                F.struct(F.col("title").alias("rendered")).alias("title"),
                F.struct(F.concat(F.lit("<p>"), "body_text", F.lit("</p>")).alias("rendered")).alias("content"),
                F.struct(F.concat(F.lit("<p>"), "title", F.lit("</p>")).alias("rendered")).alias("excerpt"),
                F.date_format("publish_date", "yyyy-MM-dd'T'HH:mm:ss").alias("date"),
                F.when(
                    F.col("post_id") % 3 == 0,
                    F.struct(
                        F.when(F.col("post_id") % 2 == 0, F.col("meta_description")).alias("description"),
                        F.concat(F.lit("og "), "title").alias("og_description"),
                    ),
                ).alias("yoast_head_json"),
            )
        ).alias("json"),
    )


@query("a2_cms_posts", f"""
SELECT post_id, url, title, CAST(publish_date AS DATE) AS publish_date,
  {q.words(q.visible("body_text"))}::INTEGER AS word_count,
  coalesce(
    CASE WHEN post_id % 6 = 0 THEN nullif(left({q.strip('meta_description')}, 320), '') END,
    CASE WHEN post_id % 3 = 0 THEN left({q.strip("'og ' || title")}, 320) END,
    nullif(left({q.inner('title')}, 320), '')) AS meta_description
FROM posts
""", "posts")
def a2(t: Tables):
    return ig.cms_posts(_cms_json(t)).select(
        "post_id", "url", "title", F.to_date("publish_date").alias("publish_date"), "word_count", "meta_description"
    )


@query("a3_term_names", """
SELECT o_orderkey AS post_id, coalesce(array_to_string(list(n_name ORDER BY pos) FILTER (n_name IS NOT NULL), ','), '') AS names
FROM (SELECT o_orderkey, unnest([o_custkey % 30, o_orderkey % 25, 7]) AS id, unnest([0, 1, 2]) AS pos FROM orders)
LEFT JOIN nation ON n_nationkey = id GROUP BY o_orderkey
""")
def a3(t: Tables):
    posts = t.raw("orders").select(
        F.col("o_orderkey").alias("post_id"),
        F.array(F.col("o_custkey") % 30, F.col("o_orderkey") % 25, F.lit(7).cast("long")).alias("ids"),
    )
    terms = t.raw("nation").select(F.col("n_nationkey").alias("term_id"), F.col("n_name").alias("name"))
    return ig.resolve_terms(posts, terms, "ids", "names").select("post_id", F.array_join("names", ",").alias("names"))


@query("a4_feed_urls", """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'url' WHEN 1 THEN 'sitemap' WHEN 2 THEN 'item' ELSE 'entry' END AS kind, url FROM pages
""")
def a4(t: Tables):
    u = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    wrap = lambda a, b: F.concat(F.lit(a), u, F.lit(b))
    xml = (
        F.when(F.col("page_id") % 4 == 0, wrap('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> ', " </loc></url></urlset>"))
        .when(F.col("page_id") % 4 == 1, wrap("<sitemapindex><sitemap><loc>", "</loc></sitemap></sitemapindex>"))
        .when(F.col("page_id") % 4 == 2, wrap("<rss><channel><item><link>", "</link></item></channel></rss>"))
        .otherwise(wrap('<feed><entry><link rel="self" href="x"/><link rel="alternate" href="', '"/></entry></feed>'))
    )
    return ig.feed_urls(t.pages.select("page_id", xml.alias("xml")))


@query("a5_url_patterns", f"SELECT page_id, url FROM pages WHERE contains(lower({q.path('url')}), '/en/') OR contains(lower({q.path('url')}), '.html')")
def a5(t: Tables):
    return ig.filter_url_patterns(t.pages.select("page_id", "url"), ["/en/", ".html"])


@query("a6_robots", f"""
WITH u AS (SELECT page_id, url, {q.path('url')} AS p FROM pages)
SELECT page_id, url FROM u
WHERE NOT (starts_with(p, '/en/9') OR (NOT starts_with(p, '/en') AND starts_with(p, '/fr')))
""")
def a6(t: Tables):
    from ..functions import urls as ux

    hosts = t.pages.select(ux.netloc(F.col("url")).alias("host")).distinct()
    rules = hosts.select(
        "host",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i).alias("pos"), F.lit(a).alias("allow"), F.lit(p).alias("prefix"))
                    for i, (a, p) in enumerate([(False, "/en/9"), (True, "/en"), (False, "/fr")])
                ]
            )
        ),
    )
    return ig.filter_disallowed(t.pages.select("page_id", "url"), rules).select("page_id", "url")


@query("a7_crawl_cap", f"""
SELECT page_id, url, len({q.path('url')}) - len(replace({q.path('url')}, '/', '')) AS depth
FROM pages ORDER BY depth, url LIMIT 60
""")
def a7(t: Tables):
    return ig.crawl_cap(t.pages.select("page_id", "url"), 60).withColumn("depth", F.col("depth").cast("long"))


def _site_posts(t: Tables):
    return t.raw("customer").select(
        F.col("c_custkey").alias("post_id"), F.concat(F.lit(ROOT + "/p/"), F.col("c_custkey").cast("string"), F.lit("/")).alias("url")
    )


@query("a8_search_rows", """
SELECT g.post_id, g.date, g.query, g.impressions, g.clicks, g.avg_position, g.ctr
FROM gsc g JOIN customer ON c_custkey = g.post_id
""", "gsc")
def a8(t: Tables):
    raw = t.gsc.select(
        F.concat(F.lit(ROOT + "/p/"), F.col("post_id").cast("string")).alias("page"), "query", F.col("date").cast("string").alias("date"),
        "impressions", "clicks", F.col("avg_position").alias("position"), "ctr", F.col("impressions").alias("row_id"),
    )
    return ig.load_search_rows(raw, _site_posts(t))


@query("a9_search_page_days", """
WITH r AS (SELECT post_id % 40 AS p, date, query, impressions, clicks, avg_position, ctr FROM gsc),
pq AS (SELECT p, date, query, sum(clicks) AS clicks FROM r GROUP BY 1, 2, 3),
top AS (SELECT p, date, string_agg(query, ',' ORDER BY rn) AS top_queries FROM (
  SELECT *, row_number() OVER (PARTITION BY p, date ORDER BY clicks DESC, query) AS rn FROM pq WHERE clicks > 0) WHERE rn <= 10 GROUP BY 1, 2)
SELECT 'https://site.example.com/p/' || p AS page, date, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions,
  round(sum(ctr * impressions) / sum(impressions), 6) AS ctr, round(sum(avg_position * impressions) / sum(impressions), 6) AS avg_position,
  count(*) AS query_count, coalesce(any_value(top_queries), '') AS top_queries
FROM r LEFT JOIN top USING (p, date) GROUP BY p, date
""", "gsc")
def a9(t: Tables):
    p = (F.col("post_id") % 40).cast("string")
    raw = t.gsc.select(
        F.when(F.col("clicks") > 0, F.concat(F.lit("http://www.Site.example.com/p/"), p, F.lit("/?utm_source=x#top")))
        .otherwise(F.concat(F.lit(ROOT + "/p/"), p)).alias("page"),
        "date", "query", "impressions", "clicks", F.col("avg_position").alias("position"), "ctr",
    )
    return ig.search_page_days(raw).withColumns({"ctr": F.round("ctr", 6), "avg_position": F.round("avg_position", 6)})


@query("a10_traffic_rows", """
SELECT g.post_id, g.date, pageviews, sessions, bounce_rate, avg_time AS avg_session_duration, engaged_sessions
FROM ga4 g JOIN customer ON c_custkey = g.post_id
""", "ga4")
def a10(t: Tables):
    raw = t.ga4.select(
        F.concat(F.lit("/P/"), F.col("post_id").cast("string"), F.lit("/")).alias("pagePath"),
        F.date_format("date", "yyyyMMdd").alias("date"),
        F.col("pageviews").cast("string").alias("screenPageViews"), F.col("sessions").cast("string").alias("sessions"),
        F.col("bounce_rate").cast("string").alias("bounceRate"), F.col("avg_time").cast("string").alias("averageSessionDuration"),
        F.col("engaged_sessions").cast("string").alias("engagedSessions"),
    )
    return ig.load_traffic_rows(raw, _site_posts(t))


@query("a11_sync_window", """
WITH f AS (SELECT post_id AS site_id, max(date) AS last_date FROM gsc GROUP BY 1), s AS (SELECT c_custkey AS site_id FROM customer)
SELECT site_id, coalesce(last_date + 1, DATE '2024-01-31' - 90) AS start_date, DATE '2024-01-31' - 3 AS end_date,
  coalesce(last_date + 1, DATE '2024-01-31' - 90) <= DATE '2024-01-31' - 3 AS due
FROM s LEFT JOIN f USING (site_id)
""", "gsc")
def a11(t: Tables):
    facts = t.gsc.select(F.col("post_id").alias("site_id"), "date")
    return ig.sync_window(facts, t.raw("customer").select(F.col("c_custkey").alias("site_id")), AS_OF)


def _crawls(t: Tables):
    """Two crawls of the same URLs: the first and the second half of January."""
    rows = t.events.select(
        F.concat(F.lit("/u/"), F.col("user_id").cast("string"), F.lit("/"), F.col("k").cast("string")).alias("url"),
        F.col("event_type").alias("body"), "event_id", "date",
    )
    state = lambda df: df.groupBy("url").agg(F.max_by("body", "event_id").alias("body"), F.max("event_id").alias("version")).withColumn(
        "content_hash", F.sha2("body", 256)
    )
    split = F.lit("2024-01-16").cast("date")
    return state(rows.filter(F.col("date") < split)), state(rows.filter(F.col("date") >= split))


cte("crawls", """
SELECT '/u/' || user_id || '/' || k AS url, date >= DATE '2024-01-16' AS fresh, max_by(event_type, event_id) AS body, max(event_id) AS version
FROM ev GROUP BY user_id, k, 2
""", "ev")
cte("old_crawl", "SELECT * FROM crawls WHERE NOT fresh", "crawls")
cte("new_crawl", "SELECT * FROM crawls WHERE fresh", "crawls")


@query("a12_upsert", "SELECT url, max_by(body, version) AS body, max(version) AS version FROM crawls GROUP BY url", "crawls")
def a12(t: Tables):
    old, new = _crawls(t)
    return ig.upsert(old, new, ["url"], "version").select("url", "body", "version")


@query("a13_recrawl_diff", """
SELECT coalesce(o.url, n.url) AS url,
  CASE WHEN o.url IS NULL THEN 'new' WHEN n.url IS NULL THEN 'deleted' WHEN o.body <> n.body THEN 'updated' ELSE 'unchanged' END AS status
FROM old_crawl o FULL JOIN new_crawl n ON o.url = n.url
""", "old_crawl new_crawl")
def a13(t: Tables):
    return ig.recrawl_diff(*_crawls(t))


@query("a14_soft_delete", """
SELECT url, CASE WHEN url IN (SELECT url FROM new_crawl) THEN 200 ELSE 410 END AS http_status FROM old_crawl
""", "old_crawl new_crawl")
def a14(t: Tables):
    old, new = _crawls(t)
    return ig.soft_delete(old.withColumn("http_status", F.lit(200)), new).select("url", "http_status")


@query("a15_embed_candidates", """
SELECT post_id FROM posts LEFT JOIN labels ON doc_id = post_id
WHERE body_text <> '' AND (doc_id IS NULL OR quality = 0)
""", "posts")
def a15(t: Tables):
    stored = t.raw("labels").join(t.posts.select(F.col("post_id").alias("doc_id"), "content_hash"), "doc_id").select(
        F.col("doc_id").alias("post_id"), F.when(F.col("quality") == 0, "stale").otherwise(F.col("content_hash")).alias("content_hash")
    )
    return ig.embedding_candidates(t.posts, stored).select("post_id")


def _refresh_sites(t: Tables):
    last = t.raw("orders").groupBy(F.col("o_custkey").alias("site_id")).agg(
        F.max("o_orderdate").alias("last_sync_at"), F.min("o_orderdate").alias("last_crawl_at")
    )
    return t.raw("customer").select(
        F.col("c_custkey").alias("site_id"), (F.col("c_mktsegment") != "MACHINERY").alias("connected")
    ).join(last, "site_id", "left")


cte("rsites", """
SELECT c_custkey AS site_id, c_mktsegment <> 'MACHINERY' AS connected, last_sync_at, last_crawl_at FROM customer
LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_sync_at, min(o_orderdate) AS last_crawl_at FROM orders GROUP BY 1) ON o_custkey = c_custkey
""")


@query("a16_refresh_due", """
SELECT 'analytics' AS kind, site_id FROM (SELECT * FROM rsites WHERE connected AND (last_sync_at IS NULL OR last_sync_at < DATE '2001-06-01' - 1) ORDER BY last_sync_at NULLS FIRST, site_id LIMIT 50)
UNION ALL SELECT 'crawl', site_id FROM (SELECT * FROM rsites WHERE last_crawl_at IS NULL OR last_crawl_at < DATE '2001-06-01' - 7 ORDER BY last_crawl_at NULLS FIRST, site_id LIMIT 20)
UNION ALL SELECT 'embed', site_id FROM (
  SELECT site_id FROM rsites LEFT JOIN (SELECT o_custkey, bool_or(o_orderstatus = 'P' OR o_orderdate < DATE '2001-06-01' - 30) AS due FROM orders GROUP BY 1) ON o_custkey = site_id
  WHERE due IS NULL OR due ORDER BY site_id LIMIT 10)
""", "rsites")
def a16(t: Tables):
    sites = _refresh_sites(t)
    embeds = t.raw("orders").select(
        F.col("o_custkey").alias("site_id"), (F.col("o_orderstatus") == "P").alias("stale"), F.col("o_orderdate").alias("updated_at")
    )
    parts = [
        ig.refresh_due(sites, "2001-06-01", kind, embeds, ig.REFRESH_RULES[kind][1]).select(F.lit(kind).alias("kind"), "site_id")
        for kind in ("analytics", "crawl", "embed")
    ]
    return ig.union_all(parts)


@query("a17_redirect_lines", f"""
WITH r AS (SELECT url AS old_url, 'https://new.example.com/' || page_id AS new_url, {q.path('url')} AS p FROM pages)
SELECT 'htaccess' AS fmt, 'Redirect 301 ' || regexp_replace(url, '^.*?//[^/]*', '') || ' https://new.example.com/' || page_id AS line FROM pages
UNION ALL SELECT 'plugin', '"' || old_url || '","' || new_url || '",0,301' FROM r
UNION ALL SELECT 'csv', '"' || old_url || '","' || new_url || '"' FROM r
""")
def a17(t: Tables):
    m = t.pages.select(F.col("url").alias("old_url"), F.concat(F.lit("https://new.example.com/"), F.col("page_id").cast("string")).alias("new_url"))
    return ig.union_all([ig.redirect_lines(m, f) for f in ("htaccess", "plugin", "csv")])


def scratch(t: Tables, name: str) -> str:
    """Folder for written tables: the cluster's shared one, a local one in tests."""
    return f"{shared_folder(t.spark).rstrip('/')}/{name}-{t.spark.sparkContext.applicationId}"


@query("a18_site_table_sink", "SELECT post_id, site_id, CASE WHEN site_id = 'src0' THEN word_count + 1 ELSE word_count END AS word_count FROM posts", "posts")
def a18(t: Tables):
    target = scratch(t, "posts-by-site")
    cols = t.posts.select("post_id", "site_id", "word_count")
    ig.write_site_table(cols, target)
    ig.write_site_table(cols.filter("site_id = 'src0'").withColumn("word_count", F.col("word_count") + 1), target)
    return t.spark.read.parquet(target).select("post_id", "site_id", "word_count")


@query("a18_site_reload", "SELECT post_id, site_id, CASE WHEN site_id = 'src0' THEN word_count + 1 ELSE word_count END AS word_count FROM posts WHERE site_id <> 'src1' OR site_id IS NULL", "posts")
def a18_reload(t: Tables):
    """A second run covers two sites and finds posts of one only; the table is compacted after it."""
    target = f"{scratch(t, 'site-runs')}-{uuid.uuid4().hex[:8]}"
    cols = t.posts.select("post_id", "site_id", "word_count")
    ig.replace_sites(cols, cols.select("site_id"), target)
    again = cols.filter("site_id = 'src0'").withColumn("word_count", F.col("word_count") + 1)
    ig.replace_sites(again, cols.select("site_id").filter("site_id IN ('src0', 'src1')"), target)
    ig.compact_sites(t.spark, target, target + "-small")
    return ig.site_rows(t.spark, target + "-small")


@query("a4_sitemap_tree", "SELECT url, 'https://site.example.com/map' || page_id // 10 || '.xml' AS sitemap FROM pages WHERE page_id // 10 % 7 <> 5")
def a4_tree(t: Tables):
    """Ten pages a sitemap, ten sitemaps an index; indexes form a binary tree whose every node also names the top, some sitemaps stay unnamed."""
    folder = f"{scratch(t, 'sitemaps')}-{uuid.uuid4().hex[:8]}"
    site = "https://site.example.com/"
    entry = lambda tag, loc: F.concat(F.lit(f"<{tag}><loc>"), F.replace(loc, F.lit("&"), F.lit("&amp;")), F.lit(f"</loc></{tag}>"))
    file_of = lambda kind, n: F.concat(F.lit(site + kind), n.cast("long").cast("string"), F.lit(".xml"))
    whole = lambda tag: F.concat(F.lit(f"<{tag}>"), F.array_join(F.collect_list("e"), ""), F.lit(f"</{tag}>"))
    maps = t.pages.select(F.floor(F.col("page_id") / 10).alias("n"), entry("url", F.col("url")).alias("e")).groupBy("n").agg(whole("urlset").alias("value"))
    top = t.pages.agg(F.floor(F.max("page_id") / 100)).first()[0] or 0
    index = t.spark.range(top + 1).withColumn("leaf", F.explode(F.sequence(F.col("id") * 10, F.col("id") * 10 + 9)))
    leaves = index.filter("leaf % 7 <> 5").select(F.col("id").alias("n"), entry("sitemap", file_of("map", F.col("leaf"))).alias("e"))
    below = t.spark.range(top + 1).select(F.col("id").alias("n"), F.explode(F.array(F.col("id") * 2 + 1, F.col("id") * 2 + 2, F.lit(0))).alias("m"))
    index = leaves.unionByName(below.select("n", entry("sitemap", file_of("index", F.col("m"))).alias("e"))).groupBy("n").agg(whole("sitemapindex").alias("value"))
    docs = maps.withColumn("kind", F.lit("map")).unionByName(index.withColumn("kind", F.lit("index")))
    docs.repartition("kind", "n").write.partitionBy("kind", "n").option("compression", "gzip").text(folder)
    fetched = t.spark.read.text(folder).select(F.concat(F.lit(site), "kind", F.col("n").cast("string"), F.lit(".xml")).alias("url"), F.col("_metadata.file_path").alias("file"))
    return files.read_sitemap_tree(t.spark, folder, fetched, [site + "index0.xml"]).select("url", "sitemap")
