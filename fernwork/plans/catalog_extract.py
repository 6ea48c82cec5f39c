"""Checks of the page extraction operators (group B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as hx
from ..functions import text as tx
from ..functions import urls as ux
from ..operators import clusters as cl
from ..operators import extract as ex
from . import sqltext as q
from .oracle import cte, query
from .tables import AS_OF, Tables

# DuckDB text of the article pages: documents wrapped in typical site chrome
cte("articles", """
SELECT * REPLACE (
  '<html lang="' || language || '-XX"><head><title>' || title || ' | Site ' || site_id || '</title>'
  || CASE WHEN meta_description IS NOT NULL THEN '<meta name="description" content="' || replace(meta_description, '"', '') || '">' ELSE '' END
  || CASE WHEN post_id % 5 = 0 THEN '<meta property="article:published_time" content="2023-05-0' || (post_id % 9 + 1) || 'T10:00:00Z">' ELSE '' END
  || CASE WHEN post_id % 6 = 0 THEN '<meta property="og:title" content="x"><link rel="canonical" href="' || url || '">' ELSE '' END
  || CASE WHEN post_id % 5 = 0 THEN '<script type="application/ld+json">{"@type":"Article","headline":"h","datePublished":"2023-01-01","author":{"name":"A"},"dateModified":"2023-0' || (post_id % 9 + 1) || '-11"}</script>'
         WHEN post_id % 5 = 1 THEN '<script type="application/ld+json">[{"@type":"FAQPage"},{"@type":["WebPage","Thing"]}]</script>' ELSE '' END
  || '</head><body><nav><a href="/home">Home</a> <a href="/about">About</a></nav><article><h1>' || title || '</h1>'
  || CASE WHEN post_id % 4 = 0 THEN '<div class="post-author"><a href="/author/ann">Ann Lee</a>, editor</div>' ELSE '' END
  || CASE WHEN post_id % 7 = 0 THEN '<time datetime="2023-06-15" class="entry-date">June 15</time><p>Updated on March 17, 2023</p>' ELSE '' END
  || CASE WHEN post_id % 3 = 0 THEN '<ol><li>one</li><li>two</li><li>three</li><li>four</li></ol><table><tr><th>a</th><th>b</th></tr><tr><td>1</td></tr><tr><td>2</td></tr></table>' ELSE '' END
  || CASE WHEN post_id % 2 = 0 THEN '<h3>What is this topic?</h3><p>This is the best way you can start and it will improve your results by 42% in one year of use.</p>' ELSE '' END
  || CASE WHEN post_id % 4 = 1 THEN '<h2>FAQ</h2><h3>How long?</h3><h3>Why so?</h3><p>They are short.</p><h3>Who can use it?</h3><p>All.</p>' ELSE '' END
  || repeat('<a href="https://www.example.gov/study/' || post_id || '">study</a> ', CAST(post_id % 12 AS INTEGER))
  || '<a href="/p/' || (post_id + 1) || '">next</a> <a href="next-' || (post_id % 20) || '">more</a> <img src="a.png">'
  || '<h4>Ann Lee</h4><h2>Share</h2>' || body_html || '</article><footer><a href="/contact">Contact</a></footer></body></html>' AS body_html)
FROM posts
""", "posts")


def articles(t: Tables):
    """Posts whose markup carries typical chrome (head, byline, lists, links)."""
    p, pid = t.posts, F.col("post_id")
    s = lambda x: F.lit(x)
    txt = lambda c: c.cast("string")
    when = lambda c, *parts: F.when(c, F.concat(*parts)).otherwise(s(""))
    digit = txt(pid % 9 + 1)
    html = F.concat(
        s('<html lang="'), "language", s('-XX"><head><title>'), "title", s(" | Site "), "site_id", s("</title>"),
        when(F.col("meta_description").isNotNull(), s('<meta name="description" content="'), F.replace("meta_description", F.lit('"'), F.lit("")), s('">')),
        when(pid % 5 == 0, s('<meta property="article:published_time" content="2023-05-0'), digit, s('T10:00:00Z">')),
        when(pid % 6 == 0, s('<meta property="og:title" content="x"><link rel="canonical" href="'), "url", s('">')),
        F.when(
            pid % 5 == 0,
            F.concat(
                s('<script type="application/ld+json">{"@type":"Article","headline":"h","datePublished":"2023-01-01","author":{"name":"A"},"dateModified":"2023-0'),
                digit, s('-11"}</script>'),
            ),
        ).when(pid % 5 == 1, s('<script type="application/ld+json">[{"@type":"FAQPage"},{"@type":["WebPage","Thing"]}]</script>')).otherwise(s("")),
        s('</head><body><nav><a href="/home">Home</a> <a href="/about">About</a></nav><article><h1>'), "title", s("</h1>"),
        when(pid % 4 == 0, s('<div class="post-author"><a href="/author/ann">Ann Lee</a>, editor</div>')),
        when(pid % 7 == 0, s('<time datetime="2023-06-15" class="entry-date">June 15</time><p>Updated on March 17, 2023</p>')),
        when(
            pid % 3 == 0,
            s("<ol><li>one</li><li>two</li><li>three</li><li>four</li></ol><table><tr><th>a</th><th>b</th></tr><tr><td>1</td></tr><tr><td>2</td></tr></table>"),
        ),
        when(pid % 2 == 0, s("<h3>What is this topic?</h3><p>This is the best way you can start and it will improve your results by 42% in one year of use.</p>")),
        when(pid % 4 == 1, s("<h2>FAQ</h2><h3>How long?</h3><h3>Why so?</h3><p>They are short.</p><h3>Who can use it?</h3><p>All.</p>")),
        F.repeat(F.concat(s('<a href="https://www.example.gov/study/'), txt(pid), s('">study</a> ')), (pid % 12).cast("int")),
        s('<a href="/p/'), txt(pid + 1), s('">next</a> <a href="next-'), txt(pid % 20), s('">more</a> <img src="a.png">'),
        s("<h4>Ann Lee</h4><h2>Share</h2>"), "body_html",
        s('</article><footer><a href="/contact">Contact</a></footer></body></html>'),
    )
    return p.withColumn("body_html", html)




@query("b1_title", f"""
SELECT page_id AS id, coalesce(nullif({q.inner("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, ''), nullif({q.inner("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}, ''), url) AS title FROM pages
""")
def b1(t: Tables):
    return t.pages.select(F.col("page_id").alias("id"), hx.title(F.col("html"), F.col("url")).alias("title"))


@query("b2_meta_description", f"""
SELECT post_id, nullif({q.squeeze("regexp_replace(" + q.unescape("regexp_extract(body_html, '(?is)<meta[^>]*name=.description. content=.([^\"]*)\"', 1)") + ", '<[^>]+>', '', 'g')")}, '') AS meta FROM articles
""", "articles")
def b2(t: Tables):
    return articles(t).select("post_id", hx.meta_description(F.col("body_html")).alias("meta"))


@query("b3_headings", f"""
SELECT post_id, h.level AS level, h.text AS text, pos::INTEGER AS pos FROM (
  SELECT post_id, unnest(hs) AS h, unnest(range(len(hs))) AS pos FROM (
    SELECT post_id, list_filter(list_transform(regexp_extract_all(body_html, '(?is)<h[1-6](?:\\s[^>]*)?>.*?</h[1-6]>'),
      lambda x: {{'level': lower(regexp_extract(x, '(?i)^<(h[1-6])', 1)), 'text': {q.inner('x')}}}),
      lambda h: h.text <> '' AND NOT (h.level = 'h4' AND h.text = 'Ann Lee')) AS hs FROM articles))
""", "articles")
def b3(t: Tables):
    return articles(t).select("post_id", F.posexplode(hx.headings(F.col("body_html"))).alias("pos", "h")).select("post_id", "h.level", "h.text", "pos")


@query("b4_internal_links", """
SELECT post_id, unnest(['https://' || site_id || '.example.com/home', 'https://' || site_id || '.example.com/about', 'https://' || site_id || '.example.com/contact',
   'https://' || site_id || '.example.com/p/' || (post_id + 1), 'https://' || site_id || '.example.com/blog/next-' || (post_id % 20)]) AS target_url,
   unnest(['Home', 'About', 'Contact', 'next', 'more']) AS anchor_text FROM posts
UNION ALL SELECT post_id, 'https://' || site_id || '.example.com/author/ann', 'Ann Lee' FROM posts WHERE post_id % 4 = 0
""", "posts")
def b4(t: Tables):
    links = ex.internal_links(F.col("body_html"), F.col("url"), ux.netloc(F.col("url")))
    return articles(t).select("post_id", F.inline(links))


@query("b5_canonical", """
SELECT post_id, CASE WHEN post_id % 6 = 0 AND post_id % 2 = 0 THEN url ELSE url || '?x=1' END AS canonical FROM posts
""", "posts")
def b5(t: Tables):
    seen = F.concat("url", F.lit("?x=1"))
    return articles(t).select("post_id", ex.canonical_url(F.col("body_html"), seen, ux.netloc(F.col("url"))).alias("canonical"))


@query("b6_dates", """
SELECT post_id, CASE WHEN post_id % 5 = 0 THEN '2023-05-0' || (post_id % 9 + 1) || ' 10:00' WHEN post_id % 7 = 0 THEN '2023-06-15 00:00' END AS published,
  CAST(NULL AS VARCHAR) AS modified FROM posts
""", "posts")
def b6(t: Tables):
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return articles(t).select("post_id", stamp(ex.publish_date(F.col("body_html"))).alias("published"), stamp(ex.modified_date(F.col("body_html"))).alias("modified"))


@query("b7_body_freshness", """
SELECT post_id, CASE WHEN post_id % 7 = 0 THEN DATE '2023-03-17' WHEN post_id % 5 = 0 THEN CAST('2023-0' || (post_id % 9 + 1) || '-11' AS DATE) END AS found FROM posts
""", "posts")
def b7(t: Tables):
    return articles(t).select("post_id", ex.freshness_from_body(F.col("body_html"), AS_OF).alias("found"))


@query("b8_language", "SELECT post_id, lower(language) AS lang FROM posts", "posts")
def b8(t: Tables):
    return articles(t).select("post_id", ex.language(F.col("body_html")).alias("lang"))


@query("b9_page_type", f"""
SELECT page_id AS id, CASE
  WHEN regexp_matches(lower({q.path('url')}), '/product/|/products/|/shop/|/store/|/p/|/item/') THEN 'product'
  WHEN regexp_matches(lower({q.path('url')}), '/docs/|/doc/|/api/|/reference/|/changelog/|/sdk/|/guide/') THEN 'documentation'
  WHEN regexp_matches(lower(html), 'class="price"|class="product-price"|add-to-cart|add to cart|buy now|itemprop="price"') THEN 'product'
  WHEN {q.n('lower(html)', '<pre|<code')} >= 3 THEN 'documentation'
  WHEN {q.n('html', '(?is)<h[1-6][ >]')} = 1 AND {q.n('lower(html)', '<a ')} > 20 AND length(html) < 5000 THEN 'index'
  WHEN trim({q.path('url')}, '/') IN ('', 'about', 'contact', 'team', 'careers', 'privacy', 'terms') THEN 'landing'
  ELSE 'blog' END AS kind FROM pages
UNION ALL SELECT -1 - post_id, 'blog' FROM posts
""", "posts")
def b9(t: Tables):
    kind = lambda u, h: ex.page_type(u, h, hx.headings(h)).alias("kind")
    a = t.pages.select(F.col("page_id").alias("id"), kind(F.col("url"), F.col("html")))
    return a.unionByName(articles(t).select((-1 - F.col("post_id")).alias("id"), kind(F.col("url"), F.col("body_html"))))


MON = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z.]*"
cte("trust", f"""
SELECT post_id, CASE WHEN post_id % 4 = 0 THEN 'Ann Lee' END AS author_name,
  CASE WHEN post_id % 5 = 0 THEN ['Article'] WHEN post_id % 5 = 1 THEN ['FAQPage','WebPage','Thing'] ELSE [] END AS schema_types,
  post_id % 5 = 0 AS has_author_schema,
  post_id % 7 = 0 OR post_id % 5 = 0 OR regexp_matches(left({q.visible('body_html')}, 3000), '(?i)(?:{MON}\\s+\\d{{1,2}},?\\s+\\d{{4}})|(?:published|posted|updated|modified)\\s*[:\\s]*\\d') AS has_visible_date,
  true AS has_contact_link, CAST(post_id % 12 AS INTEGER) AS credible_link_count,
  post_id % 6 = 0 AS has_og_tags, post_id % 6 = 0 AS has_canonical, post_id % 5 < 2 AS has_jsonld
FROM articles
""", "articles")


@query("b10_trust_metadata", "SELECT * REPLACE (array_to_string(schema_types, ',') AS schema_types) FROM trust", "trust")
def b10(t: Tables):
    return articles(t).select("post_id", ex.trust_metadata(F.col("body_html")).alias("m")).select("post_id", "m.*").withColumn(
        "schema_types", F.array_join("schema_types", ",")
    )


@query("b11_content_gate", f"""
SELECT coalesce(CASE WHEN coalesce(text, '') = '' THEN 'body_text_empty'
  WHEN length({q.strip('text')}) < 50 THEN 'body_text_too_short (' || length({q.strip('text')}) || ' chars)'
  WHEN {q.words('text')} < 100 THEN 'too_few_words (' || {q.words('text')} || ' words)' END, 'kept') AS reason, count(*) AS n
FROM documents GROUP BY 1
""")
def b11(t: Tables):
    return t.raw("documents").groupBy(F.coalesce(ex.skip_reason(F.col("text")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("b12_hash_words", f"SELECT doc_id, {q.words('text')}::INTEGER AS words, sha256({q.squeeze('text')}) AS hash FROM documents")
def b12(t: Tables):
    return t.raw("documents").select("doc_id", tx.word_count(F.col("text")).alias("words"), tx.content_hash(F.col("text")).alias("hash"))


@query("b13_normalize_url", f"SELECT page_id, {q.normalize('url')} AS url FROM pages")
def b13(t: Tables):
    return t.pages.select("page_id", ux.normalize_url(F.col("url")).alias("url"))


@query("b14_dedup_urls", f"""
SELECT min(event_id) AS event_id, 'https://site.example.com/' || k AS url FROM ev GROUP BY k
""", "ev")
def b14(t: Tables):
    u = F.concat(
        F.when(F.col("event_type") == "view", "http://www.Site.example.com/").otherwise("https://site.example.com:443/"),
        F.col("k").cast("string"), F.when(F.col("event_type") == "click", "/#x").otherwise("?utm_source=feed"),
    )
    return ex.dedup_urls(t.events.select("event_id", u.alias("url")), "event_id")


@query("b15_site_name_strip", f"""
SELECT post_id, {q.strip("regexp_split_to_array(title || ' | Site ' || site_id, '\\s+[|–—]\\s+|\\s+-\\s+')[1]")} AS title FROM posts
""", "posts")
def b15(t: Tables):
    return t.posts.select("post_id", tx.strip(ex.strip_site_name(F.concat("title", F.lit(" | Site "), "site_id"))).alias("title"))


def _article_links(t: Tables):
    a = articles(t).select("post_id", F.col("site_id").alias("site"), F.inline(ex.internal_links(F.col("body_html"), F.col("url"), ux.netloc(F.col("url")))))
    return a, t.posts.select("post_id", F.col("site_id").alias("site"))


ART_LINKS = """
SELECT post_id, site_id, unnest(['https://' || site_id || '.example.com/home', 'https://' || site_id || '.example.com/about', 'https://' || site_id || '.example.com/contact',
   'https://' || site_id || '.example.com/p/' || (post_id + 1), 'https://' || site_id || '.example.com/blog/next-' || (post_id % 20)]) AS target_url FROM posts
UNION ALL SELECT post_id, site_id, 'https://' || site_id || '.example.com/author/ann' FROM posts WHERE post_id % 4 = 0
"""


@query("b16_nav_links", f"""
WITH l AS ({ART_LINKS}), tot AS (SELECT site_id, count(*) AS n FROM posts GROUP BY 1),
nav AS (SELECT site_id, target_url FROM l JOIN tot USING (site_id) WHERE n >= 3 GROUP BY site_id, target_url, n HAVING count(DISTINCT post_id) >= 0.8 * n)
SELECT post_id, target_url FROM l WHERE NOT EXISTS (SELECT 1 FROM nav WHERE nav.site_id = l.site_id AND nav.target_url = l.target_url)
""", "posts")
def b16(t: Tables):
    links, posts = _article_links(t)
    return ex.filter_nav_links(links, posts).select("post_id", "target_url")


@query("b17_sitewide_headings", f"""
WITH hs AS (SELECT post_id, site_id, unnest(headings) AS h FROM (SELECT post_id, site_id, list_append(headings, {{'level': 'h2', 'text': 'Share'}}) AS headings FROM posts)),
tot AS (SELECT site_id, count(*) AS n FROM posts GROUP BY 1),
chrome AS (SELECT site_id, lower(h.text) AS txt FROM hs JOIN tot USING (site_id) WHERE n >= 3 AND h.text <> '' GROUP BY site_id, lower(h.text), n HAVING count(DISTINCT post_id) >= 0.9 * n)
SELECT post_id, count(*) FILTER (NOT EXISTS (SELECT 1 FROM chrome c WHERE c.site_id = hs.site_id AND c.txt = lower(h.text)))::INTEGER AS kept FROM hs GROUP BY post_id
""", "posts")
def b17(t: Tables):
    share = F.array(F.struct(F.lit("h2").alias("level"), F.lit("Share").alias("text")))
    p = t.posts.select("post_id", F.col("site_id").alias("site"), F.concat("headings", share).alias("headings"))
    return ex.filter_sitewide_headings(p).select("post_id", F.size("headings").alias("kept"))


@query("b18_link_targets", f"""
WITH l AS (SELECT post_id, site_id, unnest([url || '/?utm_source=a', 'https://' || site_id || '.example.com/none']) AS target_url FROM posts),
tg AS (SELECT site_id, {q.normalize('url')} AS u, min(post_id) AS target_post_id FROM posts GROUP BY 1, 2)
SELECT post_id, target_url, target_post_id FROM l LEFT JOIN tg ON tg.site_id = l.site_id AND tg.u = {q.normalize('target_url')}
""", "posts")
def b18(t: Tables):
    links = t.posts.select(
        "post_id", F.col("site_id").alias("site"),
        F.explode(F.array(F.concat("url", F.lit("/?utm_source=a")), F.concat(F.lit("https://"), "site_id", F.lit(".example.com/none")))).alias("target_url"),
    )
    posts = t.posts.select("post_id", F.col("site_id").alias("site"), ux.normalize_url(F.col("url")).alias("url"))
    return ex.resolve_link_targets(links, posts).select("post_id", "target_url", "target_post_id")


@query("b19_heading_counts", f"""
SELECT post_id, 1 AS h1_count, {q.n('body_html', '<h2[ >]')}::INTEGER AS h2_count, {q.n('body_html', '<h3[ >]')}::INTEGER AS h3_count, {q.n('body_html', '(?i)<img[\\s>]')}::INTEGER AS image_count
FROM articles WHERE trim(title) <> ''
UNION ALL SELECT post_id, 0, {q.n('body_html', '<h2[ >]')}::INTEGER, {q.n('body_html', '<h3[ >]')}::INTEGER, {q.n('body_html', '(?i)<img[\\s>]')}::INTEGER FROM articles WHERE trim(title) = ''
""", "articles")
def b19(t: Tables):
    return articles(t).select("post_id", *ex.heading_counts(hx.headings(F.col("body_html")), F.col("body_html")))


def _flat(x):
    return q.squeeze(f"regexp_replace({x}, '<[^>]+>', ' ', 'g')")


@query("b20_section_chunks", f"""
WITH c AS (SELECT post_id, title, regexp_replace(regexp_replace(body_html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g') AS clean FROM articles),
s AS (SELECT post_id, title, {_flat('clean')} AS full_text, string_split(regexp_replace(clean, '(?is)<h[23][^>]*>(.*?)</h[23]>', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS parts FROM c),
k AS (SELECT *, {_flat('parts[1]')} AS intro, list_filter(list_transform(parts[2:], lambda x: {{'h': {q.strip("regexp_replace(string_split(x, chr(2))[1], '<[^>]+>', '', 'g')")}, 'b': {_flat("replace(x, chr(2), ' ')")}}}), lambda r: length(r.b) > 80) AS secs FROM s),
o AS (SELECT post_id, CASE WHEN len(parts) = 1 OR ({q.words('full_text')} < 300 AND len(parts) - 1 > 5) THEN [title || ': ' || left(full_text, 800)]
  ELSE list_concat(CASE WHEN length(intro) > 100 THEN [title || ' [intro]: ' || left(intro, 600)] ELSE [] END, list_transform(secs, lambda r: r.h || ': ' || left(r.b, 700))) END AS chunks, title FROM k)
SELECT post_id, unnest(CASE WHEN len(chunks) = 0 THEN [title] ELSE chunks END) AS chunk FROM o
""", "articles")
def b20(t: Tables):
    return articles(t).select("post_id", F.explode(ex.section_chunks(F.col("body_html"), F.col("title"))).alias("chunk"))


@query("b21_overlap_chunks", f"""
WITH b AS (SELECT post_id, CASE WHEN title <> '' THEN title || chr(10) || chr(10) ELSE '' END AS pre, CASE WHEN title <> '' THEN title || chr(10) || chr(10) ELSE '' END || body_text AS t FROM posts),
m AS (SELECT post_id, pre, t, 2000 - length(pre) AS w FROM b),
x AS (SELECT post_id, 0 AS i, CASE WHEN length(t) <= 2000 THEN {q.strip('t')} ELSE {q.strip('left(t, 2000)')} END AS chunk FROM m
UNION ALL SELECT post_id, i + 1, CASE WHEN length({q.strip('substring(t, (1800 + i * (w - 200) + 1)::BIGINT, w)')}) >= 200 THEN {q.strip('pre || substring(t, (1800 + i * (w - 200) + 1)::BIGINT, w)')} END
FROM (SELECT *, unnest(range(CAST(ceil((length(t) - 1800) / (w - 200)) AS BIGINT))) AS i FROM m WHERE length(t) > 2000))
SELECT post_id, i::INTEGER AS i, chunk FROM x a WHERE NOT EXISTS (SELECT 1 FROM x b WHERE b.post_id = a.post_id AND b.chunk IS NULL AND b.i <= a.i)
""", "posts")
def b21(t: Tables):
    return ex.overlap_chunks(t.posts, "post_id", 2000, 200)


@query("b22_mean_vectors", """
SELECT cluster_id AS post_id, pos::INTEGER AS pos, round(avg(v), 6) AS mean FROM (SELECT cluster_id, unnest(vec) AS v, unnest(range(len(vec))) AS pos FROM emb) GROUP BY 1, 2
""", "emb")
def b22(t: Tables):
    m = cl.mean_vectors(t.embeddings.select(F.col("cluster_id").alias("post_id"), "vec"), ["post_id"])
    return m.select("post_id", F.posexplode("vec").alias("pos", "mean")).withColumn("mean", F.round("mean", 6))


@query("b23_smart_truncate", r"""
WITH p AS (SELECT post_id, body_text AS t, headings, length(body_text) AS n,
  list_filter(regexp_split_to_array(CASE WHEN length(body_text) > 800 THEN substring(body_text, 501, length(body_text) - 800) ELSE '' END, '[.!?]\s+'), lambda s: regexp_matches(s, '\d+%|\$\d|increase|decrease|improve|reduce')) AS st FROM posts)
SELECT post_id, CASE WHEN n <= 1500 THEN t ELSE left(array_to_string(list_concat([left(t, 500)], list_transform(headings[1:15], lambda h: chr(10) || '[' || h.level || '] ' || h.text),
  list_transform(st[1:5], lambda s: left(regexp_replace(s, '^\s+|\s+$', '', 'g'), 150)), [chr(10) || '...' || right(t, 300)]), chr(10)), 1500) END AS short FROM p
""", "posts")
def b23(t: Tables):
    return t.posts.select("post_id", ex.smart_truncate(F.col("body_text"), F.col("headings"), 1500).alias("short"))


@query("b24_excerpt", f"""
WITH p AS (SELECT post_id, {q.strip('body_text')} AS t FROM posts)
SELECT post_id, CASE WHEN length(t) <= 800 THEN t ELSE regexp_replace(left(t, 400), '\\s+$', '') || chr(10) || '[...]' || chr(10) || regexp_replace(right(t, 400), '^\\s+', '') END AS excerpt FROM p
""", "posts")
def b24(t: Tables):
    return t.posts.select("post_id", ex.smart_excerpt(F.col("body_text")).alias("excerpt"))
