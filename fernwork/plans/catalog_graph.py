"""Checks of the link graph operators (group D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from .oracle import cte, query
from .tables import Tables, at_site

cte("nodes", "SELECT DISTINCT source_post_id AS id FROM links UNION SELECT target_post_id FROM links WHERE target_post_id IS NOT NULL UNION SELECT post_id FROM post_clusters", "links post_clusters")


def nodes(t: Tables):
    return (
        t.links.select(F.col("source_post_id").alias("post_id"))
        .unionByName(t.links.filter(F.col("target_post_id").isNotNull()).select(F.col("target_post_id").alias("post_id")))
        .unionByName(t.post_clusters.select("post_id")).distinct()
    )


def site_nodes(t: Tables):
    return nodes(t).select(F.lit("s").alias("site_id"), F.col("post_id").alias("id"))


PR = """
WITH RECURSIVE sz AS (SELECT count(*) AS n FROM nodes),
ed AS (SELECT DISTINCT source_post_id AS src, target_post_id AS dst FROM links WHERE target_post_id IS NOT NULL),
dg AS (SELECT src, count(*) AS d FROM ed GROUP BY src),
pr(it, id, rank, err) AS (
  SELECT 0, id, 1.0::DOUBLE / n, 1e9::DOUBLE FROM nodes, sz
  UNION ALL
  SELECT it, id, rank, sum(abs(rank - old)) OVER () FROM (
    SELECT p.it + 1 AS it, p.id, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(c.s, 0) + coalesce(l.s, 0) / n) AS rank, p.rank AS old
    FROM pr p CROSS JOIN sz
    LEFT JOIN (SELECT dst, sum(q.rank / d) AS s FROM pr q JOIN ed ON ed.src = q.id JOIN dg ON dg.src = q.id GROUP BY dst) c ON c.dst = p.id
    CROSS JOIN (SELECT sum(q.rank) AS s FROM pr q WHERE q.id NOT IN (SELECT src FROM dg)) l
    WHERE p.it < 100 AND p.err >= n * 1e-6))
"""


@query("d1_pagerank", PR + "SELECT id, round(rank, 7) AS pagerank FROM pr WHERE it = (SELECT max(it) FROM pr)", "nodes links")
def d1(t: Tables):
    edges = t.links.filter(F.col("target_post_id").isNotNull()).select(
        F.lit("s").alias("site_id"), F.col("source_post_id").alias("src"), F.col("target_post_id").alias("dst")
    )
    return g.pagerank(site_nodes(t), edges).select("id", F.round("pagerank", 7).alias("pagerank"))


@query("d2_pagerank_fallback", PR + """
SELECT 'linked' AS site_id, id, round(rank, 7) AS pagerank FROM pr WHERE it = (SELECT max(it) FROM pr)
UNION ALL SELECT 'sparse', id, round(1.0::DOUBLE / n, 7) FROM nodes, sz
""", "nodes links")
def d2(t: Tables):
    """The same links twice: once as they are, once with every target lost but the self-evident few."""
    good = t.links.withColumn("site_id", F.lit("linked"))
    poor = t.links.withColumn("site_id", F.lit("sparse")).withColumn("target_post_id", F.lit(None).cast("long"))
    both = nodes(t).select(F.explode(F.array(F.lit("linked"), F.lit("sparse"))).alias("site_id"), F.col("post_id").alias("id"))
    return g.site_pagerank(both, good.unionByName(poor)).withColumn("pagerank", F.round("pagerank", 7))


@query("d3_link_resolution", """
SELECT source_post_id % 7 AS site_id, count(*) AS total_links, count(target_post_id) AS resolved_links, round(count(target_post_id) / count(*), 6) AS resolution_rate,
  count(target_post_id) / count(*) >= 0.2 AS reliable FROM links GROUP BY 1
""", "links")
def d3(t: Tables):
    return g.resolution(t.links.withColumn("site_id", F.col("source_post_id") % 7), ["site_id"]).withColumn("resolution_rate", F.round("resolution_rate", 6))


@query("d4_broken_links", """
SELECT source_post_id, target_url FROM links WHERE contains(target_url, 'site.example.com')
  AND target_url NOT IN (SELECT 'https://site.example.com/p/' || s_suppkey FROM supplier)
""", "links")
def d4(t: Tables):
    posts = t.raw("supplier").select(F.concat(F.lit("https://site.example.com/p/"), F.col("s_suppkey").cast("string")).alias("url"))
    return g.broken_links(t.links, posts, "site.example.com").select("source_post_id", "target_url")


@query("d5_outbound_counts", "SELECT source_post_id AS post_id, count(*) AS external_links FROM links WHERE NOT contains(target_url, 'site.example.com') GROUP BY 1", "links")
def d5(t: Tables):
    return g.outbound_counts(t.links, "site.example.com")


# links between five sites: a post's site is its id by five, a third of the resolved links leave it
cte("site_links", """
SELECT 'site' || source_post_id % 5 AS site_id, source_post_id, target_post_id,
  'https://site' || CASE WHEN target_post_id % 3 = 0 THEN target_post_id % 5 ELSE source_post_id % 5 END || '.example.com/p/' || target_post_id AS target_url
FROM links WHERE target_post_id IS NOT NULL
""", "links")
# a site knows its posts whose id isn't a multiple of four
SITE_POSTS = "SELECT 'site' || s % 5 AS site_id, 'https://site' || s % 5 || '.example.com/p/' || s_suppkey AS url FROM supplier, range(5) r(s) WHERE s_suppkey % 4 > 0"


def site_links(t: Tables):
    source, target = F.col("source_post_id"), F.col("target_post_id")
    site = lambda n: F.concat(F.lit("site"), (n % 5).cast("string"))
    host = F.when(target % 3 == 0, site(target)).otherwise(site(source))
    return t.links.filter(target.isNotNull()).select(
        site(source).alias("site_id"), "source_post_id", "target_post_id", F.concat(F.lit("https://"), host, F.lit(".example.com/p/"), target.cast("string")).alias("target_url")
    )


@query("d4_broken_links_by_site", f"""
SELECT site_id, source_post_id, target_url FROM site_links l WHERE contains(target_url, site_id || '.example.com')
  AND NOT EXISTS (SELECT 1 FROM ({SITE_POSTS}) p WHERE p.site_id = l.site_id AND p.url = l.target_url)
""", "site_links")
def d4_by_site(t: Tables):
    ids = t.raw("supplier").filter("s_suppkey % 4 > 0").select(F.explode(F.sequence(F.lit(0), F.lit(4))).alias("s"), "s_suppkey")
    posts = ids.select(F.concat(F.lit("site"), "s").alias("site_id"), F.concat(F.lit("https://site"), "s", F.lit(".example.com/p/"), "s_suppkey").alias("url"))
    own = F.concat("site_id", F.lit(".example.com"))
    return g.broken_links(site_links(t), posts, own, ["site_id"]).select("site_id", "source_post_id", "target_url")


@query("d5_outbound_by_site", "SELECT source_post_id AS post_id, count(*) AS external_links FROM site_links WHERE NOT contains(target_url, site_id || '.example.com') GROUP BY 1", "site_links")
def d5_by_site(t: Tables):
    return g.outbound_counts(site_links(t), F.concat("site_id", F.lit(".example.com")))


@query("d6_link_counts", """
SELECT n.id AS post_id, (SELECT count(*) FROM links l WHERE l.target_post_id = n.id) AS inbound, (SELECT count(*) FROM links l WHERE l.source_post_id = n.id) AS outbound FROM nodes n
""", "nodes links")
def d6(t: Tables):
    return g.link_counts(nodes(t), t.links)


@query("d7_inbound_stats", """
WITH p AS (SELECT source_post_id % 5 AS site_id, target_post_id AS post_id, count(*) AS n FROM links WHERE target_post_id IS NOT NULL GROUP BY 1, 2),
m AS (SELECT site_id, title, sum(n)::BIGINT AS n FROM p JOIN (SELECT post_id, title FROM posts) USING (post_id) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY sum(n) DESC, title) = 1),
a AS (SELECT site_id, round(avg(n), 1) AS avg_in, max(n) AS max_in FROM p GROUP BY 1)
SELECT site_id, avg_in, max_in, title AS most_linked, n AS most_linked_count FROM a LEFT JOIN m USING (site_id)
""", "links posts")
def d7(t: Tables):
    return g.inbound_stats(at_site(t.links, "source_post_id"), t.posts)


FLOWS = """
WITH f AS (SELECT least(a.cluster_id, b.cluster_id) AS from_cluster, greatest(a.cluster_id, b.cluster_id) AS to_cluster,
  count(*) FILTER (a.cluster_id < b.cluster_id) AS forward_links, count(*) FILTER (a.cluster_id > b.cluster_id) AS backward_links
  FROM links JOIN post_clusters a ON a.post_id = source_post_id JOIN post_clusters b ON b.post_id = target_post_id WHERE a.cluster_id <> b.cluster_id GROUP BY 1, 2)
"""


@query("d8_cluster_flows", FLOWS + """
SELECT *, forward_links + backward_links AS total_links, round_even(least(forward_links, backward_links) / greatest(forward_links, backward_links, 1), 2) AS bidirectional_ratio,
  round_even(least((forward_links + backward_links) / 3.0::DOUBLE, 5.0::DOUBLE), 2) AS width FROM f
""", "links post_clusters")
def d8(t: Tables):
    return g.cluster_flows(t.links, t.post_clusters)


@query("d9_flow_quality", FLOWS + """
, e AS (SELECT cluster_id, greatest(0, least(1, avg(composite_score) / 100)) AS e FROM scores GROUP BY 1)
SELECT from_cluster, to_cluster, CASE WHEN (a.e + b.e) / 2 > 0.7 THEN 'sparkling' WHEN (a.e + b.e) / 2 > 0.4 THEN 'clear' WHEN (a.e + b.e) / 2 > 0.2 THEN 'murky' ELSE 'toxic' END AS quality
FROM f JOIN e a ON a.cluster_id = from_cluster JOIN e b ON b.cluster_id = to_cluster
""", "links post_clusters scores")
def d9(t: Tables):
    return g.flow_quality(g.cluster_flows(t.links, t.post_clusters), t.scores).select("from_cluster", "to_cluster", "quality")


@query("d10_orphan_suggestions", """
WITH o AS (SELECT * FROM emb WHERE post_id NOT IN (SELECT target_post_id FROM links WHERE target_post_id IS NOT NULL)),
s AS (SELECT * FROM emb WHERE post_id IN (SELECT source_post_id FROM links)),
p AS (SELECT o.post_id, s.post_id AS neighbour_id, list_cosine_similarity(o.vec, s.vec) AS similarity FROM o, s WHERE o.post_id <> s.post_id AND o.post_id % 5 = s.post_id % 5),
r AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY similarity DESC, neighbour_id) AS rank FROM p WHERE similarity >= 0.35),
few AS (SELECT o.post_id % 5 AS s FROM o LEFT JOIN (SELECT DISTINCT post_id FROM r) f ON f.post_id = o.post_id GROUP BY 1 HAVING count(f.post_id) < count(*) * 0.2)
SELECT post_id % 5 AS site_id, post_id, neighbour_id, round(similarity, 6) AS similarity, rank::INTEGER AS rank FROM r WHERE rank <= 5 AND post_id % 5 NOT IN (FROM few)
UNION ALL SELECT post_id % 5, min(post_id), NULL, NULL, 0 FROM o WHERE post_id % 5 IN (FROM few) GROUP BY 1
""", "emb links")
def d10(t: Tables):
    return g.orphan_suggestions(at_site(t.embeddings).select("site_id", "post_id", "vec"), t.links, floor=0.35).withColumn("similarity", F.round("similarity", 6))


@query("d11_link_breakdown", """
WITH l AS (SELECT source_post_id % 5 AS site_id, count(*) AS total, count(target_post_id) AS resolved, count(*) FILTER (target_post_id IS NULL AND NOT contains(target_url, '/gone/')) AS non_blog,
  count(*) FILTER (target_post_id IS NULL AND contains(target_url, '/gone/')) AS unresolved_blog FROM links GROUP BY 1),
o AS (SELECT id % 5 AS site_id, count(*) AS orphans FROM nodes WHERE id NOT IN (SELECT target_post_id FROM links WHERE target_post_id IS NOT NULL) GROUP BY 1)
SELECT site_id, total, resolved, non_blog, unresolved_blog, coalesce(orphans, 0) AS orphans FROM l LEFT JOIN o USING (site_id)
""", "links nodes")
def d11(t: Tables):
    return g.link_breakdown(at_site(t.links, "source_post_id"), at_site(nodes(t)), "/gone/")
