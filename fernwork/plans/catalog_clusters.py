"""Checks of the vector, cluster and label operators (group E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters as cl
from ..operators import density as dn
from ..operators import labels as lb
from ..operators import layout as lay
from ..operators import vectors as vx
from . import sqltext as q
from .oracle import cte, query
from .tables import Tables, at_site

R6 = lambda c: F.round(c, 6).alias(c)


@query("e1_pair_cosine", """
SELECT post_a_id, post_b_id, round(list_cosine_similarity(a.vec, b.vec), 6) AS cosine FROM pairs JOIN emb a ON a.post_id = post_a_id JOIN emb b ON b.post_id = post_b_id
""", "pairs emb")
def e1(t: Tables):
    return vx.pair_cosine(t.pairs.select("post_a_id", "post_b_id"), t.embeddings).select("post_a_id", "post_b_id", R6("cosine"))


cte("sims", "SELECT a.post_id AS a, b.post_id AS b, a.cluster_id AS ca, b.cluster_id AS cb, list_cosine_similarity(a.vec, b.vec) AS sim FROM emb a, emb b WHERE a.post_id <> b.post_id", "emb")


@query("e2_top_neighbours", """
SELECT a AS post_id, b AS neighbour_id, round(sim, 6) AS similarity, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM sims) WHERE rank <= 5
""", "sims")
def e2(t: Tables):
    return vx.top_neighbours(t.embeddings, 5).withColumn("similarity", F.round("similarity", 6))


@query("e2_top_neighbours_in_cluster", """
SELECT a AS post_id, b AS neighbour_id, ca AS cluster_id, round(sim, 6) AS similarity, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM sims WHERE ca = cb) WHERE rank <= 10
""", "sims")
def e2b(t: Tables):
    return vx.top_neighbours(t.embeddings, 10, ["cluster_id"], block=16).withColumns(
        {"similarity": F.round("similarity", 6), "cluster_id": F.col("cluster_id").cast("int")}
    )


def query_vector(t: Tables) -> list[float]:
    """The draft's vector: one row of the given table."""
    return t.embeddings.filter("post_id = 0").select("vec").first()[0]


@query("e3_nearest_to_vector", """
SELECT e.post_id, composite_score, role, round(list_cosine_similarity(e.vec, (SELECT vec FROM emb WHERE post_id = 0)), 6) AS similarity
FROM emb e JOIN scores USING (post_id) ORDER BY list_cosine_similarity(e.vec, (SELECT vec FROM emb WHERE post_id = 0)) DESC, e.post_id LIMIT 10
""", "emb scores")
def e3(t: Tables):
    near = vx.nearest_to(t.embeddings.select("post_id", "vec"), query_vector(t), 10)
    return near.join(t.scores.select("post_id", "composite_score", "role"), "post_id").withColumn("similarity", F.round("similarity", 6))


@query("e4_centre_vectors", """
WITH x AS (SELECT post_id, cluster_id, unnest(vec) AS v, unnest(range(len(vec))) AS pos FROM emb), m AS (SELECT cluster_id, pos, avg(v) AS m FROM x GROUP BY 1, 2),
d AS (SELECT post_id, pos, v - m AS d FROM x JOIN m USING (cluster_id, pos)), n AS (SELECT post_id, sqrt(sum(d * d)) AS n FROM d GROUP BY 1)
SELECT post_id, pos::INTEGER AS pos, round(d / greatest(n, 1e-10), 6) AS v FROM d JOIN n USING (post_id)
""", "emb")
def e4(t: Tables):
    return cl.centre_vectors(t.embeddings, ["cluster_id"]).select("post_id", F.posexplode("vec").alias("pos", "v")).withColumn("v", F.round("v", 6))


@query("e5_mean_similarity", """
SELECT a.post_id % 5 AS site_id, count(DISTINCT a.post_id) AS n, round(sum(CASE WHEN a.post_id = b.post_id THEN 0 ELSE list_cosine_similarity(a.vec, b.vec) END) / count(*), 6) AS mean_similarity FROM emb a JOIN emb b ON a.post_id % 5 = b.post_id % 5 GROUP BY 1
""", "emb")
def e5(t: Tables):
    return cl.mean_similarity(at_site(t.embeddings).select("site_id", "post_id", "vec")).withColumn("mean_similarity", F.round("mean_similarity", 6))


@query("e6_topic_clusters")
def e6(t: Tables):
    return cl.topic_clusters(at_site(t.embeddings)).select("site_id", "post_id", "cluster_id")


@query("e6_density_forest", """
WITH RECURSIVE x AS (SELECT post_id, site_id, unnest(vec) AS v, unnest(range(len(vec))) AS pos FROM semb), m AS (SELECT site_id, pos, avg(v) AS m FROM x GROUP BY 1, 2),
c AS (SELECT site_id, post_id, list(v - m ORDER BY pos) AS vec FROM x JOIN m USING (site_id, pos) GROUP BY 1, 2), s AS (SELECT site_id, count(*) AS n FROM semb GROUP BY 1),
d AS (SELECT a.site_id, a.post_id AS a, b.post_id AS b, sqrt(greatest(0, 2 - 2 * round(list_cosine_similarity(a.vec, b.vec), 12))) AS d FROM c a JOIN c b ON a.site_id = b.site_id AND a.post_id <> b.post_id),
k AS (SELECT site_id, a, max(d) AS core FROM (SELECT *, row_number() OVER (PARTITION BY site_id, a ORDER BY d) AS r FROM d) JOIN s USING (site_id) WHERE r <= CASE WHEN n < 20 THEN 1 WHEN n < 100 THEN 2 WHEN n < 1000 THEN 3 ELSE 5 END GROUP BY 1, 2),
r AS MATERIALIZED (SELECT d.site_id, d.a, d.b, greatest(d, ka.core, kb.core) AS w FROM d JOIN k ka ON ka.site_id = d.site_id AND ka.a = d.a JOIN k kb ON kb.site_id = d.site_id AND kb.a = d.b),
p AS (
  SELECT site_id, 0 AS step, [min(a)] AS done, 0.0::DOUBLE AS total FROM r GROUP BY site_id
  UNION ALL
  SELECT site_id, step + 1, list_append(done, b), total + w FROM (
    SELECT p.site_id, p.step, p.done, p.total, r.b, r.w, row_number() OVER (PARTITION BY p.site_id ORDER BY r.w, r.b) AS k
    FROM p JOIN r ON r.site_id = p.site_id WHERE list_contains(p.done, r.a) AND NOT list_contains(p.done, r.b)
  ) WHERE k = 1
)
SELECT site_id, max(step)::BIGINT AS n_edges, round(max(total), 6) AS weight FROM p GROUP BY 1
""", "semb")
def e6b(t: Tables):
    centred = cl.centre_vectors(at_site(t.embeddings).select("site_id", "post_id", "vec"), ["site_id"])
    edges = dn.forest(centred.select(F.col("site_id").cast("string").alias("grp"), "post_id", "vec"), cl.core_samples(F.col("n")))
    return edges.groupBy(F.col("grp").cast("bigint").alias("site_id")).agg(F.count("*").alias("n_edges"), F.round(F.sum("w"), 6).alias("weight"))


@query("e7_min_cluster_size", """
SELECT label, n, CASE WHEN n < 20 THEN greatest(2, n // 5) WHEN n < 100 THEN greatest(3, n // 10) WHEN n < 500 THEN greatest(5, n // 20) WHEN n < 1000 THEN 12 ELSE 20 END::INTEGER AS min_size
FROM (SELECT 'p' || (o_custkey % 400) AS label, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'c' || l_suppkey, count(*) FROM lineitem GROUP BY 1 UNION ALL SELECT o_orderpriority, count(*) FROM orders GROUP BY 1)
""")
def e7(t: Tables):
    o = t.raw("orders").groupBy(F.concat(F.lit("p"), (F.col("o_custkey") % 400).cast("string")).alias("label")).agg(F.count("*").alias("n"))
    c = t.raw("lineitem").groupBy(F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("label")).agg(F.count("*").alias("n"))
    p = t.raw("orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("n"))
    return o.unionByName(c).unionByName(p).withColumn("min_size", cl.min_cluster_size(F.col("n")))


cte("semb", "SELECT *, post_id % 5 AS site_id FROM emb", "emb")
cte("sil", """
WITH d AS (SELECT a.site_id, a.post_id AS a, a.cluster_id AS ca, b.cluster_id AS cb, list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dd FROM semb a JOIN semb b ON a.site_id = b.site_id),
m AS (SELECT site_id, a, ca, cb, sum(dd) / nullif(count(*) - CASE WHEN ca = cb THEN 1 ELSE 0 END, 0) AS md FROM d GROUP BY 1, 2, 3, 4)
SELECT site_id, a AS post_id, ca AS cluster_id, coalesce((min(md) FILTER (ca <> cb) - max(md) FILTER (ca = cb)) / nullif(greatest(min(md) FILTER (ca <> cb), max(md) FILTER (ca = cb)), 0), 0) AS s FROM m GROUP BY site_id, a, ca
""", "semb")


@query("e8_silhouette", """
SELECT site_id, cluster_id, round(avg(s), 6) AS silhouette, count(*) AS n FROM sil GROUP BY 1, 2 UNION ALL SELECT site_id, NULL, round(avg(s), 6), count(*) FROM sil GROUP BY 1
""", "sil")
def e8(t: Tables):
    return cl.cluster_silhouettes(at_site(t.embeddings), ["site_id"]).withColumn("silhouette", F.round("silhouette", 6)).select("site_id", "cluster_id", "silhouette", "n")


@query("e9_absorb_small", """
WITH c AS (SELECT site_id, cluster_id, count(*) AS n FROM semb GROUP BY 1, 2), k AS (SELECT e.* FROM semb e JOIN c USING (site_id, cluster_id) WHERE n >= 10),
x AS (SELECT site_id, cluster_id, unnest(vec) AS v, unnest(range(len(vec))) AS pos FROM k), m AS (SELECT site_id, cluster_id, list(m ORDER BY pos) AS cen FROM (SELECT site_id, cluster_id, pos, avg(v) AS m FROM x GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT site_id, post_id, cluster_id::BIGINT AS cluster_id FROM k
UNION ALL SELECT e.site_id, post_id, m.cluster_id::BIGINT FROM semb e JOIN c USING (site_id, cluster_id) JOIN m ON m.site_id = e.site_id WHERE n < 10 QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY list_distance(e.vec, m.cen), m.cluster_id) = 1
""", "semb")
def e9(t: Tables):
    return cl.absorb_small(at_site(t.embeddings), 10, ["site_id"]).select("site_id", "post_id", "cluster_id")


@query("e10_dissolve_negative", """
WITH s AS (SELECT site_id, cluster_id, avg(s) AS s FROM sil GROUP BY 1, 2), f AS (SELECT site_id, count(*) AS n, count(*) FILTER (s < 0) AS b FROM s GROUP BY 1),
k AS (SELECT e.* FROM semb e JOIN s USING (site_id, cluster_id) JOIN f USING (site_id) WHERE s.s >= 0 OR n < 3 OR b = n),
x AS (SELECT site_id, cluster_id, unnest(vec) AS v, unnest(range(len(vec))) AS pos FROM k), m AS (SELECT site_id, cluster_id, list(m ORDER BY pos) AS cen FROM (SELECT site_id, cluster_id, pos, avg(v) AS m FROM x GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT site_id, post_id, cluster_id::BIGINT AS cluster_id FROM k
UNION ALL SELECT e.site_id, post_id, m.cluster_id::BIGINT FROM semb e JOIN m ON m.site_id = e.site_id WHERE post_id NOT IN (SELECT post_id FROM k) QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY list_distance(e.vec, m.cen), m.cluster_id) = 1
""", "semb sil")
def e10(t: Tables):
    return cl.dissolve_negative(at_site(t.embeddings), ["site_id"]).select("site_id", "post_id", "cluster_id")


@query("e11_map_positions")
def e11(t: Tables):
    return lay.map_positions(at_site(t.embeddings))


@query("e11_draw_together", """
SELECT site_id, post_id, cluster_id, round(vec[1] + 0.15 * (avg(vec[1]) OVER c - vec[1]), 6) AS x, round(vec[2] + 0.15 * (avg(vec[2]) OVER c - vec[2]), 6) AS y
FROM semb WINDOW c AS (PARTITION BY site_id, cluster_id)
""", "semb")
def e11c(t: Tables):
    places = at_site(t.embeddings).select("site_id", "post_id", "cluster_id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))
    return lay.draw_together(places).select("site_id", "post_id", "cluster_id", R6("x"), R6("y"))


@query("e11_neighbour_graph", """
WITH n AS (SELECT a.site_id, a.post_id, b.post_id AS other, 1 - list_cosine_similarity(a.vec, b.vec) AS d FROM semb a JOIN semb b ON a.site_id = b.site_id AND a.post_id <> b.post_id
  QUALIFY row_number() OVER (PARTITION BY a.post_id ORDER BY list_cosine_similarity(a.vec, b.vec) DESC, b.post_id) <= 15),
w AS (SELECT site_id, post_id, other, exp(-(d - min(d) OVER p) / greatest(avg(d) OVER p - min(d) OVER p, 1e-6)) AS w FROM n WINDOW p AS (PARTITION BY post_id)),
u AS (SELECT * FROM w UNION ALL SELECT site_id, other, post_id, w FROM w)
SELECT site_id, post_id, other, round(CASE WHEN count(*) = 2 THEN sum(w) - min(w) * max(w) ELSE sum(w) END, 6) AS w FROM u GROUP BY 1, 2, 3
""", "semb")
def e11d(t: Tables):
    return lay.neighbour_graph(at_site(t.embeddings)).withColumn("w", F.round("w", 6))


@query("e11_circle_layout", """
SELECT n_nationkey AS id, round(cos(2 * pi() * n_nationkey / 25) * 2, 6) AS x, round(sin(2 * pi() * n_nationkey / 25) * 2, 6) AS y FROM nation
""")
def e11b(t: Tables):
    pos = t.raw("nation").select(F.col("n_nationkey").alias("id"), *cl.circle_layout(F.col("n_nationkey"), F.lit(25)))
    return pos.select("id", R6("x"), R6("y"))


@query("e12_split_large")
def e12(t: Tables):
    return cl.split_large(t.embeddings)


@query("e12_split_check", """
SELECT cluster_id, count(*) AS n, 0::BIGINT AS left_large FROM emb GROUP BY 1
""", "emb")
def e12b(t: Tables):
    """Every post keeps its cluster, and no leaf above the limit is left but those that rejected a split."""
    out = cl.split_large(t.embeddings)
    leaves = out.groupBy("cluster_id", "path", "rejected").agg(F.count("*").alias("m"))
    open_ = F.when(~F.col("rejected") & (F.col("m") > cl.MAX_CLUSTER), F.col("m")).otherwise(F.lit(0))
    return leaves.groupBy("cluster_id").agg(F.sum("m").alias("n"), F.sum(open_).alias("left_large"))


@query("e13_small_sites", """
WITH p AS (SELECT vec_id AS post_id, CASE WHEN vec_id % 50 = 0 THEN 'tiny' || (vec_id % 3) ELSE 'big' END AS site_id, label FROM embeddings), s AS (SELECT site_id, count(*) AS n FROM p GROUP BY 1)
SELECT post_id, site_id, CASE WHEN n < 15 THEN 0 ELSE label END AS cluster_id FROM p JOIN s USING (site_id)
""")
def e13(t: Tables):
    p = t.post_clusters.select("post_id", F.when(F.col("post_id") % 50 == 0, F.concat(F.lit("tiny"), (F.col("post_id") % 3).cast("string"))).otherwise("big").alias("site_id"))
    return cl.small_site_labels(p, t.post_clusters)


@query("e14_leaf_clusters", "SELECT cluster_id, post_count FROM clusters WHERE cluster_id NOT IN (SELECT parent_cluster_id FROM clusters WHERE parent_cluster_id IS NOT NULL)", "clusters")
def e14(t: Tables):
    return cl.leaf_clusters(t.clusters).select("cluster_id", "post_count")


@query("e15_cluster_centres", """
SELECT cluster_id, post_count, round(coalesce(avg(vec[1]), 0), 6) AS x, round(coalesce(avg(vec[2]), 0), 6) AS y FROM clusters LEFT JOIN emb USING (cluster_id) GROUP BY 1, 2
""", "clusters emb")
def e15(t: Tables):
    m = t.embeddings.select("cluster_id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))
    return cl.cluster_centres(t.clusters.select("cluster_id", "post_count"), m).select("cluster_id", "post_count", R6("x"), R6("y"))


cte("cents", "SELECT site_id, cluster_id, list(m ORDER BY pos) AS cen FROM (SELECT site_id, cluster_id, pos, avg(v) AS m FROM (SELECT site_id, cluster_id, unnest(vec) AS v, unnest(range(len(vec))) AS pos FROM semb) GROUP BY 1, 2, 3) GROUP BY 1, 2", "semb")


@query("e16_centroid_nearest", """
SELECT c.site_id, c.cluster_id::BIGINT AS cluster_id, e.post_id, round(1 - list_cosine_similarity(e.vec, c.cen), 6) AS distance FROM cents c JOIN semb e ON e.site_id = c.site_id
QUALIFY row_number() OVER (PARTITION BY c.site_id, c.cluster_id ORDER BY list_cosine_similarity(e.vec, c.cen) DESC, e.post_id) = 1
""", "cents semb")
def e16(t: Tables):
    return cl.centroid_nearest(at_site(t.embeddings), ["site_id"]).withColumn("distance", F.round("distance", 6))


@query("e17_nearest_cluster", """
SELECT cluster_id, label, post_count FROM semb JOIN clusters USING (cluster_id) WHERE post_id <> 0 AND site_id = 2 ORDER BY list_cosine_similarity(vec, (SELECT vec FROM emb WHERE post_id = 0)) DESC, post_id LIMIT 1
""", "emb semb clusters")
def e17(t: Tables):
    near = vx.nearest_to(at_site(t.embeddings).filter("post_id <> 0"), query_vector(t), 1, site=2)
    return near.join(t.clusters, "cluster_id").select("cluster_id", "label", "post_count")


# fixed values: topics that make the synthetic titles label-worthy
TOPICS = [
    "Link Building for beginners", "The complete guide to email marketing", "How to write copy", "10 best landing page tools", "Keyword research in 2023",
    "SEO audits", "Content strategy - a primer", "Social media ideas", "Product launch checklist", "User experience stories", "Copywriting lessons",
    "Local seo | notes",
]
TOPICS_SQL = "[" + ",".join(f"'{x}'" for x in TOPICS) + "]"
cte("topical", f"SELECT p.post_id, c.cluster_id, {TOPICS_SQL}[(c.cluster_id + p.post_id % 3) % 12 + 1] || ' ' || left(regexp_extract(title, '^\\S+ ?\\S*', 0), 40) AS title, body_html, headings FROM posts p JOIN post_clusters c ON c.post_id = p.post_id", "posts post_clusters")


def topical(t: Tables):
    p = t.posts.join(t.post_clusters, "post_id")
    topic = F.element_at(F.array(*map(F.lit, TOPICS)), ((F.col("cluster_id") + F.col("post_id") % 3) % 12 + 1).cast("int"))
    return p.select(
        "post_id", F.lit("s").alias("site_id"), "cluster_id",
        F.concat(topic, F.lit(" "), F.left(F.regexp_extract("title", r"^\S+ ?\S*", 0), F.lit(40))).alias("title"), "body_html", "headings",
    )


def strip_sql(x: str) -> str:
    s = f"lower({x})"
    for p in lb.FORMAT_PHRASES:
        s = f"replace({s}, '{p.replace(chr(39), chr(39) * 2)}', ' ')"
    s = f"regexp_replace({s}, '^\\d+\\s+(?:best|top|key|most\\s+important|awesome|incredible)\\s+', '')"
    s = f"regexp_replace({s}, '^(?:how\\s+to|what\\s+(?:is|are)|why\\s+you\\s+should)\\s+', '')"
    return f"regexp_replace({s}, '\\s*(?:in|for)\\s+\\d{{4}}\\b.*$', '')"


def _ban(words) -> str:
    return "[" + ",".join(f"'{w}'" for w in words) + "]"


STOPF = _ban(lb.STOP_WORDS + lb.FORMAT_WORDS)
NOISE = _ban(lb.STOP_WORDS + lb.FORMAT_WORDS + lb.UI_WORDS)
cte("stripped", f"""
SELECT post_id, cluster_id, title, {q.strip("CASE WHEN " + q.words('cut') + " >= 3 THEN cut ELSE low END")} AS topic FROM
(SELECT *, regexp_replace(low, '\\s*[-–|:].{{0,30}}$', '') AS cut FROM (SELECT *, {strip_sql('title')} AS low FROM topical))
""", "topical")


def big_sql(w: str) -> str:
    return f"list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])"


cte("tw", f"SELECT post_id, cluster_id, list_filter(regexp_extract_all(topic, '[a-z]{{3,}}'), lambda w: NOT list_contains({STOPF}, w)) AS w FROM stripped", "stripped")
cte("tp", f"SELECT post_id, cluster_id, list_concat(w, {big_sql('w')}) AS ph FROM tw", "tw")


@query("e18_strip_format", "SELECT post_id, topic FROM stripped", "stripped")
def e18(t: Tables):
    return topical(t).select("post_id", lb.strip_format(F.col("title")).alias("topic"))


@query("e19_title_phrases", "SELECT post_id, array_to_string(ph, '|') AS phrases FROM tp", "tp")
def e19(t: Tables):
    return topical(t).select("post_id", F.array_join(lb.title_phrases(F.col("title")), "|").alias("phrases"))


cte("bw", f"SELECT post_id, list_filter(regexp_extract_all(lower(regexp_replace(body_html, '<[^>]+>', ' ', 'g')), '[a-z]{{3,}}'), lambda w: NOT list_contains({NOISE}, w)) AS w FROM topical", "topical")
cte("bodyp", f"""
SELECT post_id, phrase, n FROM (SELECT post_id, phrase, count(*) AS n, min(pos) AS f FROM (SELECT post_id, unnest(w) AS phrase, unnest(range(len(w))) AS pos FROM bw) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY n DESC, f) <= 10)
UNION ALL SELECT post_id, phrase, n FROM (SELECT post_id, phrase, count(*) AS n, min(pos) AS f FROM (SELECT post_id, unnest(b) AS phrase, unnest(range(len(b))) AS pos FROM (SELECT post_id, {big_sql('w')} AS b FROM bw)) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY n DESC, f) <= 5)
""", "bw")
cte("headp", f"""
SELECT post_id, phrase, count(*) AS n FROM (SELECT post_id, unnest(list_concat(w, {big_sql('w')})) AS phrase FROM (
  SELECT post_id, list_filter(regexp_extract_all(lower(h.text), '[a-z]{{3,}}'), lambda w: NOT list_contains({NOISE}, w)) AS w FROM (SELECT post_id, unnest(headings) AS h FROM topical))) GROUP BY 1, 2
""", "topical")


@query("e20_body_phrases", "SELECT post_id, phrase, n, 'body' AS kind FROM bodyp UNION ALL SELECT post_id, phrase, n, 'heading' FROM headp", "bodyp headp")
def e20(t: Tables):
    p = topical(t)
    return lb.body_phrases(p).withColumn("kind", F.lit("body")).unionByName(lb.heading_phrases(p).withColumn("kind", F.lit("heading")))


cte("nd", "SELECT count(*) AS n FROM topical", "topical")
cte("stops", "SELECT word, count(*) AS df FROM (SELECT DISTINCT post_id, unnest(w) AS word FROM tw) GROUP BY 1 HAVING count(*) >= (SELECT n * CASE WHEN n < 100 THEN 0.15 WHEN n < 300 THEN 0.2 ELSE 0.3 END FROM nd)", "tw nd")


@query("e21_site_stops", """
WITH n AS (SELECT cluster_id, count(*) * CASE WHEN count(*) < 100 THEN 0.15 WHEN count(*) < 300 THEN 0.2 ELSE 0.3 END AS lim FROM topical GROUP BY 1),
d AS (SELECT cluster_id, word, count(*) AS df FROM (SELECT DISTINCT post_id, cluster_id, unnest(w) AS word FROM tw) GROUP BY 1, 2)
SELECT cluster_id::VARCHAR AS site_id, word, df FROM d JOIN n USING (cluster_id) WHERE df >= lim
""", "tw topical")
def e21(t: Tables):
    return lb.site_stops(topical(t).withColumn("site_id", F.col("cluster_id").cast("string")))


cte("cdf", "SELECT phrase, count(*) AS df FROM (SELECT DISTINCT post_id, unnest(ph) AS phrase FROM tp) GROUP BY 1", "tp")


@query("e22_corpus_frequency", "SELECT phrase, df FROM cdf", "cdf")
def e22(t: Tables):
    return lb.corpus_frequency(topical(t)).select("phrase", "df")


cte("pscore", f"""
WITH w AS (SELECT cluster_id, phrase, sum(w) AS weight, contains(phrase, ' ') AS is_bigram FROM (
  SELECT cluster_id, unnest(ph) AS phrase, 3 AS w FROM tp UNION ALL SELECT cluster_id, phrase, 2 * n FROM headp JOIN post_clusters USING (post_id)
  UNION ALL SELECT cluster_id, phrase, 1 FROM bodyp JOIN post_clusters USING (post_id)) GROUP BY 1, 2),
ns AS (SELECT unnest({_ban(lb.FORMAT_WORDS)}) AS word UNION SELECT word FROM stops),
m AS (SELECT *, split_part(phrase, ' ', 1) IN (SELECT word FROM ns) AND regexp_extract(phrase, '[^ ]*$', 0) IN (SELECT word FROM ns) AS noise FROM w),
tt AS (SELECT cluster_id, is_bigram, sum(weight) AS total FROM m WHERE is_bigram OR NOT noise GROUP BY 1, 2)
SELECT cluster_id, phrase, is_bigram, weight::BIGINT AS weight, weight / total * ln(n / (1 + coalesce(df, 0))) AS score FROM m JOIN tt USING (cluster_id, is_bigram) CROSS JOIN nd LEFT JOIN cdf USING (phrase) WHERE NOT noise
""", "tp headp bodyp post_clusters stops nd cdf")


@query("e23_phrase_scores", "SELECT cluster_id, phrase, is_bigram, weight, round(score, 6) AS score FROM pscore", "pscore")
def e23(t: Tables):
    return lb.phrase_scores(topical(t)).select("cluster_id", "phrase", "is_bigram", "weight", R6("score"))


@query("e23_cluster_labels")
def e23b(t: Tables):
    out = lb.label_clusters(topical(t))
    return out.withColumn("alternatives", F.array_join("alternatives", "|"))


cte("wdf", f"""
SELECT cluster_id, word, count(*) AS freq, CASE WHEN list_contains({STOPF}, word) THEN 0 ELSE count(*) END AS topic
FROM (SELECT DISTINCT post_id, cluster_id, unnest(regexp_extract_all(lower(title), '[a-z]{{3,}}')) AS word FROM topical) GROUP BY 1, 2
""", "topical")
cte("csize", "SELECT cluster_id, count(*) AS n, greatest(2, ceil(count(*) * 0.15))::INTEGER AS floor FROM topical GROUP BY 1", "topical")


@query("e24_primary_bigram", """
SELECT p.cluster_id, p.phrase, c.floor FROM pscore p JOIN csize c USING (cluster_id)
JOIN wdf a ON a.cluster_id = p.cluster_id AND a.word = split_part(p.phrase, ' ', 1) JOIN wdf b ON b.cluster_id = p.cluster_id AND b.word = split_part(p.phrase, ' ', 2)
WHERE is_bigram AND score > 0 AND weight >= CASE WHEN n < 5 THEN 1 ELSE 2 END AND a.topic >= floor AND b.topic >= floor
QUALIFY row_number() OVER (PARTITION BY p.cluster_id ORDER BY round(score, 9) DESC, p.phrase) = 1
""", "pscore csize wdf")
def e24(t: Tables):
    p = topical(t)
    return lb.primary_bigrams(lb.phrase_scores(p), p.select("post_id", "cluster_id", "title")).select("cluster_id", "phrase", "floor")


@query("e25_label_words", f"""
WITH x AS (SELECT post_id, regexp_extract(lower(title), '[a-z]{{3,}}', 0) AS a, regexp_extract(lower(title), '[a-z]{{3,}}[^a-z]+([a-z]{{3,}})', 1) AS b FROM topical),
tc AS (SELECT *, CASE WHEN list_contains({_ban(lb.ACRONYMS)}, a) THEN upper(a) ELSE upper(left(a, 1)) || substring(a, 2) END AS ta, CASE WHEN list_contains({_ban(lb.ACRONYMS)}, b) THEN upper(b) ELSE upper(left(b, 1)) || substring(b, 2) END AS tb FROM x)
SELECT post_id, CASE WHEN list_contains({_ban(lb.COMPOUNDS)}, a || ' ' || b) THEN ta || ' ' || tb WHEN list_contains({_ban(lb.COMPOUNDS)}, b || ' ' || a) THEN tb || ' ' || ta ELSE ta || ' & ' || tb END AS label,
  length(a) >= 3 AND length(b) >= 3 AND (contains(a, b) OR contains(b, a)) AS redundant FROM tc
""", "topical")
def e25(t: Tables):
    w = F.regexp_extract_all(F.lower("title"), F.lit("[a-z]{3,}"), F.lit(0))
    p = topical(t).select("post_id", F.try_element_at(w, F.lit(1)).alias("a"), F.coalesce(F.nullif(F.regexp_extract(F.lower("title"), "[a-z]{3,}[^a-z]+([a-z]{3,})", 1), F.lit("")), F.lit("")).alias("b"))
    return p.select(
        "post_id", lb.connect(lb.smart_title(F.col("a")), lb.smart_title(F.col("b"))).alias("label"), lb.redundant(F.col("a"), F.col("b")).alias("redundant")
    )


cte("labs", "SELECT cluster_id, ['Link Building', 'Seo & Copy', 'Email Marketing', 'Product Audits'][cluster_id % 4 + 1] AS label, ['Link Building & Seo', 'Write Copy', 'Content Strategy ' || cluster_id] AS alternatives FROM clusters", "clusters")


def labs(t: Tables):
    names = F.array(*map(F.lit, ["Link Building", "Seo & Copy", "Email Marketing", "Product Audits"]))
    return t.clusters.select(
        "cluster_id", F.element_at(names, F.col("cluster_id") % 4 + 1).alias("label"),
        F.array(F.lit("Link Building & Seo"), F.lit("Write Copy"), F.concat(F.lit("Content Strategy "), F.col("cluster_id").cast("string"))).alias("alternatives"),
    )


def of_two_sites(df):
    """Even and odd clusters as two sites."""
    return df.withColumn("site_id", (F.col("cluster_id") % 2).cast("string"))


@query("e26_label_specificity", """
WITH lw AS (SELECT cluster_id, label, unnest(regexp_extract_all(lower(label), '[a-z]{3,}')) AS word FROM labs),
k AS (SELECT cluster_id, label, count(*) AS m FROM lw GROUP BY 1, 2),
h AS (SELECT lw.cluster_id, lw.label, w.cluster_id AS o, count(*) AS c FROM lw JOIN wdf w USING (word) WHERE w.cluster_id <> lw.cluster_id AND w.cluster_id % 2 = lw.cluster_id % 2 GROUP BY 1, 2, 3),
c AS (SELECT h.cluster_id, h.label, count(*) AS hits FROM h JOIN k USING (cluster_id, label) WHERE c = m GROUP BY 1, 2)
SELECT k.cluster_id, k.label, NOT coalesce(hits / ((SELECT count(*) FROM clusters x WHERE x.cluster_id % 2 = k.cluster_id % 2) - 1) > 0.5, false) AS specific FROM k LEFT JOIN c USING (cluster_id, label)
""", "labs wdf clusters")
def e26(t: Tables):
    return lb.specific(labs(t), of_two_sites(topical(t)))


@query("e27_label_repair", """
WITH k AS (SELECT *, row_number() OVER (PARTITION BY label, cluster_id % 2 ORDER BY cluster_id) AS rn FROM labs),
n AS (SELECT cluster_id, CASE WHEN rn = 1 THEN label WHEN NOT EXISTS (SELECT 1 FROM labs l WHERE l.cluster_id < k.cluster_id AND l.cluster_id % 2 = k.cluster_id % 2 AND l.label = 'Link Building') THEN 'Link Building & Seo' WHEN NOT EXISTS (SELECT 1 FROM labs l WHERE l.cluster_id < k.cluster_id AND l.cluster_id % 2 = k.cluster_id % 2 AND l.label = 'Write Copy') THEN 'Write Copy' ELSE label END AS label FROM k),
c AS (SELECT label, cluster_id % 2 AS s, count(*) AS n FROM n GROUP BY 1, 2),
w AS (SELECT cluster_id, word, count(*) AS n FROM (SELECT cluster_id, unnest(w) AS word FROM tw) WHERE word NOT IN (SELECT word FROM stops) GROUP BY 1, 2),
x AS (SELECT n.cluster_id, w.word FROM n JOIN c ON c.label = n.label AND c.s = n.cluster_id % 2 JOIN w ON w.cluster_id = n.cluster_id WHERE c.n > 1 AND NOT contains(lower(n.label), w.word) QUALIFY row_number() OVER (PARTITION BY n.cluster_id ORDER BY w.n DESC, w.word) = 1)
SELECT n.cluster_id, n.label || CASE WHEN x.word IS NOT NULL THEN ' (' || CASE WHEN x.word = 'seo' THEN 'SEO' ELSE upper(left(x.word, 1)) || substring(x.word, 2) END || ')' ELSE '' END AS label FROM n LEFT JOIN x USING (cluster_id)
""", "labs tw stops")
def e27(t: Tables):
    return lb.repair_duplicates(of_two_sites(labs(t)), lb.cluster_words(topical(t))).select("cluster_id", "label")


@query("e28_descriptions", """
SELECT post_id, CASE len(w) WHEN 0 THEN '' WHEN 1 THEN 'Posts covering ' || w[1] || '.' WHEN 2 THEN 'Posts covering ' || w[1] || ' and ' || w[2] || '.'
  ELSE 'Posts covering ' || array_to_string(w[:-2], ', ') || ', and ' || w[-1] || '.' END AS description
FROM (SELECT post_id, list_filter(w[:5], lambda x: NOT contains('link building', x)) AS w FROM tw)
""", "tw")
def e28(t: Tables):
    w = F.slice(lb.title_words(lb.strip_format(F.col("title"))), 1, 5)
    return topical(t).select("post_id", lb.description(F.lit("Link Building"), w).alias("description"))


@query("e29_membership", """
WITH m AS (SELECT post_id, label AS cluster_id FROM (SELECT vec_id AS post_id, label FROM embeddings UNION ALL SELECT vec_id, 0 FROM embeddings WHERE label = 3)), c AS (SELECT post_id, count(*) AS c FROM m JOIN posts USING (post_id) GROUP BY 1)
SELECT count(*) AS distinct_assigned, sum(c)::BIGINT AS total_assignments, count(*) FILTER (c > 1) AS multi_assigned, (SELECT count(*) FROM posts WHERE post_id NOT IN (SELECT post_id FROM m)) AS unassigned FROM c
""", "posts")
def e29(t: Tables):
    m = t.post_clusters.unionByName(t.post_clusters.filter("cluster_id = 3").withColumn("cluster_id", F.lit(0)))
    return cl.membership_report(t.posts, t.clusters, m)


@query("e29_count_mismatch", """
WITH m AS (SELECT label AS cluster_id FROM embeddings UNION ALL SELECT 0 FROM embeddings WHERE label = 3)
SELECT cluster_id, post_count AS stored, count(m.cluster_id) AS actual, post_count = count(m.cluster_id) AS ok FROM clusters LEFT JOIN m USING (cluster_id) GROUP BY 1, 2
""", "clusters")
def e29b(t: Tables):
    m = t.post_clusters.unionByName(t.post_clusters.filter("cluster_id = 3").withColumn("cluster_id", F.lit(0)))
    return cl.count_mismatches(t.clusters, m)


@query("e30_flatten_parents", """
WITH lf AS (SELECT cluster_id FROM clusters WHERE cluster_id NOT IN (SELECT parent_cluster_id FROM clusters WHERE parent_cluster_id IS NOT NULL))
SELECT e.post_id, c.cluster_id::BIGINT AS cluster_id, round(list_cosine_similarity(e.vec, c.cen), 6) AS similarity FROM semb e JOIN cents c ON c.site_id = e.site_id JOIN lf ON lf.cluster_id = c.cluster_id
WHERE e.cluster_id NOT IN (SELECT cluster_id FROM lf) QUALIFY row_number() OVER (PARTITION BY e.post_id ORDER BY list_cosine_similarity(e.vec, c.cen) DESC, c.cluster_id) = 1
""", "semb cents clusters")
def e30(t: Tables):
    return cl.flatten_parents(t.clusters, t.post_clusters, at_site(t.embeddings), ["site_id"]).withColumn("similarity", F.round("similarity", 6))
