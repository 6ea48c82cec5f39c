"""Checks of the pair operators (group F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pairs as pr
from ..operators.vectors import similarity_quantiles
from . import sqltext as q
from .catalog_clusters import topical
from .oracle import cte, query
from .tables import AS_OF, Tables, at_site

A = "DATE '2024-01-31'"


def ban(words):
    return "[" + ",".join(f"'{w}'" for w in words) + "]"


@query("f1_exact_duplicates", """
SELECT p.site_id, f AS canonical_id, post_id, p.content_hash FROM posts p JOIN (SELECT site_id, content_hash, min(post_id) AS f FROM posts GROUP BY 1, 2 HAVING count(*) > 1) g
ON g.site_id = p.site_id AND g.content_hash = p.content_hash WHERE post_id <> f
""", "posts")
def f1(t: Tables):
    return pr.exact_duplicates(t.posts)


@query("f1_exact_duplicates_all_sites", """
SELECT f AS canonical_id, doc_id AS post_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS f FROM documents) WHERE doc_id <> f
""")
def f1b(t: Tables):
    return pr.exact_duplicates(t.posts.withColumn("site_id", F.lit("all"))).select("canonical_id", "post_id")


@query("f2_duplicate_groups", "SELECT content_hash, min(post_id) AS canonical_id, count(*) AS copies, min_by(title, post_id) AS canonical_title FROM posts GROUP BY 1 HAVING count(*) > 1", "posts")
def f2(t: Tables):
    return pr.duplicate_groups(t.posts.withColumn("site_id", F.lit("all"))).drop("site_id")


cte("limits", """
WITH p AS (SELECT a.post_id % 5 AS site_id, round(list_cosine_similarity(a.vec, b.vec), 6) AS s FROM emb a JOIN emb b ON a.post_id % 5 = b.post_id % 5 AND a.post_id < b.post_id)
SELECT site_id, count(*) AS n, greatest(quantile_cont(s, 0.85), 0.40) AS flag, greatest(quantile_cont(s, 0.92), 0.50) AS high, greatest(quantile_cont(s, 0.97), 0.60) AS critical FROM p GROUP BY 1 HAVING count(*) >= 10
""", "emb")


@query("f3_calibration", "SELECT site_id, n, round(flag, 6) AS flag, round(high, 6) AS high, round(critical, 6) AS critical FROM limits", "limits")
def f3(t: Tables):
    return pr.calibrate(at_site(t.embeddings)).select("site_id", "n", *[F.round(c, 6).alias(c) for c in ("flag", "high", "critical")])


@query("f3_similarity_quantiles", """
SELECT a.post_id % 5 AS site_id, count(*) AS n, round(quantile_cont(round(list_cosine_similarity(a.vec, b.vec), 6), 0.25), 6) AS low, round(quantile_cont(round(list_cosine_similarity(a.vec, b.vec), 6), 0.97), 6) AS high
FROM emb a JOIN emb b ON a.post_id % 5 = b.post_id % 5 AND a.post_id < b.post_id GROUP BY 1
""", "emb")
def f3b(t: Tables):
    q = similarity_quantiles(at_site(t.embeddings), "site_id", {"low": 0.25, "high": 0.97})
    return q.select("site_id", "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


cte("qset", f"SELECT DISTINCT post_id, lower(query) AS query FROM gsc WHERE date >= {A} - 90", "gsc")
cte("cand", """
WITH p AS (SELECT a AS x, b AS y, ca AS c, sim, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rk FROM sims WHERE ca = cb),
n AS (SELECT cluster_id, count(*) AS n FROM emb GROUP BY 1), u AS (SELECT least(x, y) AS a, greatest(x, y) AS b, c, max(sim) AS sim, min(rk) AS rk FROM p GROUP BY 1, 2, 3),
s AS (SELECT u.*, (SELECT count(*) FROM qset i JOIN qset j USING (query) WHERE i.post_id = u.a AND j.post_id = u.b) AS k FROM u)
SELECT a AS post_a_id, b AS post_b_id, c AS cluster_id, sim AS cosine, k AS n_shared FROM s JOIN n ON n.cluster_id = c
WHERE n < 20 OR (rk <= 10 AND sim >= 0.3) OR (k > 0 AND sim >= 0.3) OR k >= 3
""", "sims qset emb")


@query("f4_cluster_candidates", "SELECT post_a_id, post_b_id, round(cosine, 6) AS cosine, n_shared FROM cand", "cand")
def f4(t: Tables):
    c = pr.cluster_candidates(t.embeddings, pr.query_sets(t.gsc, AS_OF), 0.3)
    return c.select("post_a_id", "post_b_id", F.round("cosine", 6).alias("cosine"), "n_shared")


# site flags spread around the cosines of the vectors given
cte("flags", "SELECT unnest(range(5)) AS site_id, 0.2 + 0.05 * unnest(range(5)) AS flag")
cte("scand", """
WITH p AS (SELECT a AS x, b AS y, ca AS c, a % 5 * 10 + ca AS k, sim, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rk FROM sims WHERE ca = cb AND a % 5 = b % 5),
n AS (SELECT post_id % 5 * 10 + cluster_id AS k, count(*) AS n FROM emb GROUP BY 1), u AS (SELECT least(x, y) AS a, greatest(x, y) AS b, k, max(sim) AS sim, min(rk) AS rk FROM p GROUP BY 1, 2, 3),
s AS (SELECT u.*, (SELECT count(*) FROM qset i JOIN qset j USING (query) WHERE i.post_id = u.a AND j.post_id = u.b) AS q FROM u)
SELECT a AS post_a_id, b AS post_b_id, a % 5 AS site_id, s.k AS cluster_id, sim AS cosine, q AS n_shared, flag FROM s JOIN n ON n.k = s.k JOIN flags f ON f.site_id = a % 5
WHERE n < 5 OR (rk <= 10 AND sim >= flag) OR (q > 0 AND sim >= flag) OR q >= 3
""", "sims qset emb flags")


def site_vectors(t: Tables):
    v = at_site(t.embeddings)
    return v.withColumn("cluster_id", F.col("site_id") * 10 + F.col("cluster_id"))


def site_flags(t: Tables):
    return at_site(t.embeddings).select("site_id").distinct().withColumn("flag", 0.2 + 0.05 * F.col("site_id"))


@query("f4_site_candidates", "SELECT post_a_id, post_b_id, round(cosine, 6) AS cosine, n_shared FROM scand", "scand")
def f4b(t: Tables):
    c = pr.cluster_candidates(site_vectors(t), pr.query_sets(t.gsc, AS_OF), site_flags(t), small=5)
    return c.select("post_a_id", "post_b_id", F.round("cosine", 6).alias("cosine"), "n_shared")


@query("f5_shared_queries", """
SELECT p.post_a_id, p.post_b_id, count(j.query) AS n_shared, coalesce(array_to_string(list(j.query ORDER BY j.query) FILTER (j.query IS NOT NULL), ','), '') AS shared
FROM pairs p LEFT JOIN (SELECT i.post_id AS a, j.post_id AS b, query FROM qset i JOIN qset j USING (query)) j ON j.a = p.post_a_id AND j.b = p.post_b_id GROUP BY 1, 2
""", "pairs qset")
def f5(t: Tables):
    s = pr.shared_queries(t.pairs.select("post_a_id", "post_b_id"), pr.query_sets(t.gsc, AS_OF))
    return s.select("post_a_id", "post_b_id", "n_shared", F.coalesce(F.array_join("shared", ","), F.lit("")).alias("shared"))


cte("ppost", "SELECT p.post_id, p.content_hash, p.language, p.content_intent, p.page_type, t.cluster_id, t.title, 'https://x.example.com/blog/' || regexp_replace(lower(t.title), '[^a-z0-9]+', '-', 'g') AS url, p.headings FROM posts p JOIN topical t ON t.post_id = p.post_id", "posts topical")


def pair_posts(t: Tables):
    tp = topical(t).select("post_id", "cluster_id", F.col("title").alias("_t"))
    return t.posts.join(tp, "post_id").withColumn("title", F.col("_t")).drop("_t").withColumn(
        "url", F.concat(F.lit("https://x.example.com/blog/"), F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-"))
    )


@query("f6_pair_gates", """
SELECT c.post_a_id, c.post_b_id FROM cand c JOIN ppost a ON a.post_id = post_a_id JOIN ppost b ON b.post_id = post_b_id
WHERE a.content_hash <> b.content_hash AND a.language = b.language AND (cosine >= CASE WHEN a.content_intent <> b.content_intent THEN 0.4 ELSE 0.3 END OR n_shared >= 3)
""", "cand ppost")
def f6(t: Tables):
    pages = pr.page_signals(pair_posts(t)).select("post_id", "hash", "lang", "intent")
    return pr.cluster_candidates(t.embeddings, pr.query_sets(t.gsc, AS_OF), 0.3, pages=pages).select("post_a_id", "post_b_id")


@query("f6_site_gates", """
SELECT c.post_a_id, c.post_b_id FROM scand c JOIN ppost a ON a.post_id = post_a_id JOIN ppost b ON b.post_id = post_b_id
WHERE a.content_hash <> b.content_hash AND a.language = b.language AND (cosine >= flag + CASE WHEN a.content_intent <> b.content_intent THEN 0.1 ELSE 0 END OR n_shared >= 3)
""", "scand ppost")
def f6b(t: Tables):
    pages = pr.page_signals(pair_posts(t)).select("post_id", "hash", "lang", "intent")
    return pr.cluster_candidates(site_vectors(t), pr.query_sets(t.gsc, AS_OF), site_flags(t), small=5, pages=pages).select("post_a_id", "post_b_id")


def wset(x, noise, pat="[a-z]{3,}"):
    return f"list_distinct(list_filter(regexp_extract_all({x}, '{pat}'), lambda w: NOT list_contains({ban(noise)}, w)))"


SLUG = wset("regexp_extract(url, '[^/]*$', 0)", pr.SLUG_STOPS + pr.SLUG_FORMATS)
TW = wset("lower(regexp_replace(title, '\\s*[-–:|]\\s*.+$', ''))", pr.TITLE_FORMATS)
TOPIC = wset("regexp_replace(regexp_replace(lower(title), '\\s*[-–|:].{0,30}$', ''), '^\\d+\\s+', '')", pr.SLUG_STOPS + pr.SLUG_FORMATS + pr.TOPIC_NOISE)
HW = f"list_distinct(flatten(list_transform(headings, lambda h: list_filter(regexp_extract_all(lower(h.text), '[a-z]{{3,}}'), lambda w: NOT list_contains({ban(pr.TITLE_FORMATS)}, w)))))"
NOA = lambda x: f"regexp_replace({x}, '^(the|a|an)\\s+', '')"
BARE = lambda x: NOA(q.strip(f"rtrim({q.strip(x)}, ':')"))
esc = lambda p: p.replace("'", "''")
REST = f"regexp_replace(regexp_replace({q.strip(f'''regexp_replace(t, '{pr.LEADING}', '')''')}, '\\s*[-–|:].+$', ''), '\\s+(?:in\\s+\\d{{4}}|for\\s+\\d{{4}}|guide|tutorial|tips|strategies)$', '')"
COLON = NOA(q.strip(f"regexp_extract(t, '{pr.BEFORE_COLON}', 1)"))
LOOSE = f"regexp_replace(regexp_replace({q.strip('''regexp_replace(regexp_replace(t, '\\s+[-–|]\\s+.+$', ''), '\\?+$', '')''')}, '^(the|a|an|why|when|where|who)\\s+', ''), '\\s+(?:in|for|of)\\s+\\d{{4}}$', '')"
ENTITY = f"""CASE WHEN regexp_matches(t, '{pr.VERSUS}') THEN {BARE(f"regexp_extract(t, '{pr.VERSUS}', 1)")}
  WHEN regexp_matches(t, '{pr.REVIEW_OF}') THEN {q.strip(f"regexp_extract(t, '{pr.REVIEW_OF}', 1)")}
  WHEN regexp_matches(t, '{esc(pr.FORMAT_TAIL)}') THEN {BARE(f"regexp_replace(t, '{esc(pr.FORMAT_TAIL)}', '')")}
  WHEN regexp_matches(t, '{pr.REPORT_HEAD}') THEN {NOA(q.strip(f"regexp_extract(t, '{pr.REPORT_HEAD}', 1)"))}
  WHEN regexp_matches(t, '{pr.LEADING}') AND length({REST}) >= 3 THEN array_to_string(regexp_extract_all({REST}, '\\S+')[1:4], ' ')
  WHEN regexp_matches(t, '{pr.BEST_OF}') THEN regexp_replace({q.strip(f"regexp_extract(t, '{pr.BEST_OF}', 1)")}, '\\s+(?:to\\s+try|you\\s+should|for\\s+.+)$', '')
  WHEN regexp_matches(t, '{pr.BEFORE_COLON}') AND len(list_filter(regexp_extract_all({COLON}, '\\S+'), lambda w: length(w) >= 3)) > 0 AND {COLON} NOT IN ('how','what','why','the') THEN {COLON}
  ELSE CASE WHEN len(fw) >= 2 AND len(list_filter(fw, lambda w: length(w) >= 5 OR list_contains({ban(pr.SHORT_TOPICS)}, w))) > 0 THEN array_to_string(fw[1:3], ' ') END END"""
GRP = "CASE " + " ".join(
    f"WHEN {o} >= 1 AND {o} = greatest({', '.join(f'g{i}' for i in range(len(pr.INTENT_GROUPS)))}) THEN '{g}'" for g, o in zip(pr.INTENT_GROUPS, [f"g{i}" for i in range(len(pr.INTENT_GROUPS))])
) + " END"
GCOLS = ", ".join(f"len(list_intersect(gw, {ban(v)})) AS g{i}" for i, v in enumerate(pr.INTENT_GROUPS.values()))
cte("sig0", f"""
SELECT post_id, content_hash, language, content_intent, page_type, cluster_id, slug, tw, topic, hw, rw, nullif({ENTITY}, '') AS entity, gw FROM (SELECT *, list_filter(regexp_extract_all({LOOSE}, '[a-z]{{3,}}'), lambda w: NOT list_contains({ban(pr.SLUG_STOPS + pr.ENTITY_NOISE)}, w)) AS fw FROM (
SELECT *, {SLUG} AS slug, {TW} AS tw, {TOPIC} AS topic, coalesce({HW}, []) AS hw, len(list_intersect(coalesce(list_distinct(flatten(list_transform(headings, lambda h: regexp_extract_all(lower(h.text), '[a-z]+')))), []), {ban(pr.REVIEW_HEADINGS)})) >= 3 AS rw,
  {q.strip('lower(title)')} AS t, list_distinct(regexp_extract_all(lower(title || ' ' || url), '[a-z]{{3,}}')) AS gw FROM ppost))
""", "ppost")
cte("sig", f"SELECT *, {GRP} AS grp FROM (SELECT *, {GCOLS} FROM sig0)", "sig0")


def srt(c):
    return F.array_join(F.array_sort(c), " ")


@query("f7_slug_words", "SELECT post_id, array_to_string(list_sort(slug), ' ') AS words FROM sig", "sig")
def f7(t: Tables):
    return pair_posts(t).select("post_id", srt(pr.slug_words(F.col("url"))).alias("words"))


@query("f8_title_entity", "SELECT post_id, entity FROM sig", "sig")
def f8(t: Tables):
    return pr.page_signals(pair_posts(t)).select("post_id", F.nullif("entity", F.lit("")).alias("entity"))


@query("f9_title_words", "SELECT post_id, array_to_string(list_sort(tw), ' ') AS words FROM sig", "sig")
def f9(t: Tables):
    return pair_posts(t).select("post_id", srt(pr.title_words(F.col("title"))).alias("words"))


@query("f10_intent_group", "SELECT post_id, grp FROM sig", "sig")
def f10(t: Tables):
    return pair_posts(t).select("post_id", pr.intent_group(F.col("title"), F.col("url")).alias("grp"))


JAC = "(CASE WHEN len({a}) + len({b}) - len(list_intersect({a}, {b})) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END)::DOUBLE"
J = lambda c: f"CASE WHEN len(a.{c}) > 0 AND len(b.{c}) > 0 THEN {JAC.format(a='a.' + c, b='b.' + c)} ELSE 0 END"


@query("f11_heading_jaccard", f"SELECT post_a_id, post_b_id, round({J('hw')}, 6) AS h2_jaccard FROM pairs JOIN sig a ON a.post_id = post_a_id JOIN sig b ON b.post_id = post_b_id", "pairs sig")
def f11(t: Tables):
    return blended(t).select("post_a_id", "post_b_id", F.round("h2_jaccard", 6).alias("h2_jaccard"))


@query("f12_review_template", "SELECT post_id, len(list_intersect(list_distinct(regexp_extract_all(lower(array_to_string([p_type, p_name, 'pricing'], ' ') || ' pros ' || CASE WHEN p_size > 5 THEN 'cons' ELSE '' END), '[a-z]+')), " + ban(pr.REVIEW_HEADINGS) + ")) >= 3 AS review FROM (SELECT p_partkey AS post_id, * FROM part)")
def f12(t: Tables):
    h = F.array(*[F.struct(F.lit("h2").alias("level"), c.alias("text")) for c in (F.col("p_type"), F.col("p_name"), F.lit("Pricing"), F.lit("Pros"), F.when(F.col("p_size") > 5, "Cons").otherwise(""))])
    return t.raw("part").select(F.col("p_partkey").alias("post_id"), pr.review_template(h).alias("review"))


TT = f"CASE WHEN len(a.topic) = 0 OR len(b.topic) = 0 THEN 0.3::DOUBLE ELSE {JAC.format(a='a.topic', b='b.topic')} END"


@query("f13_topic_overlap", f"SELECT post_a_id, post_b_id, round({TT}, 6) AS title_topic FROM pairs JOIN sig a ON a.post_id = post_a_id JOIN sig b ON b.post_id = post_b_id", "pairs sig")
def f13(t: Tables):
    return blended(t).select("post_a_id", "post_b_id", F.round("title_topic", 6).alias("title_topic"))


def blended(t: Tables):
    return pr.blend(pr.with_signals(t.pairs, pr.page_signals(pair_posts(t))))


def blend_sql(src: str, cols: str) -> str:
    ea, eb = "string_split(a.entity, ' ')", "string_split(b.entity, ' ')"
    near = f"CASE WHEN len(list_distinct({ea})) >= 2 OR len(list_distinct({eb})) >= 2 THEN {JAC.format(a=f'list_distinct({ea})', b=f'list_distinct({eb})')} ELSE 0 END"
    return f"""
SELECT *, CASE WHEN blended > 0.8 THEN 'critical' WHEN blended > 0.55 THEN 'high' WHEN blended > 0.35 THEN 'medium' ELSE 'low' END AS tier FROM (
SELECT *, 0.15::DOUBLE * least(coalesce(cosine, 0), 1) + 0.2::DOUBLE * so + 0.25::DOUBLE * (0.6::DOUBLE * CASE WHEN ent_a = ent_b THEN 1 WHEN ent_a IS NOT NULL AND ent_b IS NOT NULL THEN CASE WHEN near >= 0.2 THEN near ELSE 0 END WHEN ent_a IS NOT NULL OR ent_b IS NOT NULL THEN 0.2 ELSE kw END
  + 0.4::DOUBLE * CASE WHEN ent_a <> ent_b AND near < 0.2 THEN 0 WHEN ga IS NOT NULL AND gb IS NOT NULL THEN CASE WHEN ga = gb THEN 1 ELSE 0.3 END ELSE 0.5 END)
  + 0.2::DOUBLE * tt + 0.2::DOUBLE * CASE WHEN ent_a <> ent_b AND rva AND rvb THEN 0 ELSE hj END AS blended FROM (
SELECT {cols}, a.entity AS ent_a, b.entity AS ent_b, a.grp AS ga, b.grp AS gb, a.rw AS rva, b.rw AS rvb, a.content_intent AS ia, b.content_intent AS ib, {J('slug')} AS so, {J('hw')} AS hj, {J('tw')} AS kw, {TT} AS tt, {near} AS near
FROM {src} x JOIN sig a ON a.post_id = post_a_id JOIN sig b ON b.post_id = post_b_id))"""


cte("blended", blend_sql("pairs", "x.*"), "pairs sig")


@query("f14_blended_score", "SELECT post_a_id, post_b_id, round(so, 6) AS slug_overlap, round(blended, 6) AS blended, tier FROM blended", "blended")
def f14(t: Tables):
    return blended(t).select("post_a_id", "post_b_id", F.round("slug_overlap", 6).alias("slug_overlap"), F.round("blended", 6).alias("blended"), "tier")


SEV = "CASE WHEN cosine >= {c} AND n_shared > 0 THEN 'critical' WHEN cosine >= {h} THEN 'high' WHEN cosine >= {f} AND n_shared > 0 THEN 'high' WHEN cosine >= {f} THEN 'medium' WHEN n_shared >= 3 THEN 'medium' ELSE 'low' END"


@query("f15_severity", f"SELECT post_a_id, post_b_id, {SEV.format(c=0.9, h=0.8, f=0.6)} AS sev FROM (SELECT * REPLACE (CASE WHEN post_a_id % 10 <> 0 THEN cosine END AS cosine) FROM pairs)", "pairs")
def f15(t: Tables):
    cos = F.when(F.col("post_a_id") % 10 != 0, F.col("cosine"))
    return t.pairs.select("post_a_id", "post_b_id", pr.severity(cos, F.col("n_shared"), 0.6, 0.8, 0.9).alias("sev"))


@query("f16_overlap_score", """
SELECT post_a_id, post_b_id, round(CASE WHEN cosine IS NOT NULL AND u > 0 THEN 0.7::DOUBLE * cosine + 0.3::DOUBLE * n_shared / u WHEN cosine IS NOT NULL THEN cosine WHEN u > 0 THEN n_shared / u ELSE 0 END, 6) AS score
FROM (SELECT post_a_id, post_b_id, n_shared, CASE WHEN post_a_id % 10 <> 0 THEN cosine END AS cosine, n_shared + post_b_id % 4 AS u FROM pairs)
""", "pairs")
def f16(t: Tables):
    cos = F.when(F.col("post_a_id") % 10 != 0, F.col("cosine"))
    return t.pairs.select("post_a_id", "post_b_id", F.round(pr.overlap_score(cos, F.col("n_shared"), F.col("n_shared") + F.col("post_b_id") % 4), 6).alias("score"))


def strong_sql(src: str, best: str = "SELECT cluster_id, max(traffic) AS m FROM scores WHERE traffic > 0 GROUP BY 1", key: str = "x.cluster_id = p.cluster_id") -> str:
    return f"""SELECT p.*, CASE WHEN CASE WHEN a.traffic > 0 OR b.traffic > 0 THEN a.composite_score / 100 * 0.3::DOUBLE + a.traffic / m * 0.7::DOUBLE ELSE a.composite_score END >= CASE WHEN a.traffic > 0 OR b.traffic > 0 THEN b.composite_score / 100 * 0.3::DOUBLE + b.traffic / m * 0.7::DOUBLE ELSE b.composite_score END
  THEN post_a_id ELSE post_b_id END AS strong FROM {src} p LEFT JOIN ({best}) x ON {key} JOIN scores a ON a.post_id = post_a_id JOIN scores b ON b.post_id = post_b_id"""


@query("f17_stronger_post", f"SELECT post_a_id, post_b_id, strong FROM ({strong_sql('pairs')})", "pairs scores")
def f17(t: Tables):
    return pr.stronger(t.pairs.drop("stronger_post_id"), t.scores).select("post_a_id", "post_b_id", F.col("stronger_post_id").alias("strong"))


RES = "CASE WHEN cosine >= 0.95 THEN 'redirect' WHEN hj > 0.7 THEN 'merge' WHEN so > 0.6 THEN 'differentiate' WHEN ia <> ib THEN 'differentiate' WHEN tt > 0.8 AND cosine < 0.7 THEN 'differentiate' WHEN {s} = 'critical' OR cosine >= 0.85 THEN 'merge' ELSE 'monitor' END"


@query("f18_resolution", f"SELECT post_a_id, post_b_id, {RES.format(s='severity')} AS action FROM blended", "blended")
def f18(t: Tables):
    c = F.col
    r = pr.resolution(c("cosine"), c("severity"), c("intent_a"), c("intent_b"), c("slug_overlap"), c("h2_jaccard"), c("title_topic"))
    return blended(t).select("post_a_id", "post_b_id", r.alias("action"))


OUT = "post_a_id, post_b_id, cluster_id, round(cosine, 6) AS cosine, round(ov, 6) AS overlap_score, sev AS severity, round(least(100, blended * 100), 6) AS severity_score, strong AS stronger_post_id, {r} AS resolution"
cte("cross0", """
SELECT DISTINCT least(a, b) AS post_a_id, greatest(a, b) AS post_b_id, sim AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rk FROM sims WHERE a IN (SELECT post_id FROM posts WHERE page_type <> 'landing') AND b IN (SELECT post_id FROM posts WHERE page_type <> 'landing') AND a % 5 = b % 5) WHERE rk <= 5 AND sim >= 0.2 AND ca <> cb
""", "sims posts")
cte("cross1", f"""
SELECT y.* FROM ({blend_sql("(SELECT post_a_id, post_b_id, max(cosine) AS cosine FROM cross0 GROUP BY 1, 2)", "x.*, a.cluster_id")}) y JOIN sig a ON a.post_id = post_a_id JOIN sig b ON b.post_id = post_b_id
WHERE tier <> 'low' AND a.language = b.language AND a.content_hash <> b.content_hash AND NOT EXISTS (SELECT 1 FROM pairs e WHERE e.post_a_id = y.post_a_id AND e.post_b_id = y.post_b_id)
""", "cross0 sig pairs")


def round_out(df):
    return df.select(
        "post_a_id", "post_b_id", "cluster_id", F.round("cosine", 6).alias("cosine"), F.round("overlap_score", 6).alias("overlap_score"), "severity",
        F.round("severity_score", 6).alias("severity_score"), "stronger_post_id", "resolution",
    )


@query("f19_cross_cluster_pairs", f"SELECT {OUT.format(r=RES.format(s='sev'))} FROM ({strong_sql('(SELECT *, tier AS sev, blended AS ov FROM cross1)', 'SELECT post_id % 5 AS site_id, max(traffic) AS m FROM scores WHERE traffic > 0 GROUP BY 1', 'x.site_id = p.post_a_id % 5')})", "cross1 scores")
def f19(t: Tables):
    return round_out(pr.cross_pairs(at_site(pair_posts(t)), t.embeddings, t.pairs, at_site(t.scores), 0.2))


cte("clus1", blend_sql("cand", "x.*") , "cand sig")


@query("f19_cluster_pairs", f"""
SELECT {OUT.format(r=RES.format(s='sev'))} FROM ({strong_sql(f"(SELECT c.*, CASE WHEN n_shared > 0 THEN {SEV.format(c=0.65, h=0.55, f=0.3)} ELSE tier END AS sev, CASE WHEN n_shared > 0 THEN greatest(blended, 0.5) ELSE blended END AS ov FROM clus1 c JOIN ppost a ON a.post_id = post_a_id JOIN ppost b ON b.post_id = post_b_id WHERE a.content_hash <> b.content_hash AND a.language = b.language AND (cosine >= CASE WHEN a.content_intent <> b.content_intent THEN 0.4 ELSE 0.3 END OR n_shared >= 3) AND (n_shared > 0 OR tier <> 'low'))")})
""", "clus1 scores ppost")
def f19b(t: Tables):
    return round_out(pr.cluster_pairs(pair_posts(t), t.embeddings, pr.query_sets(t.gsc, AS_OF), t.scores, flag=0.3))


@query("f20_pair_cap", "SELECT post_a_id, post_b_id, severity_score FROM pairs ORDER BY severity_score DESC NULLS LAST, post_a_id, post_b_id LIMIT (SELECT greatest(500, least(count(*) * 3, 1500)) FROM nation)", "pairs")
def f20(t: Tables):
    posts = t.raw("nation").select(F.lit("s").alias("site_id"))
    return pr.cap_pairs(t.pairs.withColumn("site_id", F.lit("s")), posts).select("post_a_id", "post_b_id", "severity_score")


cte("bothways", "SELECT post_a_id, post_b_id, cosine FROM pairs UNION ALL SELECT post_b_id, post_a_id, round(cosine - 0.1::DOUBLE + (post_a_id % 3) * 0.1::DOUBLE, 3) FROM pairs", "pairs")


@query("f21_dedup_pairs", "SELECT post_a_id, post_b_id, cosine FROM bothways QUALIFY row_number() OVER (PARTITION BY least(post_a_id, post_b_id), greatest(post_a_id, post_b_id) ORDER BY cosine DESC, post_a_id) = 1", "bothways")
def f21(t: Tables):
    p = t.pairs.select("post_a_id", "post_b_id", "cosine")
    back = p.select(F.col("post_b_id").alias("post_a_id"), F.col("post_a_id").alias("post_b_id"), F.round(F.col("cosine") - 0.1 + (F.col("post_a_id") % 3) * 0.1, 3).alias("cosine"))
    return pr.dedup_pairs(p.unionByName(back))


@query("f22_chunk_confirmation", """
WITH c AS (SELECT post_id % 100 AS post_id, vec FROM emb), p AS (SELECT DISTINCT post_a_id % 100 AS a, post_b_id % 100 AS b FROM pairs WHERE cosine >= 0.75)
SELECT a AS post_a_id, b AS post_b_id, round(max(list_cosine_similarity(x.vec, y.vec)), 6) AS chunk_similarity, max(list_cosine_similarity(x.vec, y.vec)) >= 0.3 AS confirmed
FROM p JOIN c x ON x.post_id = a JOIN c y ON y.post_id = b GROUP BY 1, 2
""", "emb pairs")
def f22(t: Tables):
    m = lambda c: (F.col(c) % 100).alias(c)
    p = t.pairs.filter("cosine >= 0.75").select(m("post_a_id"), m("post_b_id")).distinct().withColumn("cosine", F.lit(0.9))
    chunks = t.embeddings.select(m("post_id"), "vec")
    return pr.confirm_chunks(p, chunks, limit=0.3).withColumn("chunk_similarity", F.round("chunk_similarity", 6))


@query("f23_similarity_distribution", """
SELECT cluster_id, count(*) AS total, min(cosine) AS min_sim, max(cosine) AS max_sim, round(avg(cosine), 6) AS avg_sim, round(stddev(cosine), 6) AS stddev_sim, round(quantile_cont(cosine, 0.05), 6) AS p5, round(quantile_cont(cosine, 0.1), 6) AS p10, round(quantile_cont(cosine, 0.25), 6) AS p25,
  round(quantile_cont(cosine, 0.5), 6) AS p50, round(quantile_cont(cosine, 0.75), 6) AS p75, round(quantile_cont(cosine, 0.9), 6) AS p90, round(quantile_cont(cosine, 0.95), 6) AS p95 FROM pairs GROUP BY 1
""", "pairs")
def f23(t: Tables):
    d = pr.similarity_distribution(t.pairs, ["cluster_id"])
    return d.select("cluster_id", "total", *[F.round(c, 6).alias(c) for c in d.columns[2:]])


@query("f23_similarity_buckets", "SELECT site_id, round(cosine::DECIMAL(10, 6), 2)::DOUBLE AS bucket, count(*) AS n FROM spairs GROUP BY 1, 2", "spairs")
def f23b(t: Tables):
    return pr.similarity_buckets(at_site(t.pairs, "post_a_id"), ["site_id"])


@query("f24_similarity_brackets", """
SELECT site_id, CASE WHEN cosine >= 0.95 THEN 'A: 0.95+ (near-duplicate)' WHEN cosine >= 0.9 THEN 'B: 0.90-0.95 (very high)' WHEN cosine >= 0.8 THEN 'C: 0.80-0.90 (high)' WHEN cosine >= 0.7 THEN 'D: 0.70-0.80 (moderate)' ELSE 'E: below 0.70' END AS bracket, count(*) AS n, round(avg(cosine), 3) AS avg_cosine FROM (SELECT * REPLACE (cosine + 1e-9 AS cosine) FROM spairs) GROUP BY 1, 2
""", "spairs")
def f24(t: Tables):
    # the tiny offset keeps means of three decimals off exact rounding halves
    return pr.similarity_brackets(at_site(t.pairs, "post_a_id").withColumn("cosine", F.col("cosine") + 1e-9), ["site_id"])


@query("f25_pair_listing", """
SELECT post_a_id, post_b_id, severity, a.composite_score AS score_a, b.role AS role_b, x.title AS title_a FROM pairs LEFT JOIN scores a ON a.post_id = post_a_id LEFT JOIN scores b ON b.post_id = post_b_id JOIN posts x ON x.post_id = post_a_id
ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END, cosine DESC, post_a_id, post_b_id LIMIT 100 OFFSET 50
""", "pairs scores posts")
def f25(t: Tables):
    return pr.list_pairs(t.pairs, t.posts, t.scores, 100, 50).select("post_a_id", "post_b_id", "severity", "score_a", "role_b", "title_a")


@query("f26_cannibal_posts", "SELECT site_id, count(DISTINCT p) AS n FROM (SELECT site_id, post_a_id AS p FROM spairs UNION ALL SELECT site_id, post_b_id FROM spairs) GROUP BY 1", "spairs")
def f26(t: Tables):
    return pr.cannibal_posts(at_site(t.pairs, "post_a_id"))


@query("f27_url_fluctuation", """
WITH r AS (SELECT site_id, query, date, arg_max(post_id, (impressions, post_id)) AS url, avg(avg_position) AS position, sum(impressions) AS impressions FROM sgsc GROUP BY 1, 2, 3),
l AS (SELECT *, lag(url) OVER (PARTITION BY site_id, query ORDER BY date) AS p FROM r WHERE date >= DATE '2024-01-31' - 30)
SELECT site_id, query, count(*) FILTER (p IS NOT NULL AND p <> url) AS changes, count(DISTINCT url) AS urls, round(avg(position), 6) AS avg_position, sum(impressions)::BIGINT AS impressions, count(*) FILTER (p IS NOT NULL AND p <> url) >= 3 AS active FROM l GROUP BY 1, 2
""", "sgsc")
def f27(t: Tables):
    ranked = at_site(t.gsc).groupBy("site_id", "query", "date").agg(
        F.max(F.struct("impressions", "post_id")).alias("_b"), F.avg("avg_position").alias("position"), F.sum("impressions").alias("impressions")
    ).select("site_id", "query", "date", F.col("_b.post_id").alias("url"), "position", "impressions")
    return pr.url_fluctuation(ranked, AS_OF).withColumn("avg_position", F.round("avg_position", 6))
