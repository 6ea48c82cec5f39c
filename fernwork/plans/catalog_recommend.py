"""Checks of the recommendation operators (group I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import recommend as rc
from .catalog_clusters import query_vector
from .catalog_problems import known, parts, scanned
from ..operators import problems as pb
from .oracle import cte, query
from .tables import AS_OF, Tables, at_site

A = "DATE '2024-01-31'"


def pick(values: dict, key: str) -> str:
    q = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE"
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {q(v)}" for k, v in values.items()) + " END"


TP = rc.TEMPLATES
cte("cavg", "SELECT post_id, cluster_id, avg(word_count) OVER (PARTITION BY cluster_id) AS a FROM post_clusters JOIN posts USING (post_id)", "post_clusters posts")
cte("irecs", f"""
SELECT *, {pick({k: v[0] for k, v in TP.items()}, 'problem_type')} AS rec_type, {pick({k: v[2] for k, v in TP.items()}, 'problem_type')} AS effort,
  CASE rule WHEN 'words<300' THEN CASE WHEN word_count < 300 THEN 'high' ELSE 'medium' END WHEN 'words<=500' THEN CASE WHEN word_count > 500 THEN 'medium' ELSE 'high' END WHEN 'value<20' THEN CASE WHEN coalesce(value, 0) < 20 THEN 'high' ELSE 'medium' END ELSE rule END AS priority,
  CASE WHEN problem_type IN ({', '.join(f"'{x}'" for x in rc.HIGH_CONFIDENCE)}) THEN 'high' WHEN problem_type IN ({', '.join(f"'{x}'" for x in rc.MEDIUM_CONFIDENCE)}) THEN 'medium' ELSE 'low' END AS confidence,
  {pick({k: v[1] for k, v in TP.items()}, 'problem_type')} || ': ' || left(coalesce(nullif(post_title, ''), 'Untitled'), 80) AS title FROM (
SELECT h.*, p.site_id, p.title AS post_title, p.word_count, {pick({k: v[3] for k, v in TP.items()}, 'h.problem_type')} AS rule FROM hgroup h JOIN hposts p USING (post_id) WHERE p.word_count >= 100 AND p.page_type NOT IN ('landing','index') AND h.problem_type IN ({', '.join(f"'{k}'" for k in TP)}))
""", "hgroup hposts")


def irecs(t: Tables, posts=None):
    posts = scanned(t) if posts is None else posts
    return rc.expand_templates(pb.detect_all(parts(t, posts), known(t), AS_OF), posts, t.post_clusters)


@query("i1_template_recommendations", "SELECT post_id, problem_type, rec_type, priority, effort, title, confidence FROM irecs", "irecs")
def i1(t: Tables):
    return irecs(t).select("post_id", "problem_type", "rec_type", "priority", "effort", "title", "confidence")


cte("multi", "SELECT vec_id AS post_id, label AS cluster_id FROM embeddings UNION ALL SELECT vec_id, (label + 1) % 10 FROM embeddings")


@query("i2_cluster_average", """
WITH a AS (SELECT cluster_id, avg(word_count) AS a FROM multi JOIN posts USING (post_id) GROUP BY 1)
SELECT post_id, cluster_id, round(a, 6) AS cluster_avg FROM multi JOIN posts USING (post_id) JOIN a USING (cluster_id) QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY a DESC, cluster_id) = 1
""", "multi posts")
def i2(t: Tables):
    m = t.post_clusters.unionByName(t.post_clusters.withColumn("cluster_id", (F.col("cluster_id") + 1) % 10))
    return rc.cluster_average(t.posts, m).withColumn("cluster_avg", F.round("cluster_avg", 6))


@query("i3_site_wide", """
WITH tot AS (SELECT site_id, count(*) AS total FROM posts WHERE word_count >= 100 GROUP BY 1), n AS (SELECT site_id, problem_type, count(DISTINCT post_id) AS n FROM irecs GROUP BY 1, 2),
w AS (SELECT * FROM n JOIN tot USING (site_id) WHERE n / total > 0.3),
r AS (SELECT i.*, row_number() OVER (PARTITION BY i.site_id, i.problem_type ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END, post_id) AS rn, w.n, w.total FROM irecs i LEFT JOIN w ON w.site_id = i.site_id AND w.problem_type = i.problem_type)
SELECT post_id, problem_type, priority, effort, title, confidence FROM r WHERE n IS NULL OR rn <= 10
UNION ALL SELECT post_id, problem_type, 'medium', effort * 2, 'Site-wide: ' || n || ' of ' || total || ' posts have ''' || problem_type || '''', 'high' FROM r WHERE n IS NOT NULL AND rn = 1
""", "irecs posts")
def i3(t: Tables):
    posts = scanned(t)
    return rc.aggregate_site_wide(irecs(t, posts), posts).select("post_id", "problem_type", "priority", "effort", "title", "confidence")


@query("i4_title_merge", "SELECT post_id, problem_type_prefix AS title, max(effort) AS effort, count(*) AS merged FROM (SELECT *, split_part(problem_type, '_', 1) AS problem_type_prefix FROM irecs) GROUP BY 1, 2", "irecs")
def i4(t: Tables):
    r = irecs(t).withColumn("title", F.substring_index("problem_type", "_", 1))
    return rc.merge_titles(r).select("post_id", "title", "effort", "merged")


@query("i5_pair_recommendations", """
SELECT post_a_id AS post_id, post_b_id, CASE WHEN resolution = 'differentiate' THEN 'differentiate' ELSE 'merge' END AS rec_type, severity AS priority, CASE resolution WHEN 'redirect' THEN 0.5 WHEN 'merge' THEN 2 ELSE 1.5 END::DOUBLE AS effort,
  CASE resolution WHEN 'redirect' THEN 'Redirect duplicate: ' || left(CASE WHEN stronger_post_id = post_b_id THEN a.title ELSE b.title END, 50) WHEN 'merge' THEN 'Merge overlapping content: ' || left(CASE WHEN stronger_post_id = post_b_id THEN b.title ELSE a.title END, 50) ELSE 'Differentiate competing content: ' || left(a.title, 50) END AS title
FROM pairs JOIN posts a ON a.post_id = post_a_id JOIN posts b ON b.post_id = post_b_id WHERE resolution <> 'monitor' AND a.word_count >= 100 AND b.word_count >= 100 AND a.language = b.language
""", "pairs posts")
def i5(t: Tables):
    return rc.pair_recommendations(t.pairs, t.posts).drop("confidence")


@query("i6_high_similarity_merges", """
WITH RECURSIVE t AS (SELECT * FROM spairs WHERE cosine >= 0.85 QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY cosine DESC, post_a_id, post_b_id) <= 20),
m AS (SELECT post_id FROM recs WHERE rec_type = 'merge'),
o AS (SELECT t.site_id, post_a_id, post_b_id, CASE WHEN a.word_count >= b.word_count THEN post_b_id ELSE post_a_id END AS post_id, CASE WHEN a.word_count >= b.word_count THEN post_a_id ELSE post_b_id END AS primary_id, cosine, row_number() OVER (ORDER BY cosine DESC, post_a_id, post_b_id) AS i
  FROM t JOIN posts a ON a.post_id = post_a_id JOIN posts b ON b.post_id = post_b_id WHERE post_a_id NOT IN (FROM m) AND post_b_id NOT IN (FROM m)),
s AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS marks, false AS ok UNION ALL SELECT i, CASE WHEN hit THEN marks ELSE list_append(marks, post_id) END, NOT hit FROM (SELECT o.i, o.post_id, s.marks, list_contains(s.marks, post_a_id) OR list_contains(s.marks, post_b_id) AS hit FROM s JOIN o ON o.i = s.i + 1))
SELECT site_id, post_id, primary_id, cosine, CASE WHEN cosine >= 0.99 THEN 'redirect' ELSE 'merge' END AS action FROM o JOIN s USING (i) WHERE ok
""", "spairs posts recs")
def i6(t: Tables):
    return rc.high_similarity_merges(at_site(t.pairs, "post_a_id"), t.posts, t.recs, 0.85, 20)


@query("i7_merge_dedup", "SELECT rec_id, post_id FROM recs WHERE NOT (rec_type = 'merge' AND status = 'pending') UNION ALL SELECT min(rec_id), post_id FROM recs WHERE rec_type = 'merge' AND status = 'pending' GROUP BY post_id", "recs")
def i7(t: Tables):
    return rc.dedup_merges(t.recs).select("rec_id", "post_id")


@query("i8_priority_rescoring", """
SELECT rec_id, CASE WHEN (rn - 1) / n < 0.1 THEN 'critical' WHEN (rn - 1) / n < 0.3 THEN 'high' ELSE priority END AS priority FROM (SELECT rec_id, priority, row_number() OVER (PARTITION BY r.site_id ORDER BY coalesce(pagerank, 0) DESC, rec_id) AS rn, count(*) OVER (PARTITION BY r.site_id) AS n FROM srecs r LEFT JOIN scores USING (post_id) WHERE status = 'pending')
""", "srecs scores")
def i8(t: Tables):
    return rc.rescore_priorities(at_site(t.recs), t.scores).select("rec_id", "priority")


@query("i9_recalibration", """
WITH near AS (SELECT post_a_id AS p FROM pairs WHERE cosine >= 0.95 UNION SELECT post_b_id FROM pairs WHERE cosine >= 0.95),
r AS (SELECT recs.* REPLACE (CASE WHEN rec_type = 'growth' THEN 'expand' ELSE rec_type END AS rec_type), word_count, content_intent FROM recs LEFT JOIN posts USING (post_id)),
s AS (SELECT *, CASE WHEN (rec_type = 'merge' AND post_id IN (FROM near)) OR (rec_type = 'expand' AND word_count < 200) THEN 'critical' ELSE priority END AS p1 FROM r),
u AS (SELECT *, CASE WHEN p1 <> 'critical' AND (rec_type IN ('merge','differentiate','interlink') OR (rec_type = 'expand' AND word_count < 500)) THEN 'high' ELSE p1 END AS p2 FROM s),
v AS (SELECT *, CASE WHEN p2 NOT IN ('critical','high') AND rec_type = 'optimize' AND content_intent IN ('commercial','transactional') THEN 'high' ELSE p2 END AS p3 FROM u)
SELECT rec_id, CASE WHEN p3 = 'low' AND rec_type = 'optimize' AND post_id IN (SELECT post_id FROM problems WHERE problem_type = 'readability_low') THEN 'medium' ELSE p3 END AS priority FROM v
""", "pairs recs posts problems")
def i9(t: Tables):
    recs = t.recs.withColumn("rec_type", F.when(F.col("rec_type") == "growth", "expand").otherwise(F.col("rec_type")))
    prob = t.problems.withColumn("problem_type", F.when(F.col("problem_type") == "readability_low", "readability_too_complex").otherwise(F.col("problem_type")))
    return rc.recalibrate(recs, t.pairs, t.posts, prob).select("rec_id", "priority")


@query("i10_growth_links", """
SELECT a AS post_id, b AS neighbour_id, round(sim, 6) AS similarity, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM sims WHERE a % 5 = b % 5 AND ca <> cb AND a NOT IN (SELECT post_id FROM recs WHERE status = 'completed')) WHERE rank <= 3
""", "sims recs")
def i10(t: Tables):
    return rc.growth_links(at_site(t.embeddings), t.recs.filter("status = 'completed'")).drop("site_id").withColumn("similarity", F.round("similarity", 6))


@query("i11_growth_pillars", "SELECT site_id, post_id, composite_score FROM (SELECT * FROM sscores WHERE role = 'pillar' QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY composite_score DESC, post_id) <= 8) WHERE post_id NOT IN (SELECT post_id FROM recs WHERE rec_type = 'growth' AND status = 'pending')", "sscores recs")
def i11(t: Tables):
    return rc.growth_pillars(at_site(t.scores), t.recs, 8).select("site_id", "post_id", "composite_score")


@query("i12_query_summary", f"SELECT post_id, query, sum(clicks)::BIGINT AS clicks, round(avg(avg_position), 6) AS position FROM gsc WHERE date >= {A} - 90 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY sum(clicks) DESC, query) <= 10", "gsc")
def i12(t: Tables):
    return rc.query_summary(t.gsc, AS_OF).drop("rank").withColumn("position", F.round("position", 6))


PRANK = "CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"


@query("i13_shortlist", f"""
WITH c AS (SELECT *, {PRANK} AS p FROM srecs WHERE status = 'pending' QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY {PRANK}, created_at DESC, rec_id) <= 30), k AS (SELECT *, row_number() OVER (PARTITION BY site_id, rec_type ORDER BY p, created_at DESC, rec_id) > 3 AS late FROM c)
SELECT site_id, rec_id, rec_type, priority FROM k QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY late, p, created_at DESC, rec_id) <= 10
""", "srecs")
def i13(t: Tables):
    return rc.shortlist(at_site(t.recs), 10).select("site_id", "rec_id", "rec_type", "priority")


cte("plans", f"""
WITH m AS (SELECT c.cluster_id, c.label, pc.post_id, url, word_count AS w, composite_score AS s, role, row_number() OVER (PARTITION BY c.cluster_id ORDER BY composite_score DESC, pc.post_id) AS rn FROM cstates c JOIN post_clusters pc USING (cluster_id) JOIN posts p ON p.post_id = pc.post_id JOIN scores x ON x.post_id = pc.post_id WHERE ecosystem_state = 'swamp'),
p AS (SELECT * FROM m WHERE rn = 1), v AS (SELECT post_id, sum(pageviews) AS pv FROM ga4 WHERE date >= {A} - 90 GROUP BY 1),
r AS (SELECT cluster_id, sum(pv) AS pv FROM (SELECT DISTINCT pairs.cluster_id, CASE WHEN post_a_id = p.post_id THEN post_b_id ELSE post_a_id END AS post_id FROM pairs JOIN p ON p.cluster_id = pairs.cluster_id) JOIN v USING (post_id) GROUP BY 1),
c AS (SELECT cluster_id, count(*) FILTER (rn > 1 AND NOT (s < 15 OR role = 'dead_weight')) AS mc, count(*) FILTER (rn > 1 AND (s < 15 OR role = 'dead_weight')) AS dw, coalesce(sum(w) FILTER (rn > 1 AND NOT (s < 15 OR role = 'dead_weight')), 0) AS words FROM m GROUP BY 1)
SELECT p.cluster_id, p.label, p.post_id AS pillar_id, mc AS merge_candidates, dw AS dead_weight, floor(coalesce(pv, 0) * 0.35)::BIGINT AS traffic_recovery, greatest(1.0, words / 1000)::DOUBLE AS effort, floor(coalesce(pv, 0) * 0.35) / greatest(1.0, words / 1000) AS priority_score
FROM p JOIN c USING (cluster_id) LEFT JOIN r USING (cluster_id)
""", "cstates post_clusters posts scores ga4 pairs")


def plans(t: Tables):
    return rc.consolidation_plans(t.cluster_states, t.post_clusters, t.posts, t.scores, t.pairs, t.ga4, AS_OF)


@query("i14_consolidation_plans", "SELECT * REPLACE (round(effort, 6) AS effort, round(priority_score, 6) AS priority_score), row_number() OVER (ORDER BY priority_score DESC, cluster_id) = 1 AS is_quick_win FROM plans", "plans")
def i14(t: Tables):
    return rc.mark_quick_win(plans(t)).withColumns({"effort": F.round("effort", 6), "priority_score": F.round("priority_score", 6)})


@query("i15_redirect_map", "SELECT pl.cluster_id, o.url AS old_url, n.url AS new_url FROM plans pl JOIN post_clusters m ON m.cluster_id = pl.cluster_id AND m.post_id <> pillar_id JOIN posts o ON o.post_id = m.post_id JOIN posts n ON n.post_id = pillar_id", "plans post_clusters posts")
def i15(t: Tables):
    return rc.redirect_map(plans(t), t.post_clusters, t.posts)


cte("advice", """
WITH g AS (SELECT DISTINCT c.cluster_id, query FROM gsc JOIN post_clusters USING (post_id) JOIN cstates c USING (cluster_id) WHERE (ecosystem_state = 'desert' AND impressions > 1 AND clicks < 1) OR (ecosystem_state = 'meadow' AND impressions > 1 AND clicks < 1)),
w AS (SELECT cluster_id, string_agg(query, ',' ORDER BY query) AS keywords FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY query) <= 5) GROUP BY 1),
k AS (SELECT cluster_id, avg(clicks) AS k FROM gsc JOIN post_clusters USING (post_id) GROUP BY 1), n AS (SELECT cluster_id, count(*) AS n FROM pairs GROUP BY 1)
SELECT c.cluster_id, label, ecosystem_state, CASE ecosystem_state WHEN 'forest' THEN 'maintain' WHEN 'swamp' THEN 'pause' WHEN 'desert' THEN 'revive' ELSE 'grow' END AS advice, CASE WHEN ecosystem_state = 'swamp' THEN greatest(1, ceil(coalesce(n, 0) / greatest(post_count, 1) * 6))::BIGINT END AS pause_months,
  CASE ecosystem_state WHEN 'swamp' THEN greatest(2, least(post_count // 3, 5)) WHEN 'desert' THEN greatest(1, least(post_count // 2, 3)) WHEN 'seedbed' THEN CASE WHEN coalesce(k, 0) > 2 THEN 6 ELSE 8 END WHEN 'forest' THEN 1 ELSE greatest(1, least(post_count, 3)) END::BIGINT AS amount, keywords
FROM cstates c LEFT JOIN w USING (cluster_id) LEFT JOIN k USING (cluster_id) LEFT JOIN n USING (cluster_id)
""", "gsc post_clusters cstates pairs")


def advice(t: Tables):
    return rc.calendar_advice(t.cluster_states, t.post_clusters, t.gsc, t.pairs, (1, 1), (1, 1))


@query("i16_calendar_advice", "SELECT * FROM advice", "advice")
def i16(t: Tables):
    return advice(t)


@query("i17_calendar_summary", "SELECT advice, count(*) AS clusters, min(CASE advice WHEN 'pause' THEN 1 WHEN 'revive' THEN 2 WHEN 'grow' THEN 3 ELSE 4 END)::INTEGER AS position FROM advice GROUP BY 1", "advice")
def i17(t: Tables):
    return rc.calendar_summary(advice(t))


cte("gaps", f"SELECT site_id, query, sum(impressions)::BIGINT AS impressions, sum(clicks)::BIGINT AS clicks, avg(avg_position) AS avg_position FROM sgsc WHERE date >= {A} - 90 GROUP BY 1, 2 HAVING sum(impressions) >= 10 AND sum(clicks) / sum(impressions) < 0.2 AND avg(avg_position) BETWEEN 5 AND 60", "sgsc")
cte("near_centre", """
WITH c AS (SELECT site_id, cluster_id, list(m ORDER BY i) AS v FROM (SELECT post_id % 5 AS site_id, cluster_id, i, avg(x) AS m FROM (SELECT post_id, cluster_id, unnest(vec) AS x, unnest(range(len(vec))) AS i FROM emb) GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT c.site_id, c.cluster_id, max(list_cosine_similarity(e.vec, c.v)) AS similarity FROM c JOIN emb e ON e.post_id % 5 = c.site_id GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY c.site_id ORDER BY similarity DESC, c.cluster_id) = 1
""", "emb")


def gaps(t: Tables):
    return rc.content_gaps(at_site(t.gsc), AS_OF, least=10, ctr=0.2, high=60)


@query("i18_content_gaps", """
SELECT site_id, query, impressions, clicks, round(avg_position, 6) AS avg_position, cluster_id::BIGINT AS cluster_id, round(similarity, 6) AS similarity, CASE WHEN coalesce(similarity, 0) < 0.3 THEN 'missing' ELSE 'weak' END AS gap_type FROM gaps LEFT JOIN near_centre USING (site_id)
""", "gaps near_centre")
def i18(t: Tables):
    g = rc.gap_type(rc.closest_cluster(gaps(t), at_site(t.embeddings)))
    return g.withColumns({"avg_position": F.round("avg_position", 6), "similarity": F.round("similarity", 6)})


@query("i19_top_gap", "SELECT site_id, query, impressions, label FROM (SELECT * FROM gaps QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY impressions DESC, query) = 1) LEFT JOIN near_centre USING (site_id) LEFT JOIN clusters USING (cluster_id)", "gaps near_centre clusters")
def i19(t: Tables):
    g = rc.closest_cluster(gaps(t), at_site(t.embeddings)).withColumn("status", F.lit("open"))
    return rc.top_gap(g, t.clusters).select("site_id", "query", "impressions", "label")


@query("i20_secondary_keywords", "SELECT site_id, query, sum(impressions)::BIGINT AS impressions FROM sgsc WHERE query ILIKE '%q1%' AND query <> 'q1' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY sum(impressions) DESC, query) <= 6", "sgsc")
def i20(t: Tables):
    return rc.secondary_keywords(at_site(t.gsc), "Q1", AS_OF, 6)


@query("i21_keyword_rankings", "SELECT g.site_id, g.post_id, query, title, round(avg(avg_position), 6) AS avg_position, sum(clicks)::BIGINT AS clicks FROM sgsc g JOIN posts p ON p.post_id = g.post_id WHERE query ILIKE '%q2%' GROUP BY 1, 2, 3, 4 QUALIFY row_number() OVER (PARTITION BY g.site_id ORDER BY sum(clicks) DESC, g.post_id, query) <= 5", "sgsc posts")
def i21(t: Tables):
    return rc.keyword_rankings(at_site(t.gsc), t.posts, "q2", AS_OF).withColumn("avg_position", F.round("avg_position", 6))


cte("near0", "SELECT post_id, list_cosine_similarity(vec, (SELECT vec FROM emb WHERE post_id = 0)) AS similarity FROM emb", "emb")


@query("i22_draft_lookup", """
WITH n AS (SELECT * FROM near0 ORDER BY similarity DESC, post_id LIMIT 20), k AS (SELECT post_id, avg(avg_position) AS p, sum(clicks)::BIGINT AS clicks FROM gsc WHERE query ILIKE '%q3%' GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 20)
SELECT post_id, round(similarity, 6) AS similarity, clicks, round(p, 6) AS avg_position, CASE WHEN similarity IS NULL THEN 'keyword' WHEN clicks IS NULL THEN 'embedding' ELSE 'both' END AS source FROM n FULL JOIN k USING (post_id)
""", "near0 gsc")
def i22(t: Tables):
    return rc.draft_lookup(t.embeddings, query_vector(t), t.gsc, "q3").select(
        "post_id", F.round("similarity", 6).alias("similarity"), "clicks", F.round("avg_position", 6).alias("avg_position"), "source"
    )


@query("i23_overlap_risk", "SELECT round(max(similarity), 6) AS max_similarity, CASE WHEN max(similarity) >= 0.8 THEN 'high' WHEN max(similarity) >= 0.5 THEN 'medium' ELSE 'low' END AS risk FROM near0 WHERE post_id <> 0", "near0")
def i23(t: Tables):
    return rc.overlap_risk(t.embeddings.filter("post_id <> 0"), query_vector(t)).withColumn("max_similarity", F.round("max_similarity", 6))


@query("i24_link_candidates", "SELECT post_id, round(similarity, 6) AS similarity, composite_score, CASE WHEN pagerank > 0.5 THEN 'from' ELSE 'to' END AS direction FROM (SELECT * FROM near0 ORDER BY similarity DESC, post_id LIMIT 8) JOIN scores USING (post_id)", "near0 scores")
def i24(t: Tables):
    return rc.link_candidates(t.embeddings, query_vector(t), t.scores).select("post_id", F.round("similarity", 6).alias("similarity"), "composite_score", "direction")


@query("i25_cluster_peers", "SELECT cluster_id, post_id, composite_score, row_number() OVER w AS rank, count(*) OVER (PARTITION BY cluster_id) AS posts, round(avg(composite_score) OVER (PARTITION BY cluster_id), 6) AS avg_score FROM scores WINDOW w AS (PARTITION BY cluster_id ORDER BY composite_score DESC, post_id) QUALIFY row_number() OVER w <= 5", "scores")
def i25(t: Tables):
    p = rc.cluster_peers(t.post_clusters, t.scores)
    return p.select("cluster_id", "post_id", "composite_score", F.col("rank").cast("bigint").alias("rank"), "posts", F.round("avg_score", 6).alias("avg_score"))


@query("i26_counterparts", "SELECT post_a_id AS post_id, post_b_id AS other_id, cosine, severity FROM pairs UNION ALL SELECT post_b_id, post_a_id, cosine, severity FROM pairs", "pairs")
def i26(t: Tables):
    return rc.counterparts(t.pairs)


@query("i27_recommendation_listing", f"SELECT rec_id, priority, rec_type FROM recs WHERE status = 'pending' ORDER BY {PRANK}, created_at DESC, rec_id LIMIT 100 OFFSET 10", "recs")
def i27(t: Tables):
    return rc.list_recommendations(t.recs, status="pending", offset=10).select("rec_id", "priority", "rec_type")


@query("i27_recommendation_counts", "SELECT rec_type, NULL AS priority, count(*) AS n FROM recs GROUP BY 1 UNION ALL SELECT NULL, priority, count(*) FROM recs GROUP BY priority", "recs")
def i27b(t: Tables):
    return rc.recommendation_counts(t.recs)
