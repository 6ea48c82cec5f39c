"""Checks of the dashboard operators (group K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dashboards as db
from ..operators import problems as pb
from ..operators import scoring as sc
from .catalog_recommend import gaps
from .catalog_tracking import redirects
from .oracle import cte, query
from .tables import AS_OF, Tables, at_site

A = "DATE '2024-01-31'"
PM = "SELECT site_id, post_a_id AS p FROM spairs UNION SELECT site_id, post_b_id FROM spairs"
PN = f"(SELECT site_id, count(*) AS n FROM ({PM}) GROUP BY 1)"
LEAF = "cluster_id NOT IN (SELECT parent_cluster_id FROM clusters WHERE parent_cluster_id IS NOT NULL)"


def spairs(t: Tables):
    return at_site(t.pairs, "post_a_id")


@query("k1_site_health", f"""
WITH p AS (SELECT site_id, count(*) AS total_posts, round_even(avg((modified_date IS NOT NULL)::INT), 3) AS modified_coverage FROM sposts GROUP BY 1),
s AS (SELECT site_id, round(avg(composite_score), 6) AS health, count(*) FILTER (role IN ('pillar','supporter')) AS active_posts, count(*) FILTER (role = 'dead_weight') AS dead_posts FROM sscores GROUP BY 1),
g AS (SELECT site_id, coalesce(sum(pageviews) FILTER (date >= {A} - 30), 0)::BIGINT AS traffic_30d, coalesce(sum(pageviews) FILTER (date >= {A} - 60), 0)::BIGINT AS traffic_60d, coalesce(sum(pageviews) FILTER (date >= {A} - 90), 0)::BIGINT AS traffic_90d FROM sga4 GROUP BY 1)
SELECT site_id, total_posts, modified_coverage, coalesce(health, 0) AS health, coalesce(active_posts, 0) AS active_posts, coalesce(dead_posts, 0) AS dead_posts, coalesce(traffic_30d, 0) AS traffic_30d, coalesce(traffic_60d, 0) AS traffic_60d, coalesce(traffic_90d, 0) AS traffic_90d, coalesce(n, 0) AS cannibalistic_posts,
  greatest(0, total_posts - coalesce(active_posts, 0) - coalesce(dead_posts, 0)) AS passive_posts, round_even(coalesce(active_posts, 0) / total_posts * 100, 1) AS efficiency, 0.4::DOUBLE + CASE WHEN g.site_id IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN site_id IN (SELECT site_id FROM sgsc) THEN 0.3 ELSE 0 END AS completeness
FROM p LEFT JOIN s USING (site_id) LEFT JOIN g USING (site_id) LEFT JOIN {PN} x USING (site_id)
""", "sposts sscores sga4 sgsc spairs")
def k1(t: Tables):
    return db.site_health(at_site(t.posts), at_site(t.scores), spairs(t), at_site(t.ga4), at_site(t.gsc), AS_OF)


@query("k2_cluster_list", f"SELECT cluster_id, post_count, round(avg(vec[1]), 6) AS x, round(avg(vec[2]), 6) AS y FROM clusters JOIN emb USING (cluster_id) WHERE {LEAF} GROUP BY 1, 2", "clusters emb")
def k2(t: Tables):
    m = t.embeddings.select("cluster_id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))
    return db.cluster_list(t.clusters, m).select("cluster_id", "post_count", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("k2_cluster_detail", "SELECT s.post_id, title, composite_score, role FROM scores s JOIN posts USING (post_id) WHERE cluster_id = 3", "scores posts")
def k2b(t: Tables):
    return db.cluster_detail(t.post_clusters, t.posts, t.scores, 3).select("post_id", "title", "composite_score", "role")


@query("k3_post_listing", "SELECT post_id, publish_date FROM posts ORDER BY publish_date DESC NULLS LAST, post_id LIMIT 100 OFFSET 25", "posts")
def k3(t: Tables):
    return db.post_listing(t.posts, 100, 25).select("post_id", "publish_date")


@query("k4_post_health", "SELECT s.post_id, composite_score, role, least(cluster_id, (cluster_id + 1) % 10) AS cluster_id, 'cluster ' || least(cluster_id, (cluster_id + 1) % 10) AS cluster_label FROM scores s JOIN posts p USING (post_id)", "scores posts")
def k4(t: Tables):
    m = t.post_clusters.unionByName(t.post_clusters.withColumn("cluster_id", (F.col("cluster_id") + 1) % 10))
    return db.post_health(t.posts, t.scores, m, t.clusters).select("post_id", "composite_score", "role", "cluster_id", "cluster_label")


@query("k5_post_details", """
SELECT p.post_id, least(coalesce(a.n, 0), 20) AS ga4_rows, least(coalesce(b.n, 0), 50) AS gsc_rows, a.newest, CASE WHEN freshness_score IS NOT NULL THEN round_even(least(100, greatest(0, freshness_score)), 1) END AS freshness, CASE WHEN pagerank IS NOT NULL THEN round_even(least(100, greatest(0, pagerank * 100)), 1) END AS links
FROM posts p LEFT JOIN scores s ON s.post_id = p.post_id LEFT JOIN (SELECT post_id, count(*) AS n, max(date) AS newest FROM ga4 GROUP BY 1) a ON a.post_id = p.post_id LEFT JOIN (SELECT post_id, count(*) AS n FROM gsc GROUP BY 1) b ON b.post_id = p.post_id
""", "posts scores ga4 gsc")
def k5(t: Tables):
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    d = db.post_details(t.posts, t.scores, t.ga4, t.gsc, 20, 50)
    return d.select("post_id", size("ga4").alias("ga4_rows"), size("gsc").alias("gsc_rows"), F.try_element_at("ga4", F.lit(1))["date"].alias("newest"), "freshness", "links")


@query("k6_overview", """
WITH p AS (SELECT site_id, count(*) AS total_posts FROM sposts GROUP BY 1), g AS (SELECT site_id, sum(pageviews)::BIGINT AS pageviews, sum(sessions)::BIGINT AS sessions, min(date) AS date_start, max(date) AS date_end FROM sga4 GROUP BY 1),
q AS (SELECT site_id, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions, round(avg(avg_position), 6) AS avg_position FROM sgsc GROUP BY 1)
SELECT * FROM p JOIN g USING (site_id) JOIN q USING (site_id)
""", "sposts sga4 sgsc")
def k6(t: Tables):
    return db.overview(at_site(t.posts), at_site(t.ga4), at_site(t.gsc)).withColumn("avg_position", F.round("avg_position", 6))


cte("audit", f"""
SELECT site_id, count(*) AS total_posts, round(count(*) FILTER (coalesce(meta_description, '') <> '') * 100.0::DOUBLE / count(*), 1) AS meta_pct, count(*) FILTER (coalesce(meta_description, '') = '') AS meta_missing, (SELECT avg(composite_score) FROM sscores x WHERE x.site_id = p.site_id) AS overall_health,
  (SELECT count(*) FROM sclusters x WHERE x.site_id = p.site_id AND {LEAF}) AS cluster_count, (SELECT count(*) FROM sproblems x WHERE x.site_id = p.site_id) AS problem_count, (SELECT count(*) FROM sproblems x WHERE x.site_id = p.site_id AND problem_type LIKE 'orphan%') AS orphan_count, (SELECT count(*) FROM sproblems x WHERE x.site_id = p.site_id AND problem_type = 'thin_content') AS thin_count,
  (SELECT count(*) FROM srecs x WHERE x.site_id = p.site_id) AS rec_count, (SELECT count(*) FROM spairs x WHERE x.site_id = p.site_id) AS pair_count, (SELECT count(*) FROM spairs x WHERE x.site_id = p.site_id AND cosine >= 0.99) AS exact_pairs, (SELECT count(*) FROM ({PM}) x WHERE x.site_id = p.site_id) AS pair_posts
FROM sposts p GROUP BY site_id
""", "sposts sscores sclusters clusters sproblems srecs spairs")
cte("aud", "SELECT a.*, ai_cite, ai_ready_pct, ai_schema_pct, ai_eeat FROM audit a JOIN (SELECT site_id, avg(ai_citability_score) AS ai_cite, round(count(*) FILTER (ai_citability_score >= 60) / count(ai_citability_score) * 100, 1) AS ai_ready_pct, round(count(*) FILTER (schema_score > 80) / count(*) * 100, 1) AS ai_schema_pct, avg(eeat_score) AS ai_eeat FROM sscores GROUP BY 1) USING (site_id)", "audit sscores")


def audit(t: Tables):
    return db.audit_counters(at_site(t.posts), at_site(t.scores), at_site(t.clusters, "cluster_id"), at_site(t.problems), at_site(t.recs), spairs(t))


def audit_ai(t: Tables):
    c = F.col("ai_citability_score")
    ai = at_site(t.scores).groupBy("site_id").agg(
        F.avg(c).alias("ai_cite"), F.round(F.count_if(c >= 60) / F.count(c) * 100, 1).alias("ai_ready_pct"),
        F.round(F.count_if(F.col("schema_score") > 80) / F.count("*") * 100, 1).alias("ai_schema_pct"), F.avg("eeat_score").alias("ai_eeat"),
    )
    return audit(t).join(ai, "site_id")


@query("k7_audit_counters", "SELECT * REPLACE (round(overall_health, 6) AS overall_health) FROM audit", "audit")
def k7(t: Tables):
    return audit(t).withColumn("overall_health", F.round("overall_health", 6))


@query("k8_top_lists", f"""
SELECT site_id, 'cluster' AS kind, label AS name, post_count::DOUBLE AS value FROM sclusters WHERE {LEAF} QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY post_count DESC, cluster_id) <= 8
UNION ALL SELECT site_id, 'pair', post_a_id || '-' || post_b_id, cosine FROM spairs QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY cosine DESC, post_a_id, post_b_id) <= 8
UNION ALL SELECT site_id, 'recommendation', title, rec_id::DOUBLE FROM srecs QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, rec_id) <= 8
""", "sclusters clusters spairs srecs")
def k8(t: Tables):
    return db.top_lists(at_site(t.clusters, "cluster_id"), spairs(t), at_site(t.recs))


@query("k9_worst_posts", f"""
SELECT post_id % 5 AS site_id, post_id, word_count, composite_score, role, coalesce(issues, 'low health score') AS issues, weight FROM (SELECT post_id, word_count, composite_score, role, issues, weight FROM posts JOIN scores USING (post_id) LEFT JOIN (SELECT post_id, string_agg(DISTINCT problem_type, ', ' ORDER BY problem_type) AS issues,
  sum(CASE problem_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in pb.WEIGHTS.items())} ELSE 50 END)::BIGINT AS weight FROM problems GROUP BY 1) USING (post_id) WHERE word_count >= 200) QUALIFY row_number() OVER (PARTITION BY post_id % 5 ORDER BY issues IS NULL, coalesce(weight, 0) DESC, composite_score, post_id) <= 12
""", "posts scores problems")
def k9(t: Tables):
    return db.worst_posts(at_site(t.posts), t.scores, t.problems, 12)


@query("k10_best_pillars", "SELECT site_id, post_id, composite_score FROM sscores WHERE role = 'pillar' QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY composite_score DESC, post_id) <= 5", "sscores")
def k10(t: Tables):
    return db.best_pillars(at_site(t.scores)).select("site_id", "post_id", "composite_score")


@query("k11_content_profile", f"""
SELECT site_id, round(avg(word_count), 0) AS avg_words, round(avg(fre), 1) AS avg_reading_ease, count(*) FILTER (modified_date > {A} - INTERVAL 6 MONTH) AS updated_6m, count(*) FILTER (modified_date > {A} - INTERVAL 12 MONTH) AS updated_12m, count(*) FILTER (modified_date > {A} - INTERVAL 24 MONTH) AS updated_24m,
  count(*) FILTER (modified_date IS NULL OR modified_date <= {A} - INTERVAL 24 MONTH) AS stale FROM posts JOIN (SELECT post_id, fre FROM readable) USING (post_id) WHERE word_count > 50 GROUP BY 1
""", "posts readable")
def k11(t: Tables):
    return db.content_profile(sc.readability(t.posts), AS_OF)


@query("k12_key_findings", """
SELECT site_id, array_to_string(list_filter([CASE WHEN pair_count > 0 THEN pair_posts || ' of ' || total_posts || ' posts overlap in ' || pair_count || ' pairs' END, CASE WHEN exact_pairs > 0 THEN exact_pairs || ' near-exact duplicate pairs' END, CASE WHEN orphan_count > 0 THEN orphan_count || ' orphan posts' END,
  CASE WHEN thin_count > 0 THEN thin_count || ' thin posts' END, CASE WHEN overall_health < 40 THEN 'health ' || round_even(overall_health, 0)::INT || '/100 needs work' END, CASE WHEN overall_health >= 65 THEN 'health ' || round_even(overall_health, 0)::INT || '/100 is above average' END,
  CASE WHEN ai_cite < 40 THEN 'only ' || format('{:.1f}', ai_ready_pct) || '% of posts are citable' END, CASE WHEN ai_schema_pct < 30 THEN format('{:.0f}', 100 - ai_schema_pct) || '% of posts lack structured data' END], lambda x: x IS NOT NULL), '; ') AS findings,
  CASE WHEN pair_count >= 50 THEN pair_posts || ' of ' || total_posts || ' posts overlap' WHEN rec_count >= 100 THEN rec_count || ' recommendations across ' || total_posts || ' posts' ELSE total_posts || ' posts across ' || cluster_count || ' topics' END AS headline FROM aud
""", "aud")
def k12(t: Tables):
    return db.key_findings(audit_ai(t))


@query("k13_platform_totals", "SELECT (SELECT count(DISTINCT site_id) FROM posts) AS sites, (SELECT count(*) FROM posts) AS posts, (SELECT count(*) FROM pairs) AS pairs", "posts pairs")
def k13(t: Tables):
    return db.platform_totals(t.posts.select("site_id").distinct(), t.posts, t.pairs)


STAGE = "['discovered','auditing','audited','contacted','responded','converted'][c_custkey % 6 + 1]"


@query("k14_prospect_funnel", "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (s = '{x}') AS {x}" for x in db.PROSPECT_STAGES) + f", count(*) FILTER (c_acctbal > 0) AS with_email FROM (SELECT *, {STAGE} AS s FROM customer)")
def k14(t: Tables):
    status = F.element_at(F.array(*map(F.lit, db.PROSPECT_STAGES)), (F.col("c_custkey") % 6 + 1).cast("int"))
    return db.prospect_funnel(t.raw("customer").select(status.alias("status"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("contact_email")))


@query("k15_cluster_age", f"""
SELECT cluster_id, CASE WHEN a < 90 THEN 'fresh' WHEN a < 365 THEN 'maintained' WHEN a < 730 THEN 'overgrown' ELSE 'dead' END AS state, round_even(a, 0)::BIGINT AS avg_days, o AS oldest_days, n AS newest_days FROM (SELECT cluster_id, avg(d) AS a, max(d)::INTEGER AS o, min(d)::INTEGER AS n FROM (SELECT cluster_id, date_diff('day', coalesce(modified_date, publish_date), {A}) AS d FROM post_clusters JOIN posts USING (post_id)) GROUP BY 1)
""", "post_clusters posts")
def k15(t: Tables):
    return db.cluster_age(t.post_clusters, t.posts, AS_OF)


@query("k16_cluster_traffic", f"""
SELECT cluster_id, CASE WHEN p = 0 AND r = 0 THEN 'fog' WHEN p = 0 THEN 'sunny' WHEN (r - p) / p * 100 > 20 THEN 'sunny' WHEN (r - p) / p * 100 > -5 THEN 'cloudy' WHEN (r - p) / p * 100 > -25 THEN 'rain' ELSE 'storm' END AS state, r AS recent, round_even(p, 0)::BIGINT AS prior, CASE WHEN p > 0 THEN round_even((r - p) / p * 100, 1) END AS change_pct
FROM (SELECT cluster_id, coalesce(sum(clicks) FILTER (date >= {A} - 10), 0)::BIGINT AS r, coalesce(sum(clicks) FILTER (date < {A} - 10 AND date >= {A} - 30), 0) / 2 AS p FROM post_clusters LEFT JOIN gsc USING (post_id) GROUP BY 1)
""", "post_clusters gsc")
def k16(t: Tables):
    return db.cluster_traffic(t.post_clusters, t.gsc, AS_OF, 10)


@query("k17_behaviour_markers", """
WITH g AS (SELECT cluster_id, avg(ctr) AS c, avg(impressions) AS i FROM post_clusters JOIN gsc USING (post_id) GROUP BY 1), v AS (SELECT cluster_id, avg(bounce_rate) AS b, avg(avg_time) AS s FROM post_clusters JOIN ga4 USING (post_id) GROUP BY 1), f AS (SELECT cluster_id, count(*) AS n FROM scores WHERE trend = 'declining' GROUP BY 1)
SELECT cluster_id, 'birds' AS marker, greatest(1, least(floor((0.21 - c) * 200), 5))::BIGINT AS count FROM g WHERE c < 0.21 AND i > 1
UNION ALL SELECT cluster_id, 'foxes', greatest(1, least(floor((b - 0.1) * 10), 3))::BIGINT FROM v WHERE b > 0.1 UNION ALL SELECT cluster_id, 'deer', greatest(1, least(floor(s / 120), 3))::BIGINT FROM v WHERE s > 50
UNION ALL SELECT cluster_id, 'bees', 2 FROM g WHERE c > 0.2 AND i > 1 UNION ALL SELECT cluster_id, 'vultures', least(n, 3) FROM f WHERE n >= 2
""", "post_clusters gsc ga4 scores")
def k17(t: Tables):
    return db.behaviour_markers(t.post_clusters, t.gsc, t.ga4, t.scores, 0.21, 1, 0.1, 50, 0.2, 1)


@query("k18_structure_markers", """
SELECT cluster_id, 'boulders' AS marker, least(count(*), 5) AS count FROM post_clusters JOIN links ON source_post_id = post_id WHERE target_post_id IS NULL GROUP BY 1
UNION ALL SELECT cluster_id, 'erosion', count(*) FROM post_clusters JOIN posts USING (post_id) WHERE word_count < 500 GROUP BY 1 UNION ALL SELECT cluster_id, 'mushrooms', least(count(*) * 2, 6) FROM pairs WHERE cosine > 0.8 GROUP BY 1
""", "post_clusters links posts pairs")
def k18(t: Tables):
    links = t.links.withColumn("status_code", F.when(F.col("target_post_id").isNull(), 404).otherwise(200))
    return db.structure_markers(t.post_clusters, links, t.posts, t.pairs.withColumn("overlap_score", F.col("cosine")))


def _half(n: int) -> str:
    f = f"FILTER (cluster_id % 2 = {n})"
    return f"SELECT round(avg(ai_citability_score) {f}, 1) AS c, round(avg(eeat_score) {f}, 1) AS e, round(avg(schema_score) {f}, 1) AS s, round(avg(extraction_score) {f}, 1) AS x, round((count(*) FILTER (cluster_id % 2 = {n} AND ai_citability_score >= 60)) / (count(*) {f}) * 100, 1) AS r FROM scores WHERE ai_citability_score IS NOT NULL"


@query("k19_competitor_benchmark", f"""
SELECT o.c AS citability_own, o.e AS eeat_own, o.s AS schema_own, o.x AS extraction_own, o.r AS ready_own, t.c AS citability_other, t.e AS eeat_other, t.s AS schema_other, t.x AS extraction_other, t.r AS ready_other,
  round_even(t.c - o.c, 1) AS citability_gap, round_even(t.e - o.e, 1) AS eeat_gap, round_even(t.s - o.s, 1) AS schema_gap, round_even(t.x - o.x, 1) AS extraction_gap,
  CASE WHEN t.c <= o.c AND t.e <= o.e AND t.s <= o.s AND t.x <= o.x THEN 'ahead on all scores' ELSE 'comparable' END AS insights FROM ({_half(0)}) o, ({_half(1)}) t
""", "scores")
def k19(t: Tables):
    return db.benchmark_competitor(t.scores.filter("cluster_id % 2 = 0"), t.scores.filter("cluster_id % 2 = 1"))


@query("k20_topic_comparison", """
SELECT site_id, 'strong' AS kind, label AS topic, health_score AS value FROM scstates WHERE health_score >= 50 QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY health_score DESC, cluster_id) <= 10
UNION ALL SELECT site_id, 'weak', label, health_score FROM scstates WHERE health_score < 40 QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY health_score, cluster_id) <= 10
UNION ALL SELECT site_id, 'gap', query, impressions::DOUBLE FROM gaps QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY impressions DESC, query) <= 10
""".replace(">= 50", ">= 60"), "scstates gaps")
def k20(t: Tables):
    return db.topic_comparison(at_site(t.cluster_states, "cluster_id"), gaps(t))


@query("k21_cluster_facts", f"""
SELECT c.cluster_id, ecosystem_state, max_by(title, (composite_score, -post_id)) FILTER (role = 'pillar') AS pillar, greatest(1, date_diff('day', max_by(publish_date, (composite_score, -post_id)) FILTER (role = 'pillar'), {A}) // 30)::BIGINT AS age_months, count(*) FILTER (role = 'supporter') AS supporters, strftime(max(modified_date), '%Y-%m') AS last_update
FROM cstates c JOIN scores USING (cluster_id) JOIN posts USING (post_id) GROUP BY 1, 2
""", "cstates scores posts")
def k21(t: Tables):
    return db.cluster_facts(t.cluster_states, t.post_clusters, t.posts, t.scores, AS_OF)


@query("k22_redirect_status", "SELECT count(*) AS total, count(*) FILTER (status IN ('pushed','verified')) AS pushed, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'failed') AS failed FROM redirects", "redirects")
def k22(t: Tables):
    return db.redirect_status(redirects(t))


@query("k22_redirect_listing", "SELECT old_url, new_url, status FROM redirects ORDER BY created_at DESC, old_url LIMIT 500", "redirects")
def k22b(t: Tables):
    return db.redirect_listing(redirects(t), 500).select("old_url", "new_url", "status")


@query("k23_urgency", """
SELECT site_id, CASE WHEN ai_schema_pct = 0 THEN 'no structured data on any post' WHEN pair_posts > 0 AND pair_posts / total_posts * 100 > 40 THEN format('{:.0f}', pair_posts / total_posts * 100) || '% of posts compete with each other' WHEN meta_pct = 0 THEN 'no meta description on ' || total_posts || ' posts'
  WHEN ai_eeat < 10 THEN 'no visible author information' WHEN orphan_count / total_posts > 0.3 THEN orphan_count || ' pages without internal links' WHEN orphan_count >= 3 THEN orphan_count || ' pages invisible to search engines' WHEN pair_count > 0 THEN pair_posts || ' posts dilute each other' ELSE 'untapped potential' END AS finding FROM aud
""", "aud")
def k23(t: Tables):
    return db.urgency(audit_ai(t))


@query("k24_word_count_profile", "SELECT site_id, count(*) AS n, round(avg(word_count), 6) AS avg, min(word_count) AS min, max(word_count) AS max, quantile_cont(word_count, 0.5) AS median FROM posts GROUP BY 1", "posts")
def k24(t: Tables):
    return db.word_count_profile(t.posts, ["site_id"]).withColumn("avg", F.round("avg", 6))


@query("k25_distribution_counts", """
SELECT site_id, 'intent' AS dimension, content_intent AS value, count(*) AS n FROM sposts GROUP BY 1, 3 UNION ALL SELECT site_id, 'problem', problem_type, count(*) FROM sproblems GROUP BY 1, 3 UNION ALL SELECT site_id, 'recommendation', rec_type, count(*) FROM srecs GROUP BY 1, 3 UNION ALL SELECT site_id, 'role', role, count(*) FROM sscores GROUP BY 1, 3
""", "sposts sproblems srecs sscores")
def k25(t: Tables):
    return db.distribution_counts(
        {"intent": (at_site(t.posts), "content_intent"), "problem": (at_site(t.problems), "problem_type"), "recommendation": (at_site(t.recs), "rec_type"), "role": (at_site(t.scores), "role")}
    )


@query("k26_score_histogram", "SELECT site_id, CASE WHEN composite_score >= 80 THEN '80-100 (excellent)' WHEN composite_score >= 65 THEN '65-79 (good)' WHEN composite_score >= 40 THEN '40-64 (moderate)' WHEN composite_score >= 20 THEN '20-39 (poor)' ELSE '0-19 (critical)' END AS bucket, count(*) AS n FROM sscores GROUP BY 1, 2", "sscores")
def k26(t: Tables):
    return db.score_histogram(at_site(t.scores))


@query("k27_early_findings", """
SELECT site_id, count(*) AS posts_sampled, (SELECT count(DISTINCT cluster_id) FROM post_clusters m WHERE m.post_id % 5 = p.site_id) AS clusters_found, (SELECT count(*) FROM spairs x WHERE x.site_id = p.site_id) AS pairs_found, (SELECT count(*) FROM sproblems x WHERE x.site_id = p.site_id AND problem_type = 'thin_content') AS thin_content, true AS preview_ready FROM sposts p GROUP BY 1
""", "sposts post_clusters spairs sproblems")
def k27(t: Tables):
    return db.early_findings(at_site(t.posts), at_site(t.post_clusters), spairs(t), at_site(t.problems), 20)
