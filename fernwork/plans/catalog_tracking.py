"""Checks of the tracking operators (group J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tracking as tr
from .oracle import cte, query
from .tables import AS_OF, Tables, at_site

A = "DATE '2024-01-31'"
rnd = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})

cte("gsc5", "SELECT post_id % 10 AS post_id, post_id % 5 AS site_id, date, query, impressions, clicks, avg_position, ctr FROM gsc", "gsc")
cte("changes", f"""
SELECT * FROM (SELECT site_id, post_id, query, avg(avg_position) FILTER (date >= {A} - 3) AS new_position, avg(avg_position) FILTER (date BETWEEN {A} - 14 AND {A} - 8) AS old_position, (sum(clicks) FILTER (date >= {A} - 3))::BIGINT AS clicks FROM gsc5 WHERE date >= {A} - 14 GROUP BY 1, 2, 3)
WHERE abs(new_position - old_position) >= 3
""", "gsc5")
TOP_CHANGES = "QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY round(abs(new_position - old_position), 9) DESC, post_id, query) <= 20"


def changes(t: Tables, limit: int | None = None):
    return tr.position_changes(at_site(t.gsc).withColumn("post_id", F.col("post_id") % 10), AS_OF, limit=limit)


@query("j1_position_changes", "SELECT site_id, post_id, query, round(new_position, 6) AS new_position, round(old_position, 6) AS old_position, clicks, CASE WHEN new_position > old_position THEN 'position_drop' ELSE 'position_gain' END AS alert_type FROM changes", "changes")
def j1(t: Tables):
    return rnd(changes(t).drop("change"), "new_position", "old_position")


@query("j1_top_position_changes", f"SELECT site_id, post_id, query, round(new_position - old_position, 6) AS change FROM changes {TOP_CHANGES}", "changes")
def j1b(t: Tables):
    return rnd(changes(t, 20).select("site_id", "post_id", "query", "change"), "change")


cte("alerts", "SELECT user_id AS post_id, 'q' || k AS keyword, event_type AS alert_type, min(date) AS detected_at, CASE WHEN k % 2 = 0 THEN 'new' ELSE 'seen' END AS status FROM ev WHERE event_type IN ('error', 'signup') GROUP BY 1, 2, 3, k, date", "ev")


def alerts(t: Tables):
    e = t.events.filter(F.col("event_type").isin("error", "signup"))
    return e.groupBy(F.col("user_id").alias("post_id"), F.concat(F.lit("q"), F.col("k").cast("string")).alias("keyword"), F.col("event_type").alias("alert_type"), F.col("date").alias("detected_at"), "k").agg(
        F.when(F.col("k") % 2 == 0, "new").otherwise("seen").alias("status")
    ).drop("k")


@query("j2_alert_suppression", """
SELECT post_id, keyword, alert_type, detected_at FROM alerts a WHERE detected_at >= DATE '2024-01-16' AND NOT EXISTS (SELECT 1 FROM alerts h WHERE h.detected_at < DATE '2024-01-16' AND h.post_id = a.post_id AND h.keyword = a.keyword AND h.alert_type = a.alert_type AND h.detected_at > a.detected_at - 7)
""", "alerts")
def j2(t: Tables):
    a, cut = alerts(t), F.lit("2024-01-16").cast("date")
    return tr.suppress_repeats(a.filter(F.col("detected_at") >= cut), a.filter(F.col("detected_at") < cut)).select("post_id", "keyword", "alert_type", "detected_at")


@query("j3_alerts_feed", "SELECT post_id, keyword, title, detected_at FROM alerts LEFT JOIN posts USING (post_id) WHERE status = 'new' AND detected_at > DATE '2024-01-20' AND alert_type = 'error' QUALIFY row_number() OVER (PARTITION BY post_id % 5 ORDER BY detected_at DESC, post_id, keyword) <= 15", "alerts posts")
def j3(t: Tables):
    return tr.alerts_feed(at_site(alerts(t)).filter("alert_type = 'error'"), t.posts, "new", "2024-01-20", 15).select("post_id", "keyword", "title", "detected_at")


@query("j4_new_post_check", """
WITH s AS (SELECT a, sim FROM sims WHERE 1 - sim < 0.75 AND a % 5 = b % 5 QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) <= 5), n AS (SELECT a, count(*) AS c, max(sim) AS m FROM s GROUP BY 1)
SELECT p.post_id, c.cluster_id, coalesce(n.c, 0) AS similar, round(n.m, 6) AS closest, (SELECT count(*) FROM links WHERE source_post_id = p.post_id) AS outbound, (SELECT count(*) FROM links WHERE target_post_id = p.post_id) AS inbound, coalesce(n.c, 0) > 0 AS at_risk
FROM posts p LEFT JOIN post_clusters c ON c.post_id = p.post_id LEFT JOIN n ON n.a = p.post_id WHERE publish_date > DATE '2024-01-31' - 90
""", "sims posts post_clusters links")
def j4(t: Tables):
    fresh = t.posts.filter(F.col("publish_date") > tr.day(AS_OF, 90))
    return tr.check_new_posts(at_site(t.embeddings), fresh, t.post_clusters, t.links, 0.75).withColumn("closest", F.round("closest", 6))


@query("j5_ranking_trends", f"""
SELECT post_id, round(avg(avg_position) FILTER (date >= {A} - 10), 6) AS pos_recent, round(avg(avg_position) FILTER (date < {A} - 10 AND date >= {A} - 20), 6) AS pos_prior, (sum(clicks) FILTER (date >= {A} - 10))::BIGINT AS clicks_recent, (sum(clicks) FILTER (date < {A} - 10 AND date >= {A} - 20))::BIGINT AS clicks_prior,
  (sum(impressions) FILTER (date >= {A} - 30))::BIGINT AS impressions, round(avg(ctr) FILTER (date >= {A} - 10), 6) AS avg_ctr, min(avg_position) AS best_position FROM gsc GROUP BY 1 HAVING count(*) >= 7
""", "gsc")
def j5(t: Tables):
    return rnd(tr.ranking_trends(t.gsc, AS_OF, 10), "pos_recent", "pos_prior", "avg_ctr")


cte("base", f"SELECT coalesce(a.post_id, b.post_id) AS post_id, coalesce(traffic, 0) AS traffic, position FROM (SELECT post_id, sum(sessions)::BIGINT AS traffic FROM ga4 WHERE date >= {A} - 30 GROUP BY 1) a FULL JOIN (SELECT post_id, avg(avg_position) AS position FROM gsc WHERE date >= {A} - 30 GROUP BY 1) b ON a.post_id = b.post_id", "ga4 gsc")


@query("j6_impact_baseline", "SELECT post_id, traffic, round(position, 6) AS position FROM base", "base")
def j6(t: Tables):
    return rnd(tr.impact_baseline(t.ga4, t.gsc, AS_OF), "position")


cte("track", "SELECT post_id, (post_id * 7 % 120)::BIGINT AS baseline_traffic, (post_id % 60)::DOUBLE AS baseline_position, publish_date AS baseline_date FROM posts", "posts")


def track(t: Tables):
    return t.posts.select("post_id", (F.col("post_id") * 7 % 120).alias("baseline_traffic"), (F.col("post_id") % 60).cast("double").alias("baseline_position"), F.col("publish_date").alias("baseline_date"))


@query("j7_impact_check", f"""
SELECT post_id, baseline_traffic, coalesce(traffic, 0) AS current_traffic, coalesce(traffic, 0) - baseline_traffic AS traffic_change, round_even(CASE WHEN baseline_traffic > 0 THEN (coalesce(traffic, 0) - baseline_traffic) / baseline_traffic * 100 ELSE 0 END, 1) AS traffic_change_pct,
  round_even(baseline_position - position, 1) AS position_change, date_diff('day', baseline_date, {A})::INTEGER AS days_since, CASE WHEN date_diff('day', baseline_date, {A}) >= 90 THEN '90d' WHEN date_diff('day', baseline_date, {A}) >= 60 THEN '60d' WHEN date_diff('day', baseline_date, {A}) >= 30 THEN '30d' END AS milestone,
  CASE WHEN date_diff('day', baseline_date, {A}) >= 90 THEN 'complete' ELSE 'tracking' END AS status FROM track LEFT JOIN base USING (post_id)
""", "track base")
def j7(t: Tables):
    return tr.impact_check(track(t), tr.impact_baseline(t.ga4, t.gsc, AS_OF), AS_OF)


cte("impacts", f"""
SELECT i.post_id, completed_at, composite_score AS health_after, coalesce(clicks, 0) AS traffic_after, coalesce(n, 0) AS problems_after, composite_score - 40 AS health_change, CASE WHEN tb > 0 THEN (coalesce(clicks, 0) - tb) / tb * 100 ELSE 0 END AS traffic_change_pct, 50 - coalesce(pos, 0) AS position_change
FROM (SELECT post_id, completed_at, (post_id % 4)::BIGINT AS tb FROM recs WHERE status = 'completed' AND completed_at < {A} - 7) i JOIN scores USING (post_id) LEFT JOIN (SELECT post_id, sum(clicks)::BIGINT AS clicks, avg(avg_position) AS pos FROM gsc WHERE date >= {A} - 30 GROUP BY 1) g USING (post_id) LEFT JOIN (SELECT post_id, count(*) AS n FROM problems GROUP BY 1) p USING (post_id)
""", "recs scores gsc problems")


def impacts(t: Tables):
    i = t.recs.filter("status = 'completed'").select(
        "post_id", "completed_at", F.lit(40.0).alias("health_before"), (F.col("post_id") % 4).alias("traffic_before"), F.lit(50.0).alias("position_before")
    )
    return tr.recommendation_impact(i, t.scores, t.gsc, t.problems, AS_OF)


@query("j8_recommendation_impact", "SELECT * REPLACE (round(health_change, 6) AS health_change, round(traffic_change_pct, 6) AS traffic_change_pct, round(position_change, 6) AS position_change) FROM impacts", "impacts")
def j8(t: Tables):
    return rnd(impacts(t), "health_change", "traffic_change_pct", "position_change")


@query("j9_impact_report", f"SELECT post_id % 5 AS site_id, count(*) AS total_completed, round_even(avg(health_change), 1) AS avg_health_improvement, round_even(avg(traffic_change_pct), 1) AS avg_traffic_change_pct, round_even(avg(position_change), 1) AS avg_position_improvement, count(*) FILTER (health_change > 0) AS improved, round_even(count(*) FILTER (health_change > 0) / greatest(count(*), 1) * 100, 1) AS success_rate FROM impacts WHERE completed_at >= {A} - 30 GROUP BY 1", "impacts")
def j9(t: Tables):
    return tr.impact_report(at_site(impacts(t)), AS_OF)


@query("j10_health_history", "SELECT site_id, date, score, row_number() OVER (PARTITION BY site_id ORDER BY date DESC)::INTEGER AS rank FROM history QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY date DESC) <= 10", "history")
def j10(t: Tables):
    return tr.newest_first(t.history, ["site_id"], 10).select("site_id", "date", "score", "rank")


FS = ["score", "traffic", "ranking", "engagement"]
cte("lasttwo", "SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY date DESC) AS r FROM history QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY date DESC) <= 2", "history")
cte("two", "SELECT n.site_id, " + ", ".join(f"n.{c} AS {c}_n, o.{c} AS {c}_o" for c in [*FS, "total_posts", "problems"]) + " FROM lasttwo n LEFT JOIN lasttwo o ON o.site_id = n.site_id AND o.r = 2 WHERE n.r = 1", "lasttwo")


@query("j11_analysis_diff", "SELECT *, delta < CASE WHEN factor = 'score' THEN -3 ELSE -5 END AS degraded FROM (" + " UNION ALL ".join(f"SELECT site_id, '{f}' AS factor, {f}_o AS before, {f}_n AS after, round_even({f}_n - {f}_o, 1) AS delta FROM two" for f in FS) + ") WHERE abs(delta) >= 0.5", "two")
def j11(t: Tables):
    return tr.analysis_diff(t.history, FS)


DIFFS = " UNION ALL ".join(f"SELECT site_id, '{f}' AS factor, round_even({f}_n - {f}_o, 1) AS delta, {f}_n - {f}_o AS exact FROM two WHERE score_o IS NOT NULL" for f in FS)


@query("j11_analysis_report", f"""
WITH d AS (SELECT * FROM ({DIFFS}) WHERE abs(delta) >= 0.5),
c AS (SELECT site_id, list(factor || ' ' || format('{{:.1f}}', delta) ORDER BY abs(delta) DESC, factor) FILTER (factor <> 'score') AS changes, list(factor || ' fell by ' || format('{{:.1f}}', abs(delta)) ORDER BY factor) FILTER (delta < CASE WHEN factor = 'score' THEN -3 ELSE -5 END) AS worse FROM d GROUP BY 1),
n AS (SELECT site_id, list(n || ' new ' || replace(problem_type, '_', ' ') ORDER BY n || ' new ' || replace(problem_type, '_', ' ')) AS news FROM (SELECT site_id, problem_type, count(*) AS n FROM sproblems WHERE resolved_at IS NULL AND detected_at > {A} - 7 GROUP BY 1, 2) GROUP BY 1),
k AS (SELECT site_id, (SELECT count(*) FROM sproblems p WHERE p.site_id = s.site_id AND resolved_at > {A} - 30) AS solved, (SELECT count(*) FROM sscores p WHERE p.site_id = s.site_id AND schema_score > 0) AS marked,
  (SELECT count(*) FROM srecs p WHERE p.site_id = s.site_id AND status = 'completed' AND completed_at > {A} - 30) AS done, (SELECT count(*) FROM sposts p WHERE p.site_id = s.site_id AND modified_date < {A} - INTERVAL 12 MONTH) AS stale FROM sites s)
SELECT site_id, round_even(score_o, 1) AS score_before, round_even(score_n, 1) AS score_after, round_even(score_n - score_o, 1) AS score_delta, coalesce(array_to_string(changes, '; '), '') AS factor_changes,
  array_to_string(list_filter([CASE WHEN solved > 0 THEN solved || ' issues resolved' END, CASE WHEN marked > 0 THEN marked || ' posts with structured data' END, CASE WHEN done > 0 THEN done || ' recommendations completed' END], lambda x: x IS NOT NULL), '; ') AS improvements,
  array_to_string(list_concat(coalesce(news, []), CASE WHEN stale > 0 THEN [stale || ' posts not updated in a year'] ELSE [] END), '; ') AS new_issues, coalesce(array_to_string(worse, '; '), '') AS degradations
FROM two LEFT JOIN c USING (site_id) LEFT JOIN n USING (site_id) LEFT JOIN k USING (site_id) WHERE score_o IS NOT NULL
""", "two sproblems sscores srecs sposts sites")
def j11b(t: Tables):
    r = tr.analysis_report(t.history, FS, at_site(t.problems), at_site(t.scores), at_site(t.recs), at_site(t.posts), AS_OF)
    return r.withColumns({c: F.array_join(c, "; ") for c in ("factor_changes", "improvements", "new_issues", "degradations")})


cte("trend", f"SELECT site_id, CASE WHEN max(n) >= 2 THEN avg(score) FILTER (r <= n // 2) - avg(score) FILTER (r > n // 2) ELSE 0 END AS trend FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY date DESC) AS r, count(*) OVER (PARTITION BY site_id) AS n FROM history WHERE date >= {A} - 14) GROUP BY 1", "history")


@query("j12_trend_direction", "SELECT site_id, round(trend, 6) AS trend FROM trend", "trend")
def j12(t: Tables):
    return rnd(tr.trend_direction(t.history, AS_OF), "trend")


@query("j13_outlook", f"""
WITH d AS (SELECT t.site_id, trend, pr, {A} + CAST(o AS INTEGER) AS date, o FROM trend t JOIN (SELECT site_id, sum(problems) / sum(total_posts) AS pr FROM history GROUP BY 1) USING (site_id), range(7) r(o)),
b AS (SELECT *, 0.5::DOUBLE + trend / 20 - pr * 0.3 - pr * 0.2 AS raw FROM d), s AS (SELECT site_id, date, greatest(0, least(1, CASE WHEN dayofweek(date) IN (0, 6) THEN greatest(raw, 0.35) ELSE raw END * (1 - o * 0.05::DOUBLE) + 0.5::DOUBLE * (o * 0.05::DOUBLE))) AS s FROM b)
SELECT site_id, date, round(s, 6) AS level, CASE WHEN s >= 0.7 THEN 'sunny' WHEN s >= 0.45 THEN 'cloudy' WHEN s >= 0.25 THEN 'rainy' ELSE 'stormy' END AS state FROM s
""", "trend history")
def j13(t: Tables):
    ratio = t.history.groupBy("site_id").agg((F.sum("problems") / F.sum("total_posts")).alias("decay_ratio")).withColumn("problem_ratio", F.col("decay_ratio"))
    return tr.outlook(tr.trend_direction(t.history, AS_OF).join(ratio, "site_id"), AS_OF)


@query("j14_weekly_metrics", """
WITH p AS (SELECT site_id, count(*) AS total_posts FROM sposts GROUP BY 1),
c AS (SELECT site_id, round_even(avg(composite_score), 1) AS health_score, count(*) FILTER (role IN ('pillar','supporter')) AS active_posts, count(*) FILTER (role = 'dead_weight') AS dead_posts FROM sscores GROUP BY 1),
x AS (SELECT site_id, count(DISTINCT p) AS n FROM (SELECT site_id, post_a_id AS p FROM spairs UNION SELECT site_id, post_b_id FROM spairs) GROUP BY 1)
SELECT site_id, total_posts, coalesce(health_score, 0) AS health_score, coalesce(active_posts, 0) AS active_posts, coalesce(dead_posts, 0) AS dead_posts, coalesce(n, 0) AS cannibalistic_posts, round_even(coalesce(active_posts, 0) / total_posts * 100, 1) AS efficiency_ratio
FROM p LEFT JOIN c USING (site_id) LEFT JOIN x USING (site_id)
""", "sposts sscores spairs")
def j14(t: Tables):
    return tr.weekly_metrics(at_site(t.posts), at_site(t.scores), at_site(t.pairs, "post_a_id"))


@query("j14_weekly_delta", "SELECT site_id, score_n AS score, total_posts_n AS total_posts, round(score_n - score_o, 6) AS score_delta, total_posts_n - total_posts_o AS total_posts_delta FROM two", "two")
def j14b(t: Tables):
    return rnd(tr.weekly_delta(t.history, ["score", "total_posts"]), "score_delta")


@query("j15_weekly_report", f"""
WITH g AS (SELECT post_id % 5 AS site_id, sum(greatest(0, coalesce(traffic, 0) - baseline_traffic))::DOUBLE AS n FROM track LEFT JOIN base USING (post_id) GROUP BY 1)
SELECT site_id, 'cluster' AS kind, label AS name, health_score AS value FROM scstates QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY health_score DESC NULLS LAST, cluster_id) <= 5
UNION ALL SELECT site_id, 'new_pairs', '', count(*) FILTER (created_at > {A} - 7)::DOUBLE FROM spairs GROUP BY 1
UNION ALL SELECT site_id, 'quick_win', label, post_count::DOUBLE FROM scstates WHERE ecosystem_state = 'swamp' QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY post_count DESC, cluster_id) = 1
UNION ALL SELECT site_id, 'top_recommendation', title, rec_id::DOUBLE FROM srecs WHERE status = 'pending' QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, created_at DESC, rec_id) = 1
UNION ALL SELECT site_id, 'completed', '', count(*) FILTER (status = 'completed' AND completed_at > {A} - 7)::DOUBLE FROM srecs GROUP BY 1
UNION ALL SELECT site_id, 'recovered_traffic', '', n FROM g
""", "scstates spairs srecs track base")
def j15(t: Tables):
    return tr.weekly_report(at_site(t.cluster_states, "cluster_id"), at_site(t.pairs, "post_a_id"), at_site(t.recs), tracked(t), AS_OF)


def tracked(t: Tables):
    return at_site(track(t).join(tr.impact_baseline(t.ga4, t.gsc, AS_OF), "post_id", "left").withColumnRenamed("traffic", "latest_traffic"))


@query("j16_monthly_delta", f"""
SELECT site_id, round_even(score_n, 0) AS score, round_even(score_n, 0) - round_even(score_o, 0) AS score_delta, (SELECT count(*) FROM srecs r WHERE r.site_id = two.site_id AND status = 'completed' AND completed_at > {A} - 30) AS completed,
  (SELECT count(*) FROM srecs r WHERE r.site_id = two.site_id AND status = 'pending') AS pending, (SELECT count(*) FROM sproblems p WHERE p.site_id = two.site_id AND resolved_at IS NULL AND detected_at > {A} - 30) AS new_issues FROM two
""", "two srecs sproblems")
def j16(t: Tables):
    return tr.monthly_delta(t.history, at_site(t.recs), at_site(t.problems), AS_OF)


@query("j17_since_visit", """
WITH v AS (SELECT site_id, DATE '2024-01-10' + CAST(site_id AS INTEGER) AS at FROM sites)
SELECT site_id, (SELECT count(*) FROM sproblems p WHERE p.site_id = v.site_id AND detected_at > at AND resolved_at IS NULL) AS new_problems, (SELECT count(*) FROM alerts a WHERE a.post_id % 5 = v.site_id AND detected_at > at) AS new_alerts,
  (SELECT count(*) FROM srecs r WHERE r.site_id = v.site_id AND status = 'completed' AND completed_at > at) AS completed FROM v
""".replace(" AS at ", " AS seen ").replace("> at", "> seen"), "sites sproblems alerts srecs")
def j17(t: Tables):
    visits = at_site(t.events, "user_id").select("site_id").distinct().withColumn("visited_at", F.date_add(F.lit("2024-01-10").cast("date"), F.col("site_id").cast("int")))
    return tr.since_visit(at_site(t.problems), at_site(alerts(t)), at_site(t.recs), visits)


@query("j18_roi_summary", f"""
WITH k AS (SELECT post_id % 5 AS site_id, sum(greatest(0, coalesce(traffic, 0) - baseline_traffic))::BIGINT AS recovered FROM track LEFT JOIN base USING (post_id) GROUP BY 1),
r AS (SELECT site_id, count(*) AS completed, date_diff('day', min(completed_at), {A})::INTEGER AS days_active FROM srecs WHERE status = 'completed' GROUP BY 1),
h AS (SELECT site_id, min_by(score, date) AS initial_health, max_by(score, date) AS current_health FROM history GROUP BY 1)
SELECT site_id, coalesce(recovered, 0) AS recovered, coalesce(completed, 0) AS completed, days_active, initial_health, current_health, round_even(current_health - initial_health, 1) AS health_change FROM k FULL JOIN r USING (site_id) FULL JOIN h USING (site_id)
""", "track base history srecs")
def j18(t: Tables):
    return tr.roi_summary(tracked(t), at_site(t.recs), t.history, AS_OF)


@query("j19_impact_estimate", """
WITH p AS (SELECT site_id, count(*) AS n FROM sposts GROUP BY 1),
r AS (SELECT site_id, count(*) AS completed, sum(CASE rec_type WHEN 'merge' THEN 3.0 WHEN 'expand' THEN 2.0 WHEN 'optimize' THEN 1.5 WHEN 'refresh' THEN 1.5 WHEN 'delete' THEN 0.5 ELSE 1.0 END) AS w FROM srecs WHERE status = 'completed' GROUP BY 1)
SELECT site_id, coalesce(completed, 0) AS completed, round_even(least(15, coalesce(w, 0) / greatest(n / 50, 1))::DOUBLE, 1) AS estimated_points FROM p LEFT JOIN r USING (site_id)
""", "sposts srecs")
def j19(t: Tables):
    return tr.impact_estimate(at_site(t.recs), at_site(t.posts))


cte("redirects", "SELECT doc_id % 5 AS site_id, url AS old_url, 'https://new.example.com/' || doc_id AS new_url, CASE doc_id % 4 WHEN 0 THEN 'pushed' WHEN 1 THEN 'verified' WHEN 2 THEN 'failed' ELSE 'pending' END AS status, publish_date AS created_at FROM documents JOIN posts ON post_id = doc_id WHERE doc_id % 3 <> 1", "posts")


def redirects(t: Tables):
    p = F.col("post_id")
    return t.posts.filter(p % 3 != 1).select(
        (p % 5).alias("site_id"), F.col("url").alias("old_url"), F.concat(F.lit("https://new.example.com/"), p.cast("string")).alias("new_url"),
        F.when(p % 4 == 0, "pushed").when(p % 4 == 1, "verified").when(p % 4 == 2, "failed").otherwise("pending").alias("status"), F.col("publish_date").alias("created_at"),
    )


@query("j20_steward_profile", """
WITH s AS (SELECT DISTINCT user_id % 5 AS site_id, user_id % 5 % 2 AS user_id FROM ev), c AS (SELECT *, cluster_id % 5 AS site_id FROM cstates),
k AS (SELECT user_id, count(*) FILTER (ecosystem_state IN ('forest','meadow') AND EXISTS (SELECT 1 FROM post_clusters m JOIN posts p ON p.post_id = m.post_id JOIN redirects r ON r.old_url = p.url WHERE m.cluster_id = c.cluster_id AND r.site_id = c.site_id)) AS swamps_cleared,
  count(*) FILTER (ecosystem_state IN ('forest','meadow') AND post_count <= 3) AS deserts_revived, coalesce(sum(post_count) FILTER (ecosystem_state = 'seedbed'), 0)::BIGINT AS seedlings_planted FROM c JOIN s USING (site_id) GROUP BY 1),
r AS (SELECT user_id, count(*) AS redirects, count(*) FILTER (status = 'verified') AS consolidated FROM redirects JOIN s USING (site_id) GROUP BY 1),
g AS (SELECT user_id, round_even(sum(g), 1) AS health_improvement FROM (SELECT site_id, max_by(score, date) - min_by(score, date) AS g FROM history GROUP BY 1) JOIN s USING (site_id) GROUP BY 1)
SELECT * FROM k JOIN r USING (user_id) JOIN g USING (user_id)
""", "ev cstates post_clusters posts redirects history")
def j20(t: Tables):
    sites = t.events.select((F.col("user_id") % 5).alias("site_id")).distinct().withColumn("user_id", F.col("site_id") % 2)
    c = t.cluster_states.withColumn("site_id", F.col("cluster_id") % 5)
    return tr.steward_profile(sites, c, t.post_clusters, t.posts, redirects(t), t.history)


@query("j21_period_recap", """
WITH p AS (SELECT site_id, count(*) AS total_posts, count(*) FILTER (publish_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31') AS posts_created, sum(word_count)::BIGINT AS total_words FROM sposts GROUP BY 1),
h AS (SELECT site_id, min_by(score, date) AS health_start, max_by(score, date) AS health_end FROM history GROUP BY 1),
b AS (SELECT site_id, first(post_id ORDER BY composite_score DESC, post_id) AS best_post, first(post_id ORDER BY composite_score, post_id) AS worst_post FROM sscores GROUP BY 1),
c AS (SELECT site_id, count(*) AS cluster_count, first(label ORDER BY health_score DESC, cluster_id) AS top_cluster, count(*) FILTER (ecosystem_state = 'swamp') AS swamps, count(*) FILTER (ecosystem_state = 'desert') AS deserts, count(*) FILTER (ecosystem_state = 'forest') AS forests, count(*) FILTER (ecosystem_state = 'seedbed') AS seedbeds, count(*) FILTER (ecosystem_state = 'meadow') AS meadows FROM scstates GROUP BY 1),
x AS (SELECT site_id, count(*) AS pairs FROM spairs GROUP BY 1)
SELECT site_id, total_posts, posts_created, total_words, health_start, health_end, best_post, worst_post, coalesce(cluster_count, 0) AS cluster_count, top_cluster, coalesce(swamps, 0) AS swamps, coalesce(deserts, 0) AS deserts, coalesce(forests, 0) AS forests, coalesce(seedbeds, 0) AS seedbeds, coalesce(meadows, 0) AS meadows,
  coalesce(pairs, 0) AS pairs, round_even(health_end - health_start, 1) AS improvement FROM p LEFT JOIN h USING (site_id) LEFT JOIN b USING (site_id) LEFT JOIN c USING (site_id) LEFT JOIN x USING (site_id)
""", "sposts history sscores scstates spairs")
def j21(t: Tables):
    return tr.period_recap(at_site(t.posts), t.history, at_site(t.scores), at_site(t.cluster_states, "cluster_id"), at_site(t.pairs, "post_a_id"), "2024-01")


@query("j22_streaks", f"""
WITH d AS (SELECT DISTINCT user_id, date FROM ev WHERE event_type IN ('click', 'view') AND date <= DATE '2024-01-20'), g AS (SELECT user_id, date - CAST(row_number() OVER (PARTITION BY user_id ORDER BY date) AS INTEGER) AS g, date FROM d), r AS (SELECT user_id, g, count(*) AS n, max(date) AS e FROM g GROUP BY 1, 2)
SELECT user_id, max_by(n, e) AS current_streak, max(n) AS longest_streak, max(e) AS last_check_in, sum(n)::BIGINT AS total_check_ins, CASE WHEN max_by(n, e) >= 100 THEN 'gold' WHEN max_by(n, e) >= 30 THEN 'silver' WHEN max_by(n, e) >= 7 THEN 'bronze' END AS milestone FROM r GROUP BY 1
""", "ev")
def j22(t: Tables):
    return tr.streaks(t.events.filter(F.col("event_type").isin("click", "view")), "2024-01-20")


def snaps(t: Tables):
    return tr.daily_snapshots(at_site(t.scores), at_site(t.problems), t.gsc, at_site(t.pairs, "post_a_id"), t.cluster_states, AS_OF)


@query("j23_post_snapshot", f"""
SELECT post_id, {A} AS snapshot_date, composite_score, trend, role, coalesce(c, 0) AS traffic_30d, round(p + 1e-9, 6) AS avg_position, coalesce(n, 0) AS problems_count FROM scores LEFT JOIN (SELECT post_id, sum(clicks)::BIGINT AS c, avg(avg_position) AS p FROM gsc WHERE date >= {A} - 30 GROUP BY 1) USING (post_id) LEFT JOIN (SELECT post_id, count(*) AS n FROM problems GROUP BY 1) USING (post_id)
""", "scores gsc problems")
def j23(t: Tables):
    # nudged so that exact halves round the same way in both engines
    return snaps(t)["post"].withColumn("avg_position", F.round(F.col("avg_position") + 1e-9, 6))


@query("j23_site_snapshot", f"""
WITH s AS (SELECT site_id, round(avg(composite_score), 6) AS avg_health_score, count(*) AS total_posts, count(*) FILTER (role = 'pillar') AS pillar_count, count(*) FILTER (role = 'dead_weight') AS dead_weight_count FROM sscores GROUP BY 1)
SELECT s.*, (SELECT count(*) FROM sproblems p WHERE p.site_id = s.site_id) AS total_problems, (SELECT count(*) FROM spairs p WHERE p.site_id = s.site_id) AS cannibalization_pairs, {A} AS snapshot_date FROM s
""", "sscores sproblems spairs")
def j23b(t: Tables):
    return rnd(snaps(t)["site"], "avg_health_score")


@query("j23_cluster_snapshot", f"SELECT cluster_id, {A} AS snapshot_date, post_count, health_score AS avg_health_score, ecosystem_state FROM cstates", "cstates")
def j23c(t: Tables):
    return snaps(t)["cluster"]


@query("j24_token_costs", """
SELECT o_orderpriority AS service, round(sum(i * ri + o * ro) / 1000000, 6) AS cost, sum(i + o)::BIGINT AS tokens FROM (SELECT o_orderpriority, o_custkey AS i, o_orderkey AS o, CASE o_orderstatus WHEN 'F' THEN 3.0 WHEN 'O' THEN 0.25 ELSE 0.02 END::DOUBLE AS ri, CASE o_orderstatus WHEN 'F' THEN 15.0 WHEN 'O' THEN 1.25 ELSE 0.0 END::DOUBLE AS ro FROM orders) GROUP BY 1
""")
def j24(t: Tables):
    s = F.col("o_orderstatus")
    log = t.raw("orders").select(
        F.col("o_orderpriority").alias("service"), F.concat(F.when(s == "F", "large-4").when(s == "O", "small-3").otherwise("embed-small"), F.lit("-"), (F.col("o_orderkey") % 3).cast("string")).alias("model"),
        F.col("o_custkey").alias("input_tokens"), F.col("o_orderkey").alias("output_tokens"),
    )
    # fixed values: price per million tokens by model family
    rates = t.spark.createDataFrame([("large-", 3.0, 15.0), ("small-", 0.25, 1.25), ("embed", 0.02, 0.0), ("em", 9.0, 9.0)], "prefix string, input_rate double, output_rate double")
    return rnd(tr.token_costs(log, rates), "cost")


@query("j25_report_history", "SELECT site_id, date, score, problems FROM history QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY date DESC) <= 12", "history")
def j25(t: Tables):
    return tr.newest_first(t.history, ["site_id"], 12).select("site_id", "date", "score", "problems")
