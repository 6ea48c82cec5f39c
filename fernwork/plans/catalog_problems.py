"""Checks of the problem detectors (group H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import problems as pb
from ..operators import scoring as sc
from . import sqltext as q
from .catalog_extract import articles
from .catalog_scoring import opened
from .oracle import cte, query
from .tables import AS_OF, Tables

A = "DATE '2024-01-31'"
R = lambda df: df.withColumn("value", F.round("value", 6))

cte("h1", f"""
SELECT post_id, 'decay_' || sev AS problem_type, sev AS severity, d AS value FROM (SELECT post_id, (prev - recent) / greatest(prev, 1) * 100 AS d, CASE WHEN (prev - recent) / greatest(prev, 1) * 100 > 60 THEN 'severe' ELSE 'moderate' END AS sev FROM (
  SELECT post_id, coalesce(sum(clicks) FILTER (date >= {A} - 10), 0) AS recent, coalesce(sum(clicks) FILTER (date < {A} - 10), 0) AS prev FROM gsc WHERE date >= {A} - 20 GROUP BY 1) WHERE prev > 10 AND recent < prev * 0.7)
""", "gsc")


@query("h1_click_decline", f"""
SELECT post_id, 'decay_' || sev AS problem_type, sev AS severity, round(d, 6) AS value FROM (SELECT post_id, (prev - recent) / greatest(prev, 1) * 100 AS d, CASE WHEN (prev - recent) / greatest(prev, 1) * 100 > 60 THEN 'severe' ELSE 'moderate' END AS sev FROM (
  SELECT post_id % 70 AS post_id, coalesce(sum(clicks) FILTER (date >= {A} - 15), 0) AS recent, coalesce(sum(clicks) FILTER (date < {A} - 15), 0) AS prev FROM gsc WHERE date >= {A} - 30 GROUP BY 1) WHERE prev > 10 AND recent < prev * 0.7)
""", "gsc")
def h1(t: Tables):
    return R(pb.click_decline(t.gsc.withColumn("post_id", F.col("post_id") % 70), AS_OF, 15))


cte("h2", f"SELECT post_id, 'decay_mild' AS problem_type, 'medium' AS severity, p AS value FROM posts JOIN (SELECT post_id, avg(avg_position) AS p FROM gsc WHERE date >= {A} - 90 GROUP BY 1) USING (post_id) WHERE p > 10 AND coalesce(modified_date, publish_date) < {A} - 365", "posts gsc")


@query("h2_stale_ranking", "SELECT post_id, problem_type, severity, round(value, 6) AS value FROM h2", "h2")
def h2(t: Tables):
    return R(pb.stale_ranking(t.posts, t.gsc, AS_OF))


cte("h3", f"""
SELECT post_id, 'decay_' || sev AS problem_type, sev AS severity, now AS value FROM (SELECT *, CASE WHEN best <= 3 AND now > 20 THEN 'severe' ELSE 'moderate' END AS sev FROM (
  SELECT post_id, min(avg_position) FILTER (date < {A} - 10) AS best, avg(avg_position) FILTER (date >= {A} - 10) AS now FROM gsc GROUP BY 1) WHERE best <= 5 AND now > 10)
""", "gsc")


@query("h3_position_drop", "SELECT post_id, problem_type, severity, round(value, 6) AS value FROM h3", "h3")
def h3(t: Tables):
    return R(pb.position_drop(t.gsc, AS_OF, 10))


def hposts(t: Tables):
    """Articles under titles with years and comparison words."""
    year = F.when(F.col("post_id") % 5 == 0, F.concat(F.lit(" in "), (F.lit(2015) + F.col("post_id") % 9).cast("string"))).otherwise("")
    return articles(t).withColumn("title", F.concat(opened(F.col("title")), year))


def scanned(t: Tables):
    """These posts with reading_ease, read once, without texts."""
    return pb.scan(sc.readability(hposts(t)))


cte("hposts", "SELECT a.* REPLACE (t.title || CASE WHEN a.post_id % 5 = 0 THEN ' in ' || (2015 + a.post_id % 9) ELSE '' END AS title) FROM articles a JOIN titled t USING (post_id)", "articles titled")
cte("h4", f"""
SELECT post_id, CASE WHEN o THEN 'decay_severe' WHEN tm THEN 'decay_moderate' ELSE 'decay_mild' END AS problem_type, CASE WHEN o THEN 'high' ELSE 'medium' END AS severity, CASE WHEN o THEN yr ELSE round_even(date_diff('day', upd, {A}) / 30.44::DOUBLE, 1) END::DOUBLE AS value
FROM (SELECT *, coalesce(yr BETWEEN 1990 AND 2024 AND yr < 2023, false) AS o FROM (SELECT post_id, coalesce(modified_date, publish_date) AS upd, TRY_CAST(nullif(regexp_extract(title, '((?:19|20)\\d{{2}})', 1), '') AS INTEGER) AS yr,
  regexp_matches({q.plain('lower(title)')}, '\\bbest\\b|\\btop\\s+\\d|\\breview\\b|\\bpricing\\b|\\bcompare\\b|\\bvs\\b') AS tm FROM hposts) WHERE upd < {A} - 548 AND post_id NOT IN (SELECT post_id FROM h1))
""", "hposts h1")


@query("h4_proxy_decay", "SELECT post_id, problem_type, severity, round(value, 6) AS value FROM h4", "h4")
def h4(t: Tables):
    return R(pb.proxy_decay(hposts(t), pb.click_decline(t.gsc, AS_OF, 10), AS_OF))


cte("h5", """
SELECT post_id, 'thin_content' AS problem_type, CASE WHEN word_count < lim * 0.5 THEN 'high' ELSE 'medium' END AS severity, word_count::DOUBLE AS value FROM (
  SELECT *, CASE WHEN regexp_matches(b, '/compare|/vs-| vs |comparison') THEN 500 WHEN regexp_matches(b, 'how-to|guide|tutorial|step-by-step|ultimate|complete|definitive|checklist') THEN 800 WHEN regexp_matches(b, '/glossary|what-is|definition') THEN 200 ELSE 500 END AS lim
  FROM (SELECT *, lower(url) || chr(10) || lower(title) AS b FROM hposts WHERE word_count > 0 AND page_type NOT IN ('landing','index'))) LEFT JOIN (SELECT target_post_id AS post_id, count(*) AS inb FROM links WHERE target_post_id IS NOT NULL GROUP BY 1) USING (post_id)
WHERE word_count < lim AND NOT (len(headings) >= 2 AND contains(body_html, '<img') AND coalesce(inb, 0) >= 5)
""", "hposts links")


@query("h5_thin_content", "SELECT * FROM h5", "h5")
def h5(t: Tables):
    return pb.thin_content(hposts(t), t.links)


cte("h6", "SELECT post_id, 'thin_below_cluster_avg' AS problem_type, 'medium' AS severity, word_count / a AS value FROM (SELECT post_id, word_count, avg(word_count) OVER (PARTITION BY cluster_id) AS a FROM hposts JOIN post_clusters USING (post_id)) WHERE word_count < a * 0.5 AND word_count < 800 AND a > 1500", "hposts post_clusters")


@query("h6_thin_in_cluster", """
SELECT post_id, 'thin_below_cluster_avg' AS problem_type, 'medium' AS severity, round(wc / a, 6) AS value FROM (SELECT post_id, word_count * 4 AS wc, avg(word_count * 4) OVER (PARTITION BY cluster_id) AS a FROM posts JOIN post_clusters USING (post_id)) WHERE wc < a * 0.5 AND wc < 800 AND a > 1500
""", "posts post_clusters")
def h6(t: Tables):
    return R(pb.thin_in_cluster(t.posts.withColumn("word_count", F.col("word_count") * 4), t.post_clusters))


@query("h7_high_bounce", f"SELECT post_id, 'thin_high_bounce' AS problem_type, 'high' AS severity, round(avg(bounce_rate), 6) AS value FROM ga4 WHERE date >= {A} - 90 GROUP BY 1 HAVING avg(bounce_rate) > 0.1 AND avg(avg_time) < 50", "ga4")
def h7(t: Tables):
    return R(pb.high_bounce(t.ga4, AS_OF, bounce=0.1, seconds=50))


cte("h8", f"""
SELECT post_id, r.t AS problem_type, r.s AS severity, NULL::DOUBLE AS value FROM (SELECT post_id, unnest([CASE WHEN coalesce(length({q.strip('meta_description')}), 0) < 10 THEN {{'t': 'seo_missing_meta', 's': 'medium'}} END,
  CASE WHEN n < 20 OR n > 70 THEN {{'t': 'seo_title_length', 's': CASE WHEN n < 20 THEN 'medium' ELSE 'low' END}} END, CASE WHEN len(headings) = 0 THEN {{'t': 'seo_no_headings', 's': 'medium'}} END,
  CASE WHEN post_id NOT IN (SELECT source_post_id FROM links UNION SELECT target_post_id FROM links WHERE target_post_id IS NOT NULL) THEN {{'t': 'seo_no_internal_links', 's': 'high'}} END,
  CASE WHEN length(body_html) > 200 AND NOT regexp_matches(lower(body_html), '<img|<picture|<figure|<svg|data-src=|srcset=|background-image:|loading="lazy"') THEN {{'t': 'seo_no_images', 's': 'low'}} END]) AS r
FROM (SELECT *, length({q.strip('title')}) AS n FROM hposts WHERE page_type NOT IN ('landing','index'))) WHERE r IS NOT NULL
""", "hposts links")


@query("h8_seo_issues", "SELECT * FROM h8", "h8")
def h8(t: Tables):
    return pb.seo_issues(hposts(t), t.links)


cte("h9", "SELECT post_id, 'orphan' AS problem_type, 'high' AS severity, NULL::DOUBLE AS value FROM hposts WHERE word_count >= 200 AND page_type NOT IN ('landing','index') AND post_id NOT IN (SELECT target_post_id FROM links WHERE target_post_id IS NOT NULL)", "hposts links")


@query("h9_orphans", "SELECT * FROM h9", "h9")
def h9(t: Tables):
    return pb.orphans(hposts(t), t.links)


IND = "['saas','agency','media','default'][len(regexp_extract_all(site_id, '[1357]')) + 1]"
cte("h10", f"""
SELECT post_id, 'readability_too_complex' AS problem_type, CASE WHEN fre < 30 THEN 'high' ELSE 'medium' END AS severity, round_even(fre, 1) AS value FROM (SELECT *, {IND} AS ind FROM readable) WHERE fre < CASE ind WHEN 'saas' THEN 35 WHEN 'agency' THEN 35 WHEN 'media' THEN 55 ELSE 50 END
""", "readable")


def industries(t: Tables):
    name = F.element_at(F.array(*map(F.lit, ["saas", "agency", "media", "default"])), F.regexp_count("site_id", F.lit("[1357]")) + 1)
    return t.posts.select("site_id").distinct().withColumn("industry", name)


@query("h10_hard_to_read", "SELECT * FROM h10", "h10")
def h10(t: Tables):
    return pb.hard_to_read(sc.readability(t.posts), industries(t))


cte("vel", f"""
WITH b AS (SELECT site_id, count(*) AS dated_posts, count(*) FILTER (publish_date >= {A} - 15) AS recent, count(*) FILTER (publish_date >= {A} - 30 AND publish_date < {A} - 15) AS previous, date_diff('day', min(publish_date), max(publish_date))::INTEGER AS range_days FROM posts GROUP BY 1),
y AS (SELECT site_id, year(publish_date)::INTEGER AS y, count(*) AS n, min(publish_date) AS f FROM posts GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY count(*) DESC, min(publish_date)) = 1)
SELECT site_id, dated_posts, recent, previous, range_days, round_even(recent / 13, 2) AS recent_weekly, round_even(previous / 13, 2) AS previous_weekly, round_even(dated_posts / greatest(1, range_days / 7), 2) AS overall_weekly,
  y AS peak_year, n AS peak_posts, CASE WHEN previous > 0 AND recent < previous * 0.5 THEN 'declining' WHEN recent > previous * 1.5 THEN 'accelerating' ELSE 'stable' END AS trend FROM b JOIN y USING (site_id) WHERE dated_posts >= 5
""", "posts")


@query("h11_publishing_velocity", "SELECT * FROM vel", "vel")
def h11(t: Tables):
    return pb.publishing_velocity(t.posts, AS_OF, 15)


cte("h12", "SELECT post_id, 'velocity_decline' AS problem_type, 'medium' AS severity, recent_weekly AS value FROM posts JOIN vel USING (site_id) WHERE trend = 'declining' QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY publish_date DESC NULLS LAST, post_id) = 1", "posts vel")


@query("h12_velocity_decline", "SELECT * FROM h12", "h12")
def h12(t: Tables):
    return pb.velocity_decline(t.posts, AS_OF, 15)


# sites below this share of resolved links are left out of the link checks; the data given straddle it
RESOLVED = 0.48
cte("gated", f"SELECT site_id FROM (SELECT site_id, avg((target_post_id IS NOT NULL)::INTEGER) AS r FROM links JOIN hposts ON post_id = source_post_id GROUP BY 1) WHERE r < {RESOLVED}", "links hposts")
cte("h7", f"SELECT post_id, 'thin_high_bounce' AS problem_type, 'high' AS severity, avg(bounce_rate) AS value FROM ga4 WHERE date >= {A} - 90 AND post_id IN (SELECT post_id FROM hposts) GROUP BY 1 HAVING avg(bounce_rate) > 0.1 AND avg(avg_time) < 50", "ga4 hposts")
cte("h16", "SELECT post_id, 'duplicate_content' AS problem_type, 'critical' AS severity, f::DOUBLE AS value FROM (SELECT post_id, min(post_id) OVER (PARTITION BY site_id, content_hash) AS f FROM hposts) WHERE post_id <> f", "hposts")
cte("hall", """
SELECT *, row_number() OVER (PARTITION BY post_id, problem_type ORDER BY rule DESC) AS rn FROM (SELECT *, 0 AS rule FROM h1 UNION ALL SELECT *, 1 FROM h2 UNION ALL SELECT *, 2 FROM h3 UNION ALL SELECT *, 3 FROM h4 UNION ALL SELECT *, 4 FROM h5 UNION ALL SELECT *, 5 FROM h6 UNION ALL SELECT *, 6 FROM h7
  UNION ALL SELECT *, 7 FROM h8 WHERE problem_type <> 'seo_no_internal_links' OR post_id IN (SELECT post_id FROM hposts WHERE site_id NOT IN (FROM gated)) UNION ALL SELECT *, 8 FROM h9 WHERE post_id IN (SELECT post_id FROM hposts WHERE site_id NOT IN (FROM gated))
  UNION ALL SELECT *, 9 FROM h10 UNION ALL SELECT *, 10 FROM h12 UNION ALL SELECT *, 11 FROM h16)
""", "h1 h2 h3 h4 h5 h6 h7 h8 h9 h10 h12 h16 hposts gated")
cte("hmerged", f"""
SELECT h.post_id, h.problem_type, h.severity, h.value, CASE h.problem_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in pb.WEIGHTS.items())} ELSE 50 END::INTEGER AS severity_score, {A} AS detected_at, coalesce(o.detected_at, {A}) AS first_detected_at
FROM hall h LEFT JOIN (SELECT post_id, problem_type, min(detected_at) AS detected_at FROM problems GROUP BY 1, 2) o USING (post_id, problem_type) WHERE rn = 1
""", "hall problems")
cte("hgroup", "SELECT m.*, CASE WHEN problem_type = 'thin_below_cluster_avg' AND post_id IN (SELECT post_id FROM hmerged WHERE problem_type = 'thin_content') THEN 'thin_content' END AS related_to FROM hmerged m WHERE NOT (problem_type = 'seo_no_internal_links' AND post_id IN (SELECT post_id FROM hmerged WHERE problem_type = 'orphan'))", "hmerged")


def parts(t: Tables, posts):
    return pb.detectors(
        posts, t.gsc, t.ga4, t.links, t.post_clusters, posts, industries(t), AS_OF, days=10, velocity_days=15, bounce=0.1, seconds=50, least_resolved=RESOLVED,
    )


@query("h9_gated_sites", "SELECT site_id FROM gated", "gated")
def h9b(t: Tables):
    return pb.unreliable_sites(hposts(t), t.links, RESOLVED)


def known(t: Tables):
    return t.problems.withColumn("first_detected_at", F.col("detected_at"))


@query("h13_group_related", "SELECT post_id, problem_type, related_to FROM hgroup", "hgroup")
def h13(t: Tables):
    return pb.detect_all(parts(t, scanned(t)), known(t), AS_OF).select("post_id", "problem_type", "related_to")


@query("h14_severity_score", f"SELECT problem_type, CASE problem_type {' '.join(f'''WHEN '{k}' THEN {v}''' for k, v in pb.WEIGHTS.items())} ELSE 50 END::INTEGER AS severity_score, count(*) AS n FROM problems GROUP BY 1, 2", "problems")
def h14(t: Tables):
    return t.problems.groupBy("problem_type", pb.severity_score(F.col("problem_type")).alias("severity_score")).agg(F.count("*").alias("n"))


@query("h15_merge_problems", "SELECT post_id, problem_type, severity, round(value, 6) AS value, severity_score, detected_at, first_detected_at FROM hgroup", "hgroup")
def h15(t: Tables):
    return R(pb.detect_all(parts(t, scanned(t)), known(t), AS_OF).drop("related_to"))


@query("h16_duplicate_problems", "SELECT post_id, 'duplicate_content' AS problem_type, 'critical' AS severity, f::DOUBLE AS value FROM (SELECT post_id, min(post_id) OVER (PARTITION BY content_hash) AS f FROM posts) WHERE post_id <> f", "posts")
def h16(t: Tables):
    return pb.duplicate_problems(t.posts.withColumn("site_id", F.lit("all")))


@query("h17_family_counts", """
SELECT site_id, CASE WHEN problem_type LIKE 'decay%' THEN 'decay' WHEN problem_type LIKE 'thin%' THEN 'thin' WHEN problem_type LIKE 'seo%' THEN 'seo' WHEN problem_type = 'orphan' THEN 'orphan' WHEN problem_type LIKE 'readability%' THEN 'readability'
  WHEN problem_type LIKE 'velocity%' THEN 'velocity' WHEN problem_type = 'duplicate_content' THEN 'duplicate' ELSE 'other' END AS family, count(*) AS n FROM hgroup JOIN hposts USING (post_id) GROUP BY 1, 2
""", "hgroup hposts")
def h17(t: Tables):
    posts = scanned(t)
    return pb.family_counts(pb.detect_all(parts(t, posts), known(t), AS_OF), posts)


@query("h18_problem_listing", """
SELECT post_id, problem_type, severity FROM problems WHERE resolved_at IS NULL AND severity <> '' ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END, post_id, problem_type LIMIT 150 OFFSET 20
""", "problems")
def h18(t: Tables):
    return pb.list_problems(t.problems, limit=150, offset=20).select("post_id", "problem_type", "severity")


@query("h18_problem_listing_by_weight", f"""
SELECT post_id, problem_type, severity FROM problems WHERE resolved_at IS NULL AND severity = 'high' ORDER BY CASE problem_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in pb.WEIGHTS.items())} ELSE 50 END DESC, post_id, problem_type LIMIT 100
""", "problems")
def h18b(t: Tables):
    return pb.list_problems(t.problems, severity="high", by="weight", limit=100).select("post_id", "problem_type", "severity")
