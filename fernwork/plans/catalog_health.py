"""Checks of the health operators (group G)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import health as h
from ..operators import scoring as sc
from . import sqltext as q
from .oracle import CTES, cte, query
from .tables import AS_OF, Tables

UNIT = 10  # days per period: the events span one month
A = "DATE '2024-01-31'"
R = lambda c: F.round(c, 6).alias(c)


def _w(f: str) -> str:
    live = {k: (f"CASE WHEN {h.NEEDS[k]} THEN {w} ELSE 0 END" if k in h.NEEDS else f"{w}") for k, w in h.FULL_WEIGHTS.items()}
    tot = "(" + " + ".join(f"({v})" for v in live.values()) + ")::DOUBLE"
    part = f"({live[f]})::DOUBLE / {tot}" if f in live else "0.0::DOUBLE"
    return f"CASE WHEN NOT has_ga4 AND NOT has_gsc THEN {h.CRAWL_WEIGHTS.get(f, 0.0)}::DOUBLE ELSE {part} END"


cte("avail", """
SELECT site_id, bool_or(post_id IN (SELECT post_id FROM ga4)) AS has_ga4, bool_or(post_id IN (SELECT post_id FROM gsc)) AS has_gsc FROM posts GROUP BY site_id
""", "posts ga4 gsc")


@query("g1_factor_weights", f"SELECT DISTINCT has_ga4, has_gsc, {', '.join(f'round({_w(f)}, 6) AS {f}' for f in h.FACTORS)} FROM (SELECT o_orderkey % 2 = 0 AS has_ga4, o_custkey % 2 = 0 AS has_gsc FROM orders)")
def g1(t: Tables):
    flags = t.raw("orders").select((F.col("o_orderkey") % 2 == 0).alias("has_ga4"), (F.col("o_custkey") % 2 == 0).alias("has_gsc")).distinct()
    w = h.factor_weights(F.col("has_ga4"), F.col("has_gsc"))
    return flags.select("has_ga4", "has_gsc", *[F.round(w[f], 6).alias(f) for f in h.FACTORS])


@query("g2_data_availability", "SELECT *, CASE WHEN has_ga4 AND has_gsc THEN 'full' WHEN has_ga4 OR has_gsc THEN 'partial' ELSE 'crawl_only' END AS mode FROM avail", "avail")
def g2(t: Tables):
    return h.data_availability(t.posts, t.ga4, t.gsc)


cte("shortf", """
SELECT site_id, quantile_cont(word_count, 0.5) AS median_wc, stddev(word_count) AS stddev_wc, quantile_cont(word_count, 0.5) < 600 AND coalesce(stddev(word_count), 500) < 400 AS is_short_form FROM posts WHERE word_count > 50 GROUP BY site_id
""", "posts")


@query("g3_short_form", "SELECT site_id, median_wc, round(stddev_wc, 6) AS stddev_wc, is_short_form FROM shortf", "shortf")
def g3(t: Tables):
    return h.short_form(t.posts, ["site_id"]).withColumn("stddev_wc", F.round("stddev_wc", 6))


cte("win", f"""
SELECT post_id, coalesce(sum(pageviews) FILTER (date >= {A} - {UNIT}), 0)::BIGINT AS recent, coalesce(sum(pageviews) FILTER (date >= {A} - {2 * UNIT} AND date < {A} - {UNIT}), 0)::BIGINT AS prev,
  coalesce(sum(pageviews) FILTER (date >= {A} - {2 * UNIT}), 0)::BIGINT AS two, coalesce(sum(pageviews) FILTER (date >= {A} - {3 * UNIT}), 0)::BIGINT AS three FROM ga4 WHERE date >= {A} - {3 * UNIT} GROUP BY post_id
""", "ga4")


@query("g4_traffic_windows", "SELECT * FROM win", "win")
def g4(t: Tables):
    return h.traffic_windows(t.ga4, AS_OF, UNIT)


def trend_sql(r="recent", p="prev", t="two"):
    ch = f"({r} - {p}) / nullif({p}, 0)"
    kind = f"CASE WHEN {t} = 0 AND {p} = 0 AND {r} = 0 THEN 'unknown' WHEN {t} < 5 THEN 'dead' WHEN {p} = 0 AND {r} > 0 THEN 'growing' WHEN {p} = 0 THEN 'stable' WHEN {ch} > 0.15 THEN 'growing' WHEN {ch} < -0.15 THEN 'declining' ELSE 'stable' END"
    sc_ = f"CASE WHEN {t} = 0 AND {p} = 0 AND {r} = 0 THEN 30 WHEN {t} < 5 THEN 0 WHEN {p} = 0 AND {r} > 0 THEN 100 WHEN {p} = 0 THEN 30 WHEN {ch} > 0.15 THEN least(100, 75 + {ch} * 50) WHEN {ch} < -0.15 THEN greatest(0, 25 + {ch} * 50) ELSE 50 END::DOUBLE"
    return kind, sc_


K, S = trend_sql()


@query("g5_traffic_trend", f"SELECT post_id, {K} AS trend, round({S}, 6) AS score FROM win", "win")
def g5(t: Tables):
    w = h.traffic_windows(t.ga4, AS_OF, UNIT).withColumn("x", h.traffic_trend(F.col("recent"), F.col("prev"), F.col("two")))
    return w.select("post_id", "x.trend", F.round("x.score", 6).alias("score"))


RANK = "CASE WHEN {0} <= 1 THEN 100 WHEN {0} >= 50 THEN 0 ELSE 100 * pow(1 - ({0} - 1) / 49, 1.5) END::DOUBLE"


@query("g6_ranking_score", f"SELECT post_id, round(p, 6) AS avg_position, round({RANK.format('p')}, 6) AS score FROM (SELECT post_id, avg(avg_position) AS p FROM gsc WHERE date >= {A} - 30 GROUP BY 1)", "gsc")
def g6(t: Tables):
    p = t.gsc.filter(F.col("date") >= F.date_sub(F.lit(AS_OF).cast("date"), 30)).groupBy("post_id").agg(F.avg("avg_position").alias("p"))
    return p.select("post_id", F.round("p", 6).alias("avg_position"), F.round(h.ranking_score(F.col("p")), 6).alias("score"))


ENG = "(0.4::DOUBLE * greatest(0, (1 - CASE WHEN coalesce({0}, 0) = 0 THEN 0.5 ELSE {0} END) * 100) + 0.6::DOUBLE * least(100, CASE WHEN coalesce({1}, 0) = 0 THEN 60 ELSE {1} END / 300 * 100))"


@query("g7_engagement_score", f"SELECT post_id, round({ENG.format('b', 's')}, 6) AS score FROM (SELECT post_id, avg(bounce_rate) AS b, avg(avg_time) AS s FROM ga4 GROUP BY 1)", "ga4")
def g7(t: Tables):
    v = t.ga4.groupBy("post_id").agg(F.avg("bounce_rate").alias("b"), F.avg("avg_time").alias("s"))
    return v.select("post_id", F.round(h.engagement_score(F.col("b"), F.col("s")), 6).alias("score"))


SENS = "regexp_matches(lower(title || ' ' || url), '20[12]\\d|best |top |ranking|pricing|review')"


@query("g8_time_sensitive", f"SELECT post_id, {SENS} AS sensitive FROM titled", "titled")
def g8(t: Tables):
    from .catalog_scoring import titled

    return titled(t).select("post_id", h.time_sensitive(F.col("title"), F.col("url")).alias("sensitive"))


FRESH = f"""CASE WHEN upd IS NULL THEN 35 WHEN date_diff('day', upd, {A}) / 30.44 < 0.5 THEN 100
  ELSE greatest(CASE WHEN sens THEN 10 ELSE 30 END, 100 * pow(0.5::DOUBLE, date_diff('day', upd, {A}) / 30.44 / CASE WHEN sens THEN 6 ELSE 12 END)) END::DOUBLE"""


@query("g9_freshness", f"SELECT post_id, round({FRESH}, 6) AS score FROM (SELECT p.post_id, modified_date AS upd, regexp_matches(lower(t.title || ' ' || t.url), '20[12]\\d|best |top |ranking|pricing|review') AS sens FROM posts p JOIN titled t USING (post_id))", "posts titled")
def g9(t: Tables):
    from .catalog_scoring import titled

    df = titled(t).join(t.posts.select("post_id", "modified_date"), "post_id")
    s = h.freshness_score(F.col("modified_date"), AS_OF, h.time_sensitive(F.col("title"), F.col("url")))
    return df.select("post_id", F.round(s, 6).alias("score"))


def bonus_sql(x="body_html"):
    low = f"lower({x})"
    return f"""least(15.0, least(3.0, {q.n(low, '<li')} * 0.3) + least(3.0, {q.n(low, chr(92) + 'd+(?:' + chr(92) + '.' + chr(92) + 'd+)?(?:%|' + chr(92) + '$|percent)')} * 0.5)
  + CASE WHEN contains({low}, '<pre') OR contains({low}, '<code') THEN 2 ELSE 0 END + CASE WHEN contains({low}, '<table') THEN 2 ELSE 0 END
  + least(3.0, {q.n(low, 'href=["' + "''" + ']https?://')} * 0.3) + CASE WHEN regexp_matches({low}, '<img|<picture|<figure') THEN 2 ELSE 0 END)::DOUBLE"""


@query("g10_quality_bonus", f"SELECT post_id, round({bonus_sql()}, 6) AS bonus FROM articles", "articles")
def g10(t: Tables):
    from .catalog_extract import articles

    return articles(t).select("post_id", F.round(h.quality_bonus(F.col("body_html")), 6).alias("bonus"))


DEPTH = """least(100, {bonus} + CASE WHEN short THEN 0.35::DOUBLE * brief + 0.65::DOUBLE * rel ELSE 0.5::DOUBLE * lng + 0.5::DOUBLE * rel END)"""
CURVES = """SELECT *, CASE WHEN w < 50 THEN w / 50 * 5 WHEN w < 200 THEN 20 + (w - 50) / 150 * 20 WHEN w < 500 THEN 40 + (w - 200) / 300 * 30 ELSE least(100, 70 + (w - 500) / 500 * 30) END AS brief,
  CASE WHEN w >= 100 THEN least(100, w / 2500 * 100) ELSE w / 100 * 5 END AS lng,
  CASE WHEN r < 0.3 THEN 5 WHEN r < 0.5 THEN 5 + (r - 0.3) * 75 WHEN r < 1 THEN 20 + (r - 0.5) * 60 WHEN r < 1.5 THEN 50 + (r - 1) * 60 WHEN r < 2 THEN 80 + (r - 1.5) * 30 ELSE least(100, 95 + (r - 2) * 5) END AS rel"""
cte("depth", f"""
SELECT post_id, {DEPTH.format(bonus=bonus_sql())} AS score FROM ({CURVES} FROM (SELECT a.post_id, body_html, word_count::DOUBLE AS w, word_count / avg_wc AS r, coalesce(is_short_form, false) AS short
  FROM articles a JOIN (SELECT site_id, avg(word_count) AS avg_wc FROM posts GROUP BY 1) m USING (site_id) LEFT JOIN shortf USING (site_id)))
""", "articles posts shortf")


@query("g11_depth_score", "SELECT post_id, round(score, 6) AS score FROM depth", "depth")
def g11(t: Tables):
    from .catalog_extract import articles

    a = articles(t)
    avg = t.posts.groupBy("site_id").agg(F.avg("word_count").alias("avg_wc"))
    df = a.join(avg, "site_id").join(h.short_form(t.posts, ["site_id"]).select("site_id", "is_short_form"), "site_id", "left")
    s = h.depth_score(F.col("word_count"), F.col("avg_wc"), h.quality_bonus(F.col("body_html")), F.coalesce("is_short_form", F.lit(False)))
    return df.select("post_id", F.round(s, 6).alias("score"))


@query("g12_link_score", """
SELECT post_id, cluster_id, round(least(100, coalesce(n, 0) / greatest(max(coalesce(n, 0)) OVER (PARTITION BY cluster_id), 1) * 100), 6) AS score
FROM post_clusters LEFT JOIN (SELECT target_post_id AS post_id, count(*) AS n FROM links WHERE target_post_id IS NOT NULL GROUP BY 1) USING (post_id)
""", "post_clusters links")
def g12(t: Tables):
    n = t.links.filter("target_post_id IS NOT NULL").groupBy(F.col("target_post_id").alias("post_id")).agg(F.count("*").alias("n"))
    df = t.post_clusters.join(n, "post_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    top = df.groupBy("cluster_id").agg(F.max("n").alias("m"))
    return df.join(top, "cluster_id").select(
        "post_id", "cluster_id", F.round(F.least(F.lit(100.0), F.col("n") / F.greatest("m", F.lit(1)) * 100), 6).alias("score")
    )


@query("g13_technical_score", f"""
SELECT post_id, 12.5::DOUBLE * ((coalesce(length({q.strip('meta_description')}), 0) > 10)::INT + CASE WHEN length({q.strip('title')}) BETWEEN 30 AND 60 THEN 1 WHEN length({q.strip('title')}) BETWEEN 20 AND 70 THEN 0.5 ELSE 0 END
  + (len(headings) > 0)::INT + (post_id IN (SELECT source_post_id FROM links))::INT + (post_id IN (SELECT target_post_id FROM links WHERE target_post_id IS NOT NULL))::INT
  + (post_id % 6 = 0)::INT + (post_id % 5 < 2)::INT + (post_id % 6 = 0)::INT) AS score FROM posts
""", "posts links")
def g13(t: Tables):
    from .catalog_scoring import trusted
    from ..operators.graph import link_counts

    n = link_counts(t.posts, t.links)
    c = F.col
    s = h.technical_score(
        c("meta_description"), c("title"), c("headings"), c("outbound") > 0, c("inbound") > 0,
        c("trust.has_og_tags"), c("trust.has_jsonld"), c("trust.has_canonical"), c("body_html"),
    )
    return trusted(t).join(n, "post_id").select("post_id", s.alias("score"))


PRED = """least(100, (CASE WHEN regexp_matches(body_html, '<img|<picture|<figure|data-src') THEN 20 ELSE 0 END + CASE WHEN contains(body_html, '<li') THEN 15 ELSE 0 END
  + CASE WHEN fre BETWEEN 60 AND 80 THEN 20 WHEN fre BETWEEN 40 AND 90 THEN 10 ELSE 0 END + CASE WHEN len(headings) >= 5 THEN 15 WHEN len(headings) >= 3 THEN 10 ELSE 0 END
  + CASE WHEN len(headings) >= 6 AND contains(lower(body_html), 'table of contents') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(body_html, '<pre|<code') THEN 10 ELSE 0 END) * (100.0::DOUBLE / 90.0))"""
STRU = f"""least(100, CASE WHEN word_count > 0 THEN CASE WHEN len(headings) / (word_count / 500) >= 1.5 THEN 25 WHEN len(headings) / (word_count / 500) >= 0.8 THEN 15 WHEN len(headings) / (word_count / 500) >= 0.4 THEN 8 ELSE 0 END ELSE 0 END
  + CASE WHEN {q.n('body_html', '<li')} >= 10 THEN 20 WHEN {q.n('body_html', '<li')} >= 5 THEN 12 WHEN {q.n('body_html', '<li')} >= 2 THEN 5 ELSE 0 END
  + CASE WHEN {q.n('body_html', '<img|<picture|<figure')} >= 5 THEN 20 WHEN {q.n('body_html', '<img|<picture|<figure')} >= 2 THEN 12 WHEN {q.n('body_html', '<img|<picture|<figure')} >= 1 THEN 5 ELSE 0 END
  + CASE WHEN contains(body_html, '<table') THEN 15 ELSE 0 END + CASE WHEN {q.n('body_html', 'href="http')} >= 5 THEN 15 WHEN {q.n('body_html', 'href="http')} >= 2 THEN 8 ELSE 0 END
  + CASE WHEN contains(body_html, '<blockquote') THEN 5 ELSE 0 END)::DOUBLE"""


@query("g14_predicted_engagement", f"SELECT a.post_id, round({PRED}, 6) AS score FROM articles a JOIN (SELECT post_id, fre FROM readable) r USING (post_id)", "articles readable")
def g14(t: Tables):
    from .catalog_extract import articles

    a = sc.readability(articles(t))
    return a.select("post_id", F.round(h.predicted_engagement(F.col("body_html"), F.col("reading_ease"), F.size("headings")), 6).alias("score"))


@query("g15_structure_score", f"SELECT post_id, {STRU} AS score FROM articles", "articles")
def g15(t: Tables):
    from .catalog_extract import articles

    return articles(t).select("post_id", h.structure_score(F.col("body_html"), F.col("word_count"), F.size("headings")).alias("score"))


PM = "SELECT post_id FROM (SELECT post_a_id AS post_id, severity FROM pairs UNION ALL SELECT post_b_id, severity FROM pairs) WHERE severity IN ('medium','high','critical')"
# of the sites, two have no facts at all and two no visits
CRAWLED, PARTIAL = ["src1", "src2"], ["src3", "src4"]
WITHOUT = lambda sites: ", ".join(f"'{x}'" for x in sites)
cte("hga4", f"SELECT * FROM ga4 WHERE post_id NOT IN (SELECT post_id FROM posts WHERE site_id IN ({WITHOUT(CRAWLED + PARTIAL)}))", "ga4 posts")
cte("hgsc", f"SELECT * FROM gsc WHERE post_id NOT IN (SELECT post_id FROM posts WHERE site_id IN ({WITHOUT(CRAWLED)}))", "gsc posts")
for _name in ("avail", "win"):
    _uses, _sql = CTES[_name]
    _swap = lambda x: re.sub(r"\b(ga4|gsc)\b", r"h\1", x)
    cte(f"h{_name}", _swap(_sql), _swap(_uses))
cte("hbase", f"""
SELECT a.post_id, a.site_id, c.cluster_id, a.title, a.url, a.body_html, a.headings, a.word_count, a.meta_description, a.page_type, a.publish_date, a.modified_date, fre, has_ga4, has_gsc, coalesce(is_short_form, false) AS short,
  coalesce(recent, 0) AS recent, coalesce(prev, 0) AS prev, coalesce(two, 0) AS two, coalesce(three, 0) AS three, pos, b, s, coalesce(li, 0) AS inbound, coalesce(lo, 0) AS outbound,
  ai_citability_score AS a1, eeat_score AS a2, schema_score AS a3, extraction_score AS a4, a.post_id IN ({PM}) AS rival
FROM articles a JOIN post_clusters c ON c.post_id = a.post_id JOIN (SELECT post_id, fre FROM readable) r ON r.post_id = a.post_id JOIN havail v ON v.site_id = a.site_id LEFT JOIN shortf sf ON sf.site_id = a.site_id
LEFT JOIN hwin w ON w.post_id = a.post_id LEFT JOIN (SELECT post_id, avg(avg_position) AS pos FROM hgsc WHERE date >= {A} - {3 * UNIT} GROUP BY 1) g ON g.post_id = a.post_id
LEFT JOIN (SELECT post_id, avg(bounce_rate) AS b, avg(avg_time) AS s FROM hga4 WHERE date >= {A} - {3 * UNIT} GROUP BY 1) e ON e.post_id = a.post_id
LEFT JOIN (SELECT target_post_id AS post_id, count(*) AS li FROM links WHERE target_post_id IS NOT NULL GROUP BY 1) i ON i.post_id = a.post_id
LEFT JOIN (SELECT source_post_id AS post_id, count(*) AS lo FROM links GROUP BY 1) o ON o.post_id = a.post_id LEFT JOIN scores x ON x.post_id = a.post_id WHERE a.word_count >= 100
""", "articles post_clusters readable havail shortf hwin hgsc hga4 links scores pairs")
cte("hfac", f"""
WITH m AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY cluster_id) >= 3 THEN avg(word_count) OVER (PARTITION BY cluster_id) ELSE 1000 END AS cavg, max(inbound) OVER (PARTITION BY cluster_id) AS mi,
   sum(three) OVER (PARTITION BY cluster_id) AS tot, word_count::DOUBLE AS w, coalesce(modified_date, publish_date) AS upd, {SENS} AS sens FROM hbase),
k AS ({CURVES} FROM (SELECT *, word_count / cavg AS r FROM m))
SELECT post_id, site_id, cluster_id, {K} AS trend, {S} AS traffic_trend, {RANK.format('coalesce(pos, 100.0)')} AS ranking, {ENG.format('b', 's')} AS engagement, {FRESH} AS freshness, {DEPTH.format(bonus=bonus_sql())} AS content_depth,
  least(100, inbound / greatest(mi, 1) * 100) AS internal_links,
  12.5::DOUBLE * ((coalesce(length({q.strip('meta_description')}), 0) > 10)::INT + CASE WHEN length({q.strip('title')}) BETWEEN 30 AND 60 THEN 1 WHEN length({q.strip('title')}) BETWEEN 20 AND 70 THEN 0.5 ELSE 0 END
  + (len(headings) > 0)::INT + (outbound > 0)::INT + (inbound > 0)::INT + (post_id % 6 = 0)::INT + (post_id % 5 < 2)::INT + (post_id % 6 = 0)::INT) AS technical_seo,
  CASE WHEN a1 IS NOT NULL THEN list_avg(list_filter([a1, a2, a3, a4], lambda x: x IS NOT NULL)) ELSE 40 END::DOUBLE AS ai_readiness, ({PRED} + {STRU}) / 2 AS content_richness,
  three / CASE WHEN tot > 0 THEN tot ELSE 1 END AS traffic_share, three AS traffic, recent, rival, page_type, publish_date, has_ga4, has_gsc, has_ga4 OR has_gsc AS has_traffic FROM k
""", "hbase")
cte("health0", f"""
SELECT *, greatest(10, least(95, raw)) AS composite_score, CASE WHEN has_traffic THEN CASE WHEN raw < 15 OR recent = 0 THEN 'dead_weight' WHEN rival THEN 'competitor' WHEN traffic_share > 0.25 AND raw >= 40 THEN CASE WHEN page_type IN ('landing','index') THEN 'supporter' ELSE 'pillar' END WHEN raw >= 30 THEN 'supporter' ELSE 'dead_weight' END
  ELSE CASE WHEN rival THEN 'competitor' WHEN raw >= 45 THEN CASE WHEN page_type IN ('landing','index') THEN 'supporter' ELSE 'pillar' END WHEN raw >= 30 THEN 'supporter' WHEN raw >= 15 THEN 'at_risk' ELSE 'dead_weight' END END AS first_role
FROM (SELECT *, {' + '.join(f'({_w(f)}) * {f}' for f in h.FACTORS)} AS raw FROM hfac)
""", "hfac")
cte("health", """
SELECT o.*, CASE WHEN has_traffic OR n < 3 OR first_role = 'competitor' THEN first_role WHEN composite_score >= cut THEN CASE WHEN page_type IN ('landing','index') THEN 'supporter' ELSE 'pillar' END
  WHEN composite_score >= 30 THEN 'supporter' WHEN composite_score >= 15 THEN 'at_risk' ELSE 'dead_weight' END AS role
FROM health0 o LEFT JOIN (SELECT site_id, cluster_id, count(*) AS n, list_sort(list(composite_score))[floor(count(*) * 0.85)::BIGINT + 1] AS cut FROM health0 WHERE NOT has_traffic GROUP BY 1, 2) c ON c.site_id = o.site_id AND c.cluster_id = o.cluster_id
""", "health0")


def health(t: Tables):
    from .catalog_scoring import trusted

    p = sc.readability(trusted(t, "has_og_tags", "has_jsonld", "has_canonical")).withColumns(
        {"og": F.col("trust.has_og_tags"), "jsonld": F.col("trust.has_jsonld"), "canonical": F.col("trust.has_canonical")}
    ).drop("trust", "sentences", "words", "syllables", "grade")
    ai = t.scores.select("post_id", "ai_citability_score", "eeat_score", "schema_score", "extraction_score")
    of = lambda sites: t.posts.filter(F.col("site_id").isin(sites)).select("post_id")
    ga4, gsc = t.ga4.join(of(CRAWLED + PARTIAL), "post_id", "left_anti"), t.gsc.join(of(CRAWLED), "post_id", "left_anti")
    return h.health_job(p, t.post_clusters, ga4, gsc, t.links, t.pairs, ai, AS_OF, UNIT)


@query("g16_composite", "SELECT post_id, round(composite_score, 6) AS composite_score FROM health", "health")
def g16(t: Tables):
    return health(t).select("post_id", R("composite_score"))


@query("g17_traffic_share", "SELECT post_id, round(traffic_share, 6) AS traffic_share FROM hfac", "hfac")
def g17(t: Tables):
    return health(t).select("post_id", R("traffic_share"))


@query("g18_roles", "SELECT post_id, role FROM health", "health")
def g18(t: Tables):
    return health(t).select("post_id", "role")


cte("rr", """
SELECT post_id, CASE WHEN n >= 3 AND role <> 'competitor' THEN CASE WHEN composite_score >= cut THEN CASE WHEN page_type IN ('landing','index') THEN 'supporter' ELSE 'pillar' END
  WHEN composite_score >= 30 THEN 'supporter' WHEN composite_score >= 15 THEN 'at_risk' ELSE 'dead_weight' END ELSE role END AS role
FROM (SELECT s.*, page_type FROM scores s JOIN posts USING (post_id)) JOIN (SELECT cluster_id, count(*) AS n, list_sort(list(composite_score))[floor(count(*) * 0.85)::BIGINT + 1] AS cut FROM scores GROUP BY 1) USING (cluster_id)
""", "scores posts")


@query("g19_rerank", "SELECT post_id, role FROM rr", "rr")
def g19(t: Tables):
    return h.rerank_without_traffic(t.scores.join(t.posts.select("post_id", "page_type"), "post_id")).select("post_id", "role")


CH = "CASE WHEN sum(traffic) > 0 THEN sum(composite_score * traffic) / sum(traffic) ELSE avg(composite_score) END"


@query("g20_cluster_health", f"SELECT cluster_id, round({CH}, 6) AS cluster_health, count(*) AS post_count FROM scores GROUP BY cluster_id", "scores")
def g20(t: Tables):
    return h.cluster_health(t.scores).withColumn("cluster_health", F.round("cluster_health", 6))


def state_sql(src: str, fresh: str) -> str:
    return f"""
SELECT cluster_id, round(ch, 6) AS cluster_health, CASE WHEN coalesce(recent, false) AND n <= 3 THEN 'seedbed' WHEN coalesce(np, 0) / CASE WHEN n > 1 THEN n * (n - 1) / 2 ELSE 1 END > 0.5 THEN 'swamp' WHEN seen AND n > 8 AND NOT pillar THEN 'swamp'
  WHEN seen AND (falling OR av < 5) THEN 'desert' WHEN NOT seen AND af < 25 THEN 'desert' WHEN pillar AND coalesce(np, 0) / CASE WHEN n > 1 THEN n * (n - 1) / 2 ELSE 1 END < 0.2 AND ch > CASE WHEN seen THEN 50 ELSE 38 END THEN 'forest' ELSE 'meadow' END AS ecosystem_state
FROM (SELECT cluster_id, count(*) AS n, bool_or(role = 'pillar') AS pillar, bool_or(publish_date >= DATE '2024-01-31' - 30) AS recent, bool_and(trend IN ('declining','dead')) AS falling, avg(traffic) AS av, avg({fresh}) AS af, bool_or(has_traffic) AS seen, {CH} AS ch FROM {src} GROUP BY 1)
LEFT JOIN (SELECT cluster_id, count(*) AS np FROM pairs WHERE severity IN ('medium','high','critical') GROUP BY 1) USING (cluster_id)"""


def pair_counts(t: Tables):
    return t.pairs.filter(F.col("severity").isin("medium", "high", "critical")).groupBy("cluster_id").agg(F.count("*").alias("n_pairs"))


@query("g21_ecosystem_state", state_sql("health", "freshness"), "health pairs")
def g21(t: Tables):
    return h.ecosystem_state(health(t), pair_counts(t), AS_OF).withColumn("cluster_health", F.round("cluster_health", 6))


cte("patched", f"SELECT s.* REPLACE (CASE WHEN s.post_id IN ({PM}) AND role <> 'pillar' THEN 'competitor' ELSE role END AS role), publish_date, cluster_id % 2 = 0 AS has_traffic FROM scores s JOIN posts p USING (post_id)", "scores pairs posts")


def stored(t: Tables):
    return t.scores.join(t.posts.select("post_id", "publish_date"), "post_id").withColumn("has_traffic", F.col("cluster_id") % 2 == 0)


@query("g22_patch_roles", "SELECT post_id, role FROM patched", "patched")
def g22(t: Tables):
    return h.patch_roles(stored(t), t.pairs).select("post_id", "role")


@query("g22_patch_states", state_sql("patched", "45.0"), "patched pairs")
def g22b(t: Tables):
    return h.patch_states(stored(t), t.pairs, AS_OF).withColumn("cluster_health", F.round("cluster_health", 6))


@query("g23_history_snapshot", """
SELECT cluster_id, round(avg(composite_score), 2) AS score, round(avg(traffic_score), 2) AS traffic, round(avg(ranking_score), 2) AS ranking, round(avg(freshness_score), 2) AS freshness, round(avg(content_depth_score), 2) AS content_depth,
  round(avg(ai_citability_score + coalesce(eeat_score, 0) + coalesce(schema_score, 0) + coalesce(extraction_score, 0)) / 4, 2) AS ai_readiness FROM scores GROUP BY cluster_id
""", "scores")
def g23(t: Tables):
    return h.history_snapshot(t.scores, ["cluster_id"])


@query("g24_health_job", f"SELECT post_id, cluster_id, {', '.join(f'round({f}, 6) AS {f}' for f in h.FACTORS)}, trend, role, round(composite_score, 6) AS composite_score FROM health", "health")
def g24(t: Tables):
    return health(t).select("post_id", "cluster_id", *[R(f) for f in h.FACTORS], "trend", "role", R("composite_score"))


@query("g25_score_distribution", """
SELECT cluster_id, count(*) AS n, round(avg(composite_score), 1) AS mean, round(stddev(composite_score), 1) AS stddev, round(min(composite_score), 1) AS min, round(max(composite_score), 1) AS max,
  round(quantile_cont(composite_score, 0.25), 1) AS p25, round(quantile_cont(composite_score, 0.5), 1) AS median, round(quantile_cont(composite_score, 0.75), 1) AS p75 FROM scores GROUP BY cluster_id
""", "scores")
def g25(t: Tables):
    return h.score_distribution(t.scores, ["cluster_id"])


FC = ["composite_score", "traffic_score", "ranking_score", "freshness_score", "content_depth_score"]


@query("g26_factor_correlation", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(coalesce(corr({a}, {b}), 0), 6) AS r FROM scores" for i, a in enumerate(FC) for b in FC[i + 1:]), "scores")
def g26(t: Tables):
    return h.factor_correlation(t.scores, FC).withColumn("r", F.round("r", 6))
