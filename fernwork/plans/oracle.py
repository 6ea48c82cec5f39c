"""DuckDB text of the logical tables, and the query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import Tables

CTES: dict[str, tuple[str, str]] = {}
QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, tuple[str, str]] = {}


def cte(name: str, sql: str, uses: str = "") -> None:
    CTES[name] = (uses, sql.strip())


def with_tables(body: str, uses: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for m in CTES[n][0].split():
            visit(m)
        order.append(n)

    for n in uses.split():
        visit(n)
    body = body.strip()
    if not order:
        return body
    parts = [f"{n} AS ({CTES[n][1]})" for n in order]
    recursive = "RECURSIVE " if "WITH RECURSIVE" in body.upper() else ""
    if body.upper().startswith("WITH RECURSIVE"):
        body = body[len("WITH RECURSIVE"):]
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body
    if body.upper().startswith("WITH"):
        return "WITH " + recursive + ",\n".join(parts) + ",\n" + body[4:]
    return "WITH " + ",\n".join(parts) + "\n" + body


def query(name: str, sql: str | None = None, uses: str = ""):
    """Register a query and its DuckDB twin."""

    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = (sql, uses)
        return fn

    return deco


def runner(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: fn(Tables(spark, folder))


AS_OF = "DATE '2024-01-31'"

cte("posts", r"""
SELECT doc_id AS post_id, source AS site_id,
  'https://' || source || '.example.com/blog/' || regexp_replace(lower(regexp_extract(text, '^[^.\n]*', 0)), '[^a-z0-9]+', '-', 'g') || '-' || doc_id AS url,
  regexp_extract(text, '^[^.\n]*', 0) AS title, text AS body_text,
  array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN len(regexp_extract_all(x, '\S+')) BETWEEN 1 AND 6 THEN '<h2>' || x || '</h2>' ELSE '<p>' || x || '</p>' END), chr(10)) AS body_html,
  list_transform(list_filter(string_split(text, chr(10)), lambda x: len(regexp_extract_all(x, '\S+')) BETWEEN 1 AND 6), lambda x: {'level': 'h2', 'text': regexp_replace(x, '^\s+|\s+$', '', 'g')}) AS headings,
  DATE '2024-01-31' - CAST(doc_id * 37 % 1200 AS INTEGER) AS publish_date,
  CASE WHEN doc_id % 3 <> 0 THEN least(DATE '2024-01-31', DATE '2024-01-31' - CAST(doc_id * 37 % 1200 AS INTEGER) + CAST(doc_id * 13 % 400 AS INTEGER)) END AS modified_date,
  CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS word_count,
  CASE WHEN doc_id % 4 <> 0 THEN nullif(regexp_extract(text, '\n([^.\n]*)', 1), '') END AS meta_description,
  lang AS language,
  CASE WHEN doc_id % 17 = 0 THEN 'landing' WHEN doc_id % 19 = 0 THEN 'product' WHEN doc_id % 23 = 0 THEN 'glossary' ELSE 'blog' END AS page_type,
  ['informational','commercial','transactional','navigational'][doc_id % 4 + 1] AS content_intent,
  sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS content_hash
FROM documents
""")
cte("emb", "SELECT vec_id AS post_id, embedding::DOUBLE[] AS vec, label AS cluster_id FROM embeddings")
cte("post_clusters", "SELECT vec_id AS post_id, label AS cluster_id FROM embeddings")
cte("clusters", "SELECT cluster_id, 'cluster ' || cluster_id AS label, CASE WHEN cluster_id >= 8 THEN 0 END AS parent_cluster_id, count(*) AS post_count FROM post_clusters GROUP BY cluster_id", "post_clusters")
cte("ev", "SELECT event_id, ts, ts::DATE AS date, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
cte("ga4", """
SELECT k AS post_id, date, count(*) FILTER (event_type = 'view') AS pageviews, count(DISTINCT user_id) AS sessions,
  count(*) FILTER (event_type = 'click') AS engaged_sessions, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS bounce_rate,
  round(avg(value), 6) AS avg_time
FROM ev GROUP BY k, date
""", "ev")
cte("gsc", """
SELECT *, clicks / impressions AS ctr FROM (
SELECT user_id AS post_id, date, 'q' || k AS query, count(*) AS impressions, count(*) FILTER (event_type = 'click') AS clicks,
  round(least(100.0, 1 + avg(value)), 6) + 1e-9::DOUBLE AS avg_position
FROM ev GROUP BY user_id, date, k)
""", "ev")
cte("links", """
SELECT DISTINCT user_id AS source_post_id,
  CASE WHEN event_type = 'click' THEN 'https://site.example.com/p/' || k WHEN k % 2 = 0 THEN 'https://site.example.com/gone/' || k ELSE 'https://partner.example.org/' || k END AS target_url,
  CASE WHEN event_type = 'click' THEN k END AS target_post_id
FROM ev WHERE event_type IN ('click', 'signup')
""", "ev")
cte("scores", """
SELECT post_id, cluster_id, coalesce(traffic, 0) AS traffic, comp AS composite_score,
  round((post_id * 31 % 1000) / 10, 1) AS traffic_score, round((post_id * 57 % 1000) / 10, 1) AS ranking_score,
  round((post_id * 91 % 1000) / 10, 1) AS freshness_score, round((post_id * 113 % 1000) / 10, 1) AS content_depth_score,
  CASE WHEN post_id % 9 <> 0 THEN (post_id * 17 % 101)::DOUBLE END AS ai_citability_score,
  CASE WHEN post_id % 7 <> 0 THEN (post_id * 29 % 101)::DOUBLE END AS eeat_score,
  (post_id * 41 % 101)::DOUBLE AS schema_score, (post_id * 53 % 101)::DOUBLE AS extraction_score,
  ['growing','stable','declining','dead','unknown'][post_id % 5 + 1] AS trend,
  CASE WHEN comp >= 80 THEN 'pillar' WHEN comp >= 50 THEN 'supporter' WHEN post_id % 6 = 0 THEN 'competitor' WHEN comp >= 25 THEN 'supporter' ELSE 'dead_weight' END AS role,
  round((post_id * 7 % 1000) / 1000, 3) AS pagerank
FROM (SELECT c.*, round(10 + (c.post_id * 7919 % 8500) / 100, 2) AS comp, t.traffic FROM post_clusters c
  LEFT JOIN (SELECT k AS post_id, count(*) AS traffic FROM ev WHERE event_type = 'view' GROUP BY k) t USING (post_id))
""", "post_clusters ev")
cte("pairs", """
SELECT post_a_id, post_b_id, cluster_id, cosine, post_a_id * 3 % 7 AS n_shared,
  CASE WHEN cosine >= 0.9 THEN 'critical' WHEN cosine >= 0.75 THEN 'high' WHEN cosine >= 0.6 THEN 'medium' ELSE 'low' END AS severity,
  round(cosine * 100, 1) AS severity_score,
  CASE WHEN cosine >= 0.9 THEN 'redirect' WHEN cosine >= 0.75 THEN 'merge' WHEN cosine >= 0.6 THEN 'differentiate' ELSE 'monitor' END AS resolution,
  CASE WHEN post_a_id % 2 = 0 THEN post_a_id ELSE post_b_id END AS stronger_post_id,
  DATE '2024-01-31' - CAST(post_a_id % 40 AS INTEGER) AS created_at
FROM (SELECT a.post_id AS post_a_id, b.post_id AS post_b_id, a.cluster_id,
    round(0.4::DOUBLE + (a.post_id * 37 + step * 11) % 600 / 1000, 3) AS cosine
  FROM post_clusters a, (VALUES (10), (30)) s(step), post_clusters b WHERE b.post_id = a.post_id + step)
""", "post_clusters")
cte("problems", """
SELECT post_id, cluster_id, ['traffic_decay','thin_content','seo_no_meta','orphan_page','readability_low','weak_eeat'][(post_id + n * 2) % 6 + 1] AS problem_type,
  ['low','medium','high','critical'][(post_id + n) % 4 + 1] AS severity,
  DATE '2024-01-31' - CAST(post_id % 45 AS INTEGER) AS detected_at,
  CASE WHEN post_id % 5 = 0 THEN DATE '2024-01-31' - CAST(post_id % 11 AS INTEGER) END AS resolved_at
FROM (SELECT post_id, cluster_id, unnest(range(post_id % 3 + 1)) AS n FROM post_clusters)
""", "post_clusters")
cte("recs", """
SELECT post_id * 100 + length(problem_type) AS rec_id, post_id, cluster_id,
  ['optimize','update','merge','redirect','growth','interlink'][h % 6 + 1] AS rec_type,
  ['critical','high','medium','low'][h % 4 + 1] AS priority, ['low','medium','high'][h % 3 + 1] AS effort,
  'Fix ' || problem_type AS title, ['pending','in_progress','completed','dismissed'][h % 4 + 1] AS status,
  DATE '2024-01-31' - CAST(post_id % 30 AS INTEGER) AS created_at,
  CASE WHEN h % 4 = 2 THEN DATE '2024-01-31' - CAST(post_id % 20 AS INTEGER) END AS completed_at
FROM (SELECT *, post_id * 5 + length(problem_type) AS h FROM problems)
""", "problems")
cte("history", """
SELECT user_id % 5 AS site_id, date, round(avg(least(value, 100.0)) + 1e-7, 2) AS score,
  round(avg(least(value, 100.0)) FILTER (event_type = 'view') + 1e-7, 2) AS traffic,
  round(avg(least(value, 100.0)) FILTER (event_type = 'click') + 1e-7, 2) AS ranking,
  round(avg(least(value, 100.0)) FILTER (event_type = 'purchase') + 1e-7, 2) AS engagement,
  count(*) AS total_posts, count(*) FILTER (event_type = 'error') AS problems
FROM ev GROUP BY 1, 2
""", "ev")
cte("cstates", """
SELECT c.*, health_score, ['swamp','desert','forest','seedbed','meadow'][c.cluster_id % 5 + 1] AS ecosystem_state FROM clusters c JOIN (SELECT cluster_id, round(avg(composite_score), 6) AS health_score FROM scores GROUP BY 1) h USING (cluster_id)
""", "clusters scores")

# five sites: the same tables with a site key, by id
cte("sposts", "SELECT * REPLACE (post_id % 5 AS site_id) FROM posts", "posts")
for _name in ("scores", "problems", "recs", "gsc", "ga4"):
    cte(f"s{_name}", f"SELECT *, post_id % 5 AS site_id FROM {_name}", _name)
cte("spairs", "SELECT *, post_a_id % 5 AS site_id FROM pairs", "pairs")
cte("sclusters", "SELECT *, (cluster_id % 5)::BIGINT AS site_id FROM clusters", "clusters")
cte("scstates", "SELECT *, (cluster_id % 5)::BIGINT AS site_id FROM cstates", "cstates")
cte("sites", "SELECT unnest(range(5)) AS site_id")
