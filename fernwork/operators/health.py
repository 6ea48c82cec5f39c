"""Composite health scores, roles and cluster states."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.text import clamp, ladder
from ..plans.scale import distributed_rank, durable, exact_percentiles
from .scoring import ai_readiness

# fixed values: factor weights with all data and with crawl data only
FULL_WEIGHTS = {
    "traffic_trend": 0.20, "ranking": 0.18, "engagement": 0.12, "freshness": 0.12,
    "content_depth": 0.10, "internal_links": 0.08, "technical_seo": 0.05, "ai_readiness": 0.15,
}
CRAWL_WEIGHTS = {
    "freshness": 0.15, "content_depth": 0.20, "internal_links": 0.10, "technical_seo": 0.07,
    "ai_readiness": 0.28, "content_richness": 0.20,
}
FACTORS = [*FULL_WEIGHTS, "content_richness"]
NEEDS = {"traffic_trend": "has_ga4", "engagement": "has_ga4", "ranking": "has_gsc"}
STRUCTURAL = ["landing", "index"]


def factor_weights(has_ga4: Column, has_gsc: Column) -> dict[str, Column]:
    """Weight of each factor, rebalanced to sum to one over the data at hand."""
    flags = {"has_ga4": has_ga4, "has_gsc": has_gsc}
    live = {
        f: F.when(flags[NEEDS[f]], F.lit(w)).otherwise(F.lit(0.0)) if f in NEEDS else F.lit(w) for f, w in FULL_WEIGHTS.items()
    }
    total = sum(live.values(), F.lit(0.0))
    none = ~has_ga4 & ~has_gsc
    out = {}
    for f in FACTORS:
        part = live[f] / total if f in live else F.lit(0.0)
        out[f] = F.when(none, F.lit(CRAWL_WEIGHTS.get(f, 0.0))).otherwise(part)
    return out


def data_availability(posts: DataFrame, ga4: DataFrame, gsc: DataFrame) -> DataFrame:
    """Which facts exist per site: has_ga4, has_gsc, mode."""
    has = lambda facts, name: posts.join(facts.select("post_id").distinct(), "post_id", "left_semi").select("site_id").distinct().withColumn(name, F.lit(True))
    out = (
        posts.select("site_id").distinct().join(has(ga4, "has_ga4"), "site_id", "left").join(has(gsc, "has_gsc"), "site_id", "left")
        .select("site_id", F.coalesce("has_ga4", F.lit(False)).alias("has_ga4"), F.coalesce("has_gsc", F.lit(False)).alias("has_gsc"))
    )
    a, b = F.col("has_ga4"), F.col("has_gsc")
    return out.withColumn("mode", F.when(a & b, "full").when(a | b, "partial").otherwise("crawl_only"))


def short_form(posts: DataFrame, keys: list[str]) -> DataFrame:
    """Sites of mostly short posts: median < 600 and deviation < 400 words."""
    wc = posts.filter("word_count > 50")
    med = exact_percentiles(wc, keys, "word_count", {"median_wc": 0.5})
    dev = wc.groupBy(*keys).agg(F.stddev("word_count").alias("stddev_wc"))
    return med.join(dev, keys).withColumn(
        "is_short_form", (F.col("median_wc") < 600) & (F.coalesce("stddev_wc", F.lit(500.0)) < 400)
    )


def traffic_windows(ga4: DataFrame, as_of: str, unit: int = 30) -> DataFrame:
    """Pageviews of the last 1, 1–2, 2 and 3 periods in one aggregate."""
    since = F.date_sub(F.lit(as_of).cast("date"), 3 * unit)
    return ga4.filter(F.col("date") >= since).groupBy("post_id").agg(*_windows(as_of, unit))


def _windows(as_of: str, unit: int) -> list[Column]:
    day = lambda n: F.date_sub(F.lit(as_of).cast("date"), n * unit)
    pv = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("pageviews"))), F.lit(0))
    d = F.col("date")
    return [
        pv(d >= day(1)).alias("recent"), pv((d >= day(2)) & (d < day(1))).alias("prev"),
        pv(d >= day(2)).alias("two"), pv(d >= day(3)).alias("three"),
    ]


def traffic_trend(recent: Column, prev: Column, two: Column) -> Column:
    """Struct (trend, score) from two periods of pageviews."""
    change = (recent - prev) / prev
    pack = lambda t, s: F.struct(F.lit(t).alias("trend"), s.cast("double").alias("score"))
    return (
        F.when((two == 0) & (prev == 0) & (recent == 0), pack("unknown", F.lit(30.0)))
        .when(two < 5, pack("dead", F.lit(0.0)))
        .when((prev == 0) & (recent > 0), pack("growing", F.lit(100.0)))
        .when(prev == 0, pack("stable", F.lit(30.0)))
        .when(change > 0.15, pack("growing", F.least(F.lit(100.0), 75 + change * 50)))
        .when(change < -0.15, pack("declining", F.greatest(F.lit(0.0), 25 + change * 50)))
        .otherwise(pack("stable", F.lit(50.0)))
    )


def ranking_score(position: Column) -> Column:
    return (
        F.when(position <= 1, 100.0).when(position >= 50, 0.0)
        .otherwise(100 * F.pow(1 - (position - 1) / 49, F.lit(1.5)))
    )


def engagement_score(bounce: Column, seconds: Column) -> Column:
    """Averages that are missing or exactly zero count as 0.5 and 60 s."""
    b = F.when(F.coalesce(bounce, F.lit(0.0)) == 0, 0.5).otherwise(bounce)
    s = F.when(F.coalesce(seconds, F.lit(0.0)) == 0, 60.0).otherwise(seconds)
    return 0.4 * F.greatest(F.lit(0.0), (1 - b) * 100) + 0.6 * F.least(F.lit(100.0), s / 300 * 100)


def time_sensitive(title: Column, url: Column) -> Column:
    return F.lower(F.concat_ws(" ", title, url)).rlike(r"20[12]\d|best |top |ranking|pricing|review")


def freshness_score(updated: Column, as_of: str, sensitive: Column) -> Column:
    """Half-life of 6 (time-sensitive) or 12 months down to a floor of 10 or 30."""
    months = F.date_diff(F.lit(as_of).cast("date"), F.to_date(updated)) / 30.44
    half = F.when(sensitive, 6.0).otherwise(12.0)
    floor = F.when(sensitive, 10.0).otherwise(30.0)
    return (
        F.when(updated.isNull(), 35.0).when(months < 0.5, 100.0)
        .otherwise(F.greatest(floor, 100 * F.pow(F.lit(0.5), months / half)))
    )


def quality_bonus(html: Column) -> Column:
    low = F.lower(F.coalesce(html, F.lit("")))
    has = lambda *xs: tx.any_of(low, list(xs))
    return F.least(
        F.lit(15.0),
        F.least(F.lit(3.0), tx.count_matches(low, "<li") * 0.3)
        + F.least(F.lit(3.0), tx.count_matches(low, r"\d+(?:\.\d+)?(?:%|\$|percent)") * 0.5)
        + F.when(has("<pre", "<code"), 2.0).otherwise(0.0)
        + F.when(has("<table"), 2.0).otherwise(0.0)
        + F.least(F.lit(3.0), tx.count_matches(low, r"href=[\"']https?://") * 0.3)
        + F.when(has("<img", "<picture", "<figure"), 2.0).otherwise(0.0),
    )


def depth_score(words: Column, cluster_avg: Column, bonus: Column, short: Column) -> Column:
    """Word count on an absolute and a cluster-relative curve plus the bonus of ``quality_bonus``."""
    w = words.cast("double")
    avg = F.when(cluster_avg <= 0, 500.0).otherwise(cluster_avg)
    brief = (
        F.when(w < 50, w / 50 * 5).when(w < 200, 20 + (w - 50) / 150 * 20).when(w < 500, 40 + (w - 200) / 300 * 30)
        .otherwise(F.least(F.lit(100.0), 70 + (w - 500) / 500 * 30))
    )
    long = F.when(w >= 100, F.least(F.lit(100.0), w / 2500 * 100)).otherwise(w / 100 * 5)
    r = w / avg
    relative = (
        F.when(r < 0.3, 5.0).when(r < 0.5, 5 + (r - 0.3) * 75).when(r < 1.0, 20 + (r - 0.5) * 60).when(r < 1.5, 50 + (r - 1.0) * 60)
        .when(r < 2.0, 80 + (r - 1.5) * 30).otherwise(F.least(F.lit(100.0), 95 + (r - 2.0) * 5))
    )
    base = F.when(short, 0.35 * brief + 0.65 * relative).otherwise(0.5 * long + 0.5 * relative)
    return F.least(F.lit(100.0), base + bonus)


def technical_score(meta, title, headings, has_out, has_in, og, jsonld, canonical, html) -> Column:
    """Eight checks of 12.5 points each."""
    return page_checks(meta, title, headings, og, jsonld, canonical, html) + link_checks(has_out, has_in)


def link_checks(has_out: Column, has_in: Column) -> Column:
    return sum((F.when(F.coalesce(c, F.lit(False)), 12.5).otherwise(0.0) for c in (has_out, has_in)), F.lit(0.0))


def page_checks(meta, title, headings, og, jsonld, canonical, html) -> Column:
    """The six technical checks that need the page alone."""
    n = F.length(tx.strip(title))
    low = F.lower(F.coalesce(html, F.lit("")))
    pt = lambda c: F.when(F.coalesce(c, F.lit(False)), 12.5).otherwise(0.0)
    return (
        pt(F.length(tx.strip(meta)) > 10)
        + F.when(n.between(30, 60), 12.5).when(n.between(20, 70), 6.25).otherwise(0.0)
        + pt(F.exists(headings, lambda h: h["level"].isin("h2", "h3", "h4")))
        + pt(og | tx.any_of(low, ["og:title", 'property="og:']))
        + pt(jsonld | F.contains(low, F.lit("application/ld+json")))
        + pt(canonical | tx.any_of(low, ['rel="canonical"', "rel='canonical'"]))
    )


def predicted_engagement(html: Column, reading_ease: Column, n_headings: Column) -> Column:
    h = F.coalesce(html, F.lit(""))
    score = (
        F.when(tx.any_of(h, ["<img", "<picture", "<figure", "data-src"]), 20.0).otherwise(0.0)
        + F.when(F.contains(h, F.lit("<li")), 15.0).otherwise(0.0)
        + F.when(reading_ease.between(60, 80), 20.0).when(reading_ease.between(40, 90), 10.0).otherwise(0.0)
        + ladder(n_headings, [(5, 15.0), (3, 10.0)], 0.0)
        + F.when((n_headings >= 6) & F.contains(F.lower(h), F.lit("table of contents")), 10.0).otherwise(0.0)
        + F.when(tx.any_of(h, ["<pre", "<code"]), 10.0).otherwise(0.0)
    )
    return F.least(F.lit(100.0), score * (100.0 / 90.0))


def structure_score(html: Column, words: Column, n_headings: Column) -> Column:
    h = F.coalesce(html, F.lit(""))
    density = n_headings / (words / 500.0)
    ext = tx.count_matches(h, 'href="http') - tx.count_matches(h, 'href="https?://localhost')
    score = (
        F.when(words > 0, ladder(density, [(1.5, 25.0), (0.8, 15.0), (0.4, 8.0)], 0.0)).otherwise(0.0)
        + ladder(tx.count_matches(h, "<li"), [(10, 20.0), (5, 12.0), (2, 5.0)], 0.0)
        + ladder(tx.count_matches(h, "<img|<picture|<figure"), [(5, 20.0), (2, 12.0), (1, 5.0)], 0.0)
        + F.when(F.contains(h, F.lit("<table")), 15.0).otherwise(0.0)
        + ladder(ext, [(5, 15.0), (2, 8.0)], 0.0)
        + F.when(F.contains(h, F.lit("<blockquote")), 5.0).otherwise(0.0)
    )
    return F.least(F.lit(100.0), score)


def composite(weights: dict[str, Column], scores: dict[str, Column]) -> Column:
    """Weighted sum of the factors, unclamped."""
    return sum((weights[f] * scores[f] for f in FACTORS), F.lit(0.0))


def assign_role(score: Column, share: Column, recent: Column, rival: Column, has_traffic: Column, page_type: Column) -> Column:
    pillar = F.when(F.coalesce(page_type, F.lit("blog")).isin(STRUCTURAL), "supporter").otherwise("pillar")
    blind = F.when(rival, "competitor").when(score >= 45, pillar).when(score >= 30, "supporter").when(score >= 15, "at_risk").otherwise("dead_weight")
    seen = (
        F.when((score < 15) | (recent == 0), "dead_weight").when(rival, "competitor")
        .when((share > 0.25) & (score >= 40), pillar).when(score >= 30, "supporter").otherwise("dead_weight")
    )
    return F.when(has_traffic, seen).otherwise(blind)


def rerank_without_traffic(df: DataFrame, keys: list[str] | None = None, score: str = "composite_score") -> DataFrame:
    """Roles by percentile where no traffic is known: the top 15 % of a cluster of
    three or more are pillars. The cut-off is found through score counts."""
    keys = keys or ["cluster_id"]
    ranked = distributed_rank(df.select(*keys, "post_id", score), keys, [F.col(score), F.col("post_id")], "_rn", "_size")
    cut = ranked.filter(F.col("_rn") == F.floor(F.col("_size") * 0.85) + 1).select(*keys, F.col(score).alias("_cut"), "_size")
    s = F.col(score)
    pillar = F.when(F.coalesce("page_type", F.lit("blog")).isin(STRUCTURAL), "supporter").otherwise("pillar")
    role = F.when(s >= F.col("_cut"), pillar).when(s >= 30, "supporter").when(s >= 15, "at_risk").otherwise("dead_weight")
    return df.join(cut, keys, "left").withColumn(
        "role", F.when((F.col("_size") >= 3) & (F.col("role") != "competitor"), role).otherwise(F.col("role"))
    ).drop("_cut", "_size")


def cluster_health(df: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Traffic-weighted mean score, the plain mean without traffic."""
    t = F.sum("traffic")
    return df.groupBy(key).agg(
        F.when(t > 0, F.sum(F.col("composite_score") * F.col("traffic")) / t).otherwise(F.avg("composite_score")).alias("cluster_health"),
        F.count("*").alias("post_count"),
    )


def ecosystem_state(posts: DataFrame, pairs: DataFrame, as_of: str, recent_days: int = 30) -> DataFrame:
    """State per cluster: posts(cluster_id, role, trend, traffic, freshness_score,
    publish_date, composite_score, has_traffic), pairs(cluster_id, n_pairs)."""
    c = F.col
    agg = posts.groupBy("cluster_id").agg(
        F.count("*").alias("n"), F.max((c("role") == "pillar").cast("int")).alias("pillar"),
        F.max((c("publish_date") >= F.date_sub(F.lit(as_of).cast("date"), recent_days)).cast("int")).alias("recent"),
        F.min(c("trend").isin("declining", "dead").cast("int")).alias("falling"),
        F.avg("traffic").alias("avg_traffic"), F.avg(F.coalesce("freshness_score", F.lit(45.0))).alias("avg_fresh"),
        F.max(c("has_traffic").cast("int")).alias("seen"),
    )
    df = agg.join(cluster_health(posts).select("cluster_id", "cluster_health"), "cluster_id").join(pairs, "cluster_id", "left")
    possible = F.when(c("n") > 1, c("n") * (c("n") - 1) / 2).otherwise(F.lit(1.0))
    rate = F.coalesce("n_pairs", F.lit(0)) / possible
    seen, pillar = c("seen") == 1, c("pillar") == 1
    state = (
        F.when((F.coalesce("recent", F.lit(0)) == 1) & (c("n") <= 3), "seedbed")
        .when(rate > 0.5, "swamp").when(seen & (c("n") > 8) & ~pillar, "swamp")
        .when(seen & ((c("falling") == 1) | (c("avg_traffic") < 5)), "desert").when(~seen & (c("avg_fresh") < 25), "desert")
        .when(pillar & (rate < 0.2) & (c("cluster_health") > F.when(seen, 50.0).otherwise(38.0)), "forest")
        .otherwise("meadow")
    )
    return df.select("cluster_id", "cluster_health", state.alias("ecosystem_state"))


def pair_members(pairs: DataFrame) -> DataFrame:
    """Posts on either side of a medium, high or critical pair."""
    p = pairs.filter(F.col("severity").isin("medium", "high", "critical"))
    return p.select(F.explode(F.array("post_a_id", "post_b_id")).alias("post_id")).distinct()


def patch_roles(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mark posts of real pairs as competitors unless they are pillars."""
    hit = pair_members(pairs).withColumn("_hit", F.lit(True))
    return scores.join(hit, "post_id", "left").withColumn(
        "role", F.when(F.coalesce("_hit", F.lit(False)) & (F.col("role") != "pillar"), "competitor").otherwise(F.col("role"))
    ).drop("_hit")


def patch_states(scores: DataFrame, pairs: DataFrame, as_of: str) -> DataFrame:
    """States of clusters with patched posts; freshness is taken at its default."""
    patched = patch_roles(scores, pairs)
    touched = patched.join(pair_members(pairs), "post_id", "left_semi").select("cluster_id").distinct()
    counts = pairs.filter(F.col("severity").isin("medium", "high", "critical")).groupBy("cluster_id").agg(F.count("*").alias("n_pairs"))
    base = patched.join(touched, "cluster_id", "left_semi").withColumn("freshness_score", F.lit(45.0))
    return ecosystem_state(base, counts, as_of)


def history_snapshot(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Average score and factor averages of a site, ready to append."""
    avg2 = lambda c, a: F.round(F.avg(c), 2).alias(a)
    ai = sum((F.coalesce(c, F.lit(0.0)) for c in ("ai_citability_score", "eeat_score", "schema_score", "extraction_score")), F.lit(0.0))
    return scores.groupBy(*keys).agg(
        F.round(F.avg("composite_score"), 2).alias("score"), avg2("traffic_score", "traffic"), avg2("ranking_score", "ranking"),
        avg2("freshness_score", "freshness"), avg2("content_depth_score", "content_depth"),
        F.round(F.avg(F.when(F.col("ai_citability_score").isNotNull(), ai)) / 4, 2).alias("ai_readiness"),
    )


def health_job(
    posts: DataFrame, clusters: DataFrame, ga4: DataFrame, gsc: DataFrame, links: DataFrame, pairs: DataFrame, ai: DataFrame, as_of: str, unit: int = 30
) -> DataFrame:
    """All factors, composite and role of every clustered post in one plan.

    posts also carry reading_ease and the head flags og, jsonld, canonical;
    clusters(post_id, cluster_id); ai(post_id, four scores).
    """
    c = F.col
    zero = lambda x: F.coalesce(x, F.lit(0))
    n_head = F.size("headings")
    richness = (predicted_engagement(c("body_html"), c("reading_ease"), n_head) + structure_score(c("body_html"), zero("word_count"), n_head)) / 2
    # markup and headings become five numbers here, once; nothing wide goes through the joins
    seen = durable(posts.select(
        "post_id", "site_id", "word_count", "publish_date", "modified_date", "page_type", richness.alias("content_richness"),
        quality_bonus(c("body_html")).alias("bonus"), time_sensitive(c("title"), c("url")).alias("sensitive"),
        page_checks(c("meta_description"), c("title"), c("headings"), c("og"), c("jsonld"), c("canonical"), c("body_html")).alias("checks"),
    ))
    base = durable(seen.filter("word_count IS NULL OR word_count >= 100").join(clusters, "post_id"))
    size = base.groupBy("cluster_id").agg(
        F.when(F.count("*") >= 3, F.avg(F.coalesce("word_count", F.lit(0)))).otherwise(F.lit(1000.0)).alias("cluster_avg")
    )
    since = F.date_sub(F.lit(as_of).cast("date"), 3 * unit)
    # daily facts are grouped once: one row a post, of any date, as the posts of ga4 and gsc also say what a site has
    lately = lambda x: F.avg(F.when(c("date") >= since, c(x)))
    rank = durable(gsc.groupBy("post_id").agg(lately("avg_position").alias("avg_position")))
    visit = durable(ga4.groupBy("post_id").agg(*_windows(as_of, unit), lately("bounce_rate").alias("bounce"), lately("avg_time").alias("seconds")))
    inbound = links.filter(F.col("target_post_id").isNotNull()).groupBy(F.col("target_post_id").alias("post_id")).agg(F.count("*").alias("inbound"))
    outbound = links.groupBy(F.col("source_post_id").alias("post_id")).agg(F.count("*").alias("outbound"))
    avail = data_availability(seen, visit, rank)
    short = short_form(seen, ["site_id"]).select("site_id", "is_short_form")
    rivals = pair_members(pairs).withColumn("rival", F.lit(True))
    df = base.join(avail, "site_id").join(short, "site_id", "left").join(size, "cluster_id")
    for part in (rank, visit, inbound, outbound, ai, rivals):
        df = df.join(part, "post_id", "left")
    df = durable(df.withColumns({x: zero(x) for x in ("recent", "prev", "two", "three", "inbound", "outbound")}))
    sums = df.groupBy("cluster_id").agg(F.max("inbound").alias("max_in"), F.sum("three").alias("all_traffic"))
    df = df.join(sums, "cluster_id")
    scored = df.withColumns(
        {
            "_trend": traffic_trend(c("recent"), c("prev"), c("two")),
            "ranking": ranking_score(F.coalesce("avg_position", F.lit(100.0))),
            "engagement": engagement_score(c("bounce"), c("seconds")),
            "freshness": freshness_score(F.coalesce("modified_date", "publish_date"), as_of, c("sensitive")),
            "content_depth": depth_score(zero("word_count"), c("cluster_avg"), c("bonus"), F.coalesce("is_short_form", F.lit(False))),
            "internal_links": F.least(F.lit(100.0), c("inbound") / F.greatest("max_in", F.lit(1)) * 100),
            "technical_seo": c("checks") + link_checks(c("outbound") > 0, c("inbound") > 0),
            "ai_readiness": F.when(
                c("ai_citability_score").isNotNull(),
                ai_readiness(c("ai_citability_score"), c("eeat_score"), c("schema_score"), c("extraction_score")),
            ).otherwise(F.lit(40.0)),
            "traffic_share": c("three") / F.when(c("all_traffic") > 0, c("all_traffic")).otherwise(F.lit(1)),
        }
    ).withColumns({"trend": c("_trend.trend"), "traffic_trend": c("_trend.score")})
    raw = composite(factor_weights(c("has_ga4"), c("has_gsc")), {f: c(f) for f in FACTORS})
    scored = scored.withColumn("_raw", raw)
    role = assign_role(c("_raw"), c("traffic_share"), c("recent"), F.coalesce("rival", F.lit(False)), c("has_ga4") | c("has_gsc"), c("page_type"))
    out = durable(scored.withColumns({"role": role, "composite_score": clamp(c("_raw"), 10.0, 95.0)}).select(
        "post_id", "site_id", "cluster_id", *FACTORS, "traffic_share", F.col("three").alias("traffic"), "trend", "role", "composite_score",
        "publish_date", "page_type", (c("has_ga4") | c("has_gsc")).alias("has_traffic"), F.col("freshness").alias("freshness_score"), "mode",
    ))
    blind = rerank_without_traffic(out.filter("NOT has_traffic"), ["site_id", "cluster_id"])
    return out.filter("has_traffic").unionByName(blind)


def score_distribution(scores: DataFrame, keys: list[str], value: str = "composite_score") -> DataFrame:
    """Count, mean, deviation, range and quartiles of two-decimal scores."""
    s = scores.withColumn("_v", F.round(value, 2))
    r1 = lambda c, a: F.round(c, 1).alias(a)
    stats = s.groupBy(*keys).agg(
        F.count("_v").alias("n"), r1(F.avg("_v"), "mean"), r1(F.stddev("_v"), "stddev"), r1(F.min("_v"), "min"), r1(F.max("_v"), "max")
    )
    q = exact_percentiles(s, keys, "_v", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return stats.join(q.select(*keys, *[r1(F.col(c), c) for c in ("p25", "median", "p75")]), keys)


def factor_correlation(scores: DataFrame, factors: list[str]) -> DataFrame:
    """Pearson correlation of every factor pair in one aggregate, zero when flat."""
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(F.nanvl(F.corr(a, b), F.lit(0.0)), F.lit(0.0)).alias("r"))
            for a, b in combinations(factors, 2)
        ]
    )
    return scores.agg(rows.alias("_r")).select(F.inline("_r"))
