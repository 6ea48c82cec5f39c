"""Dashboard, audit and map aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scale import exact_percentiles, top_per_group
from .clusters import cluster_centres, leaf_clusters
from .pairs import cannibal_posts
from .problems import severity_score
from .recommend import priority_rank
from .tracking import day, side_by_side, zero


def in_one_row(*frames: DataFrame) -> DataFrame:
    """Joins frames of exactly one row each."""
    return side_by_side(*[f.withColumn("_k", F.lit(1)) for f in frames], keys=["_k"]).drop("_k")


def site_health(posts: DataFrame, scores: DataFrame, pairs: DataFrame, ga4: DataFrame, gsc: DataFrame, as_of: str) -> DataFrame:
    """A row per site: post counts by role, efficiency, traffic windows and data completeness."""
    p = posts.groupBy("site_id").agg(F.count("*").alias("total_posts"), F.avg(F.col("modified_date").isNotNull().cast("double")).alias("modified_coverage"))
    s = scores.groupBy("site_id").agg(
        F.coalesce(F.avg("composite_score"), F.lit(0.0)).alias("health"), F.count_if(F.col("role").isin("pillar", "supporter")).alias("active_posts"),
        F.count_if(F.col("role") == "dead_weight").alias("dead_posts"),
    )
    g = ga4.groupBy("site_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("date") >= day(as_of, n), F.col("pageviews"))), F.lit(0)).alias(f"traffic_{n}d") for n in (30, 60, 90)],
        F.lit(True).alias("_ga4"),
    )
    q = gsc.select("site_id").distinct().withColumn("_gsc", F.lit(True))
    one = side_by_side(p, s, g, q, cannibal_posts(pairs).withColumnRenamed("n", "cannibalistic_posts"))
    one = zero(one, "total_posts", "health", "active_posts", "dead_posts", "cannibalistic_posts", "traffic_30d", "traffic_60d", "traffic_90d").na.fill(False, ["_ga4", "_gsc"])
    return one.withColumns(
        {
            "passive_posts": F.greatest(F.lit(0), F.col("total_posts") - F.col("active_posts") - F.col("dead_posts")),
            "efficiency": F.bround(F.when(F.col("total_posts") > 0, F.col("active_posts") / F.col("total_posts")).otherwise(0.0) * 100, 1),
            "completeness": 0.4 + F.when(F.col("_ga4"), 0.3).otherwise(0.0) + F.when(F.col("_gsc"), 0.3).otherwise(0.0),
            "modified_coverage": F.bround("modified_coverage", 3), "health": F.round("health", 6),
        }
    ).drop("_ga4", "_gsc")


def cluster_list(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Leaf clusters with their centres, largest first: members(cluster_id, x, y)."""
    return cluster_centres(leaf_clusters(clusters), members).orderBy(F.desc("post_count"), "cluster_id")


def cluster_detail(members: DataFrame, posts: DataFrame, scores: DataFrame, cluster_id: int) -> DataFrame:
    m = members.filter(F.col("cluster_id") == cluster_id).join(posts.select("post_id", "title"), "post_id")
    return m.join(scores.select("post_id", "composite_score", "role", "trend"), "post_id", "left").orderBy(
        F.desc(F.coalesce("composite_score", F.lit(0.0))), "post_id"
    )


def post_listing(posts: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Page of posts, newest first; all without a limit."""
    out = posts.orderBy(F.desc_nulls_last("publish_date"), "post_id").offset(offset)
    return out.limit(limit) if limit else out


def post_health(posts: DataFrame, scores: DataFrame, members: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row per scored post with its first cluster."""
    first = members.groupBy("post_id").agg(F.min("cluster_id").alias("cluster_id"))
    s = scores.filter(F.col("composite_score").isNotNull()).drop("cluster_id")
    return (
        posts.select("post_id", "title", "word_count", "publish_date").join(s.select("post_id", "composite_score", "role", "trend", "ai_citability_score"), "post_id")
        .join(first, "post_id", "left").join(clusters.select("cluster_id", F.col("label").alias("cluster_label")), "cluster_id", "left")
    )


def display_score(c: Column, ratio: bool = False) -> Column:
    return F.when(c.isNotNull(), F.bround(F.least(F.lit(100.0), F.greatest(F.lit(0.0), c * 100 if ratio else c)), 1))


def post_details(posts: DataFrame, scores: DataFrame, ga4: DataFrame, gsc: DataFrame, ga4_rows: int = 90, gsc_rows: int = 500) -> DataFrame:
    """Newest metric rows as arrays and display scores, for every post."""
    g = top_per_group(ga4, ["post_id"], [F.desc("date")], ga4_rows).groupBy("post_id").agg(
        F.sort_array(F.collect_list(F.struct("date", "pageviews", "sessions")), asc=False).alias("ga4")
    )
    q = top_per_group(gsc, ["post_id"], [F.desc("date"), F.asc("query")], gsc_rows).groupBy("post_id").agg(
        F.sort_array(F.collect_list(F.struct("date", "query", "clicks")), asc=False).alias("gsc")
    )
    return (
        posts.select("post_id", "title").join(scores, "post_id", "left").join(g, "post_id", "left").join(q, "post_id", "left")
        .withColumns({"freshness": display_score(F.col("freshness_score")), "links": display_score(F.col("pagerank"), True)})
    )


def overview(posts: DataFrame, ga4: DataFrame, gsc: DataFrame) -> DataFrame:
    """Totals and date range of all facts of each site."""
    total = lambda c: F.sum(c).alias(c)
    one = side_by_side(
        posts.groupBy("site_id").agg(F.count("*").alias("total_posts")),
        ga4.groupBy("site_id").agg(total("pageviews"), total("sessions"), F.min("date").alias("date_start"), F.max("date").alias("date_end")),
        gsc.groupBy("site_id").agg(total("clicks"), total("impressions"), F.avg("avg_position").alias("avg_position")),
    )
    return zero(one, "total_posts", "pageviews", "sessions", "clicks", "impressions")


def audit_counters(posts: DataFrame, scores: DataFrame, clusters: DataFrame, problems: DataFrame, recs: DataFrame, pairs: DataFrame) -> DataFrame:
    """All headline numbers of each site's audit in one row."""
    filled = F.coalesce("meta_description", F.lit("")) != ""
    of = lambda df: df.groupBy("site_id")
    one = side_by_side(
        of(posts).agg(
            F.count("*").alias("total_posts"), F.round(F.try_divide(F.count_if(filled) * 100.0, F.count("*")), 1).alias("meta_pct"), F.count_if(~filled).alias("meta_missing")
        ),
        of(scores).agg(F.coalesce(F.avg("composite_score"), F.lit(0.0)).alias("overall_health")),
        of(leaf_clusters(clusters)).agg(F.count("*").alias("cluster_count")),
        of(problems).agg(
            F.count("*").alias("problem_count"), F.count_if(F.col("problem_type").startswith("orphan")).alias("orphan_count"),
            F.count_if(F.col("problem_type") == "thin_content").alias("thin_count"),
        ),
        of(recs).agg(F.count("*").alias("rec_count")),
        of(pairs).agg(F.count("*").alias("pair_count"), F.count_if(F.col("cosine") >= 0.99).alias("exact_pairs")),
        cannibal_posts(pairs).withColumnRenamed("n", "pair_posts"),
    )
    return zero(one, "total_posts", "meta_missing", "overall_health", "cluster_count", "problem_count", "orphan_count", "thin_count", "rec_count", "pair_count", "exact_pairs", "pair_posts")


def top_lists(clusters: DataFrame, pairs: DataFrame, recs: DataFrame, k: int = 8) -> DataFrame:
    """Each site's largest leaf clusters, closest pairs and most urgent advice."""
    line = lambda df, kind, name, value: df.select("site_id", F.lit(kind).alias("kind"), name.cast("string").alias("name"), value.cast("double").alias("value"))
    site = ["site_id"]
    c = top_per_group(leaf_clusters(clusters).filter("post_count > 0"), site, [F.desc("post_count"), F.asc("cluster_id")], k)
    p = top_per_group(pairs, site, [F.desc("cosine"), F.asc("post_a_id"), F.asc("post_b_id")], k)
    r = top_per_group(recs, site, [priority_rank(F.col("priority")), F.asc("rec_id")], k)
    return (
        line(c, "cluster", F.col("label"), F.col("post_count")).unionByName(line(p, "pair", F.concat_ws("-", "post_a_id", "post_b_id"), F.col("cosine")))
        .unionByName(line(r, "recommendation", F.col("title"), F.col("rec_id")))
    )


def worst_posts(posts: DataFrame, scores: DataFrame, problems: DataFrame, limit: int = 5) -> DataFrame:
    """Each site's posts with issues first, by summed issue weight, then by low score."""
    w = problems.groupBy("post_id").agg(
        F.array_join(F.array_sort(F.collect_set("problem_type")), ", ").alias("issues"), F.sum(severity_score(F.col("problem_type"))).alias("weight")
    )
    df = posts.filter("word_count >= 200").select("site_id", "post_id", "word_count").join(scores.select("post_id", "composite_score", "role"), "post_id").join(w, "post_id", "left")
    order = [F.col("issues").isNull(), F.desc(F.coalesce("weight", F.lit(0))), F.asc("composite_score"), F.asc("post_id")]
    return top_per_group(df, ["site_id"], order, limit).withColumn("issues", F.coalesce("issues", F.lit("low health score")))


def best_pillars(scores: DataFrame, limit: int = 5) -> DataFrame:
    """Each site's pillars with the highest scores."""
    return top_per_group(scores.filter("role = 'pillar'"), ["site_id"], [F.desc("composite_score"), F.asc("post_id")], limit)


def content_profile(posts: DataFrame, as_of: str) -> DataFrame:
    """Mean length of each site's posts and how many were updated in the last 6, 12 and 24 months."""
    since = lambda m: F.add_months(F.lit(as_of).cast("date"), -m)
    d = F.col("modified_date")
    return posts.filter("word_count > 50").groupBy("site_id").agg(
        F.round(F.avg("word_count"), 0).alias("avg_words"), F.round(F.avg("reading_ease"), 1).alias("avg_reading_ease"),
        *[F.count_if(d > since(m)).alias(f"updated_{m}m") for m in (6, 12, 24)], F.count_if((d <= since(24)) | d.isNull()).alias("stale"),
    )


def key_findings(audit: DataFrame) -> DataFrame:
    """Findings and headline of each audit row (with ai_cite, ai_ready_pct, ai_schema_pct)."""
    c = F.col
    health = F.bround("overall_health").cast("int")
    rules = [
        (c("pair_count") > 0, F.format_string("%d of %d posts overlap in %d pairs", "pair_posts", "total_posts", "pair_count")),
        (c("exact_pairs") > 0, F.format_string("%d near-exact duplicate pairs", "exact_pairs")),
        (c("orphan_count") > 0, F.format_string("%d orphan posts", "orphan_count")),
        (c("thin_count") > 0, F.format_string("%d thin posts", "thin_count")),
        (c("overall_health") < 40, F.format_string("health %d/100 needs work", health)),
        (c("overall_health") >= 65, F.format_string("health %d/100 is above average", health)),
        (c("ai_cite") < 40, F.format_string("only %.1f%% of posts are citable", "ai_ready_pct")),
        (c("ai_cite").isNotNull() & (c("ai_schema_pct") < 30), F.format_string("%.0f%% of posts lack structured data", 100 - c("ai_schema_pct"))),
    ]
    found = F.filter(F.array(*[F.when(w, t) for w, t in rules]), lambda x: x.isNotNull())
    headline = (
        F.when(c("pair_count") >= 50, F.format_string("%d of %d posts overlap", "pair_posts", "total_posts"))
        .when(c("rec_count") >= 100, F.format_string("%d recommendations across %d posts", "rec_count", "total_posts"))
        .otherwise(F.format_string("%d posts across %d topics", "total_posts", "cluster_count"))
    )
    return audit.select("site_id", F.array_join(found, "; ").alias("findings"), headline.alias("headline"))


def platform_totals(sites: DataFrame, posts: DataFrame, pairs: DataFrame) -> DataFrame:
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return in_one_row(n(sites, "sites"), n(posts, "posts"), n(pairs, "pairs"))


# fixed values: stages of the prospect funnel
PROSPECT_STAGES = ["discovered", "auditing", "audited", "contacted", "responded", "converted"]


def prospect_funnel(prospects: DataFrame) -> DataFrame:
    return prospects.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in PROSPECT_STAGES], F.count("contact_email").alias("with_email")
    )


def cluster_age(members: DataFrame, posts: DataFrame, as_of: str) -> DataFrame:
    """Age state of each cluster from the last change of its posts."""
    age = F.date_diff(F.lit(as_of).cast("date"), F.coalesce("modified_date", "publish_date"))
    a = members.join(posts, "post_id").groupBy("cluster_id").agg(F.avg(age).alias("_a"), F.max(age).alias("oldest_days"), F.min(age).alias("newest_days"))
    d = F.coalesce("_a", F.lit(0.0))
    state = F.when(d < 90, "fresh").when(d < 365, "maintained").when(d < 730, "overgrown").otherwise("dead")
    return a.select("cluster_id", state.alias("state"), F.bround(d).cast("bigint").alias("avg_days"), "oldest_days", "newest_days")


def cluster_traffic(members: DataFrame, gsc: DataFrame, as_of: str, unit: int = 30) -> DataFrame:
    """Clicks of the last period against the mean of the two before."""
    d = F.col("date")
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("clicks"))), F.lit(0))
    per_post = gsc.filter(d >= day(as_of, 3 * unit)).groupBy("post_id").agg(part(d >= day(as_of, unit)).alias("r"), part(d < day(as_of, unit)).alias("p"))
    c = members.join(per_post, "post_id", "left").groupBy("cluster_id").agg(F.coalesce(F.sum("r"), F.lit(0)).alias("recent"), (F.coalesce(F.sum("p"), F.lit(0)) / 2).alias("prior"))
    ch = F.when(F.col("prior") > 0, (F.col("recent") - F.col("prior")) / F.col("prior") * 100)
    state = (
        F.when((F.col("prior") == 0) & (F.col("recent") == 0), "fog").when(F.col("prior") == 0, "sunny").when(ch > 20, "sunny").when(ch > -5, "cloudy")
        .when(ch > -25, "rain").otherwise("storm")
    )
    return c.select("cluster_id", state.alias("state"), "recent", F.bround("prior").cast("bigint").alias("prior"), F.bround(ch, 1).alias("change_pct"))


def _markers(df: DataFrame, rules: list[tuple[Column, str, Column]]) -> DataFrame:
    arr = F.array(*[F.when(F.coalesce(w, F.lit(False)), F.struct(F.lit(k).alias("marker"), n.cast("bigint").alias("count"))) for w, k, n in rules])
    return df.select("cluster_id", F.inline(F.filter(arr, lambda x: x.isNotNull())))


def behaviour_markers(members: DataFrame, gsc: DataFrame, ga4: DataFrame, scores: DataFrame, low_ctr=0.02, seen=500, bounce=0.7, seconds=180, high_ctr=0.05, popular=1000) -> DataFrame:
    """Signs of low CTR, bounce, engagement, visibility and decline per cluster."""
    def means(facts: DataFrame, columns: dict[str, str]) -> DataFrame:
        # sums per post first, so that only one row per post meets the clusters
        per = facts.groupBy("post_id").agg(*[F.sum(c).alias(c) for c in columns], *[F.count(c).alias(f"_{c}") for c in columns])
        return members.join(per, "post_id").groupBy("cluster_id").agg(*[(F.sum(c) / F.sum(f"_{c}")).alias(a) for c, a in columns.items()])

    g = means(gsc, {"ctr": "ctr", "impressions": "imp"})
    v = means(ga4, {"bounce_rate": "b", "avg_time": "s"})
    f = members.select("post_id", "cluster_id").join(scores.filter("trend = 'declining'").select("post_id"), "post_id").groupBy("cluster_id").agg(F.count("*").alias("falling"))
    df = members.select("cluster_id").distinct().join(g, "cluster_id", "left").join(v, "cluster_id", "left").join(f, "cluster_id", "left")
    c = F.col
    bound = lambda n, top: F.greatest(F.lit(1), F.least(F.floor(n), F.lit(top)))
    return _markers(
        df,
        [
            ((c("ctr") < low_ctr) & (c("imp") > seen), "birds", bound((low_ctr - c("ctr")) * 200, 5)),
            (c("b") > bounce, "foxes", bound((c("b") - bounce) * 10, 3)),
            (c("s") > seconds, "deer", bound(c("s") / 120, 3)),
            ((c("ctr") > high_ctr) & (c("imp") > popular), "bees", F.lit(2)),
            (c("falling") >= 2, "vultures", F.least(c("falling"), F.lit(3))),
        ],
    )


def structure_markers(members: DataFrame, links: DataFrame, posts: DataFrame, pairs: DataFrame, overlap: float = 0.8) -> DataFrame:
    """Broken links, thin posts and near duplicates per cluster: links carry status_code."""
    b = members.join(links.filter("status_code = 404").select(F.col("source_post_id").alias("post_id")), "post_id").groupBy("cluster_id").agg(F.count("*").alias("broken"))
    t = members.join(posts.filter("word_count < 500").select("post_id"), "post_id").groupBy("cluster_id").agg(F.count("*").alias("thin"))
    d = pairs.filter(F.col("overlap_score") > overlap).groupBy("cluster_id").agg(F.count("*").alias("dup"))
    df = members.select("cluster_id").distinct().join(b, "cluster_id", "left").join(t, "cluster_id", "left").join(d, "cluster_id", "left")
    c = F.col
    return _markers(
        df, [(c("broken") > 0, "boulders", F.least(c("broken"), F.lit(5))), (c("thin") > 0, "erosion", c("thin")), (c("dup") > 0, "mushrooms", F.least(c("dup") * 2, F.lit(6)))]
    )


def benchmark_competitor(own: DataFrame, other: DataFrame) -> DataFrame:
    """Average AI scores of two page sets, gaps and insights: both carry the four scores."""
    names = {"citability": "ai_citability_score", "eeat": "eeat_score", "schema": "schema_score", "extraction": "extraction_score"}

    def side(df: DataFrame, tag: str) -> DataFrame:
        aggs = [F.coalesce(F.round(F.avg(c), 1), F.lit(0.0)).alias(f"{n}_{tag}") for n, c in names.items()]
        cite = F.col("ai_citability_score")
        ready = F.coalesce(F.round(F.try_divide(F.count_if(cite >= 60), F.count(cite)) * 100, 1), F.lit(0.0))
        return df.filter(cite.isNotNull()).agg(*aggs, ready.alias(f"ready_{tag}"))

    one = in_one_row(side(own, "own"), side(other, "other"))
    gaps = {n: F.bround(F.col(f"{n}_other") - F.col(f"{n}_own"), 1) for n in names}
    one = one.withColumns({f"{n}_gap": g for n, g in gaps.items()})
    c = F.col
    hits = [
        F.when(c("schema_gap") > 20, "schema behind"), F.when(c("eeat_gap") > 20, "trust behind"), F.when(c("citability_gap") > 15, "citability behind"),
        F.when(c("ready_other") > c("ready_own") + 15, "fewer pages ready"),
    ]
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    ahead = (c("schema_gap") <= 0) & (c("eeat_gap") <= 0) & (c("citability_gap") <= 0) & (c("extraction_gap") <= 0)
    return one.withColumn("insights", F.when(F.size(found) > 0, F.array_join(found, "; ")).when(ahead, "ahead on all scores").otherwise("comparable"))


def topic_comparison(clusters: DataFrame, gaps: DataFrame, k: int = 10) -> DataFrame:
    """Each site's strong (≥ 60), weak (< 40) and missing topics, a few of each."""
    line = lambda df, kind, name, value: df.select("site_id", F.lit(kind).alias("kind"), name.alias("topic"), value.cast("double").alias("value"))
    top = lambda df, order: top_per_group(df, ["site_id"], order, k)
    strong = top(clusters.filter("health_score >= 60"), [F.desc("health_score"), F.asc("cluster_id")])
    weak = top(clusters.filter("health_score < 40"), [F.asc("health_score"), F.asc("cluster_id")])
    missing = top(gaps, [F.desc("impressions"), F.asc("query")])
    return (
        line(strong, "strong", F.col("label"), F.col("health_score")).unionByName(line(weak, "weak", F.col("label"), F.col("health_score")))
        .unionByName(line(missing, "gap", F.col("query"), F.col("impressions")))
    )


def cluster_facts(clusters: DataFrame, members: DataFrame, posts: DataFrame, scores: DataFrame, as_of: str) -> DataFrame:
    """Top pillar, its age in months, supporters and last update of each cluster."""
    m = members.select("post_id", "cluster_id").join(posts.select("post_id", "title", "publish_date", "modified_date"), "post_id").join(
        scores.select("post_id", "role", "composite_score"), "post_id", "left"
    )
    order = F.struct("composite_score", -F.col("post_id"))
    f = m.groupBy("cluster_id").agg(
        F.max_by(F.when(F.col("role") == "pillar", F.struct("title", "publish_date")), F.when(F.col("role") == "pillar", order)).alias("_p"),
        F.count_if(F.col("role") == "supporter").alias("supporters"), F.date_format(F.max("modified_date"), "yyyy-MM").alias("last_update"),
    )
    months = F.greatest(F.lit(1), F.floor(F.date_diff(F.lit(as_of).cast("date"), F.col("_p.publish_date")) / 30)).cast("bigint")
    return clusters.select("cluster_id", "ecosystem_state").join(f, "cluster_id", "left").select(
        "cluster_id", "ecosystem_state", F.col("_p.title").alias("pillar"), F.when(F.col("_p").isNotNull(), months).alias("age_months"), "supporters", "last_update"
    )


def redirect_status(redirects: DataFrame) -> DataFrame:
    """Counts of the redirect log; verified ones count as pushed too."""
    s = F.col("status")
    return redirects.agg(
        F.count("*").alias("total"), F.count_if(s.isin("pushed", "verified")).alias("pushed"), F.count_if(s == "verified").alias("verified"), F.count_if(s == "failed").alias("failed")
    )


def redirect_listing(redirects: DataFrame, limit: int | None = None) -> DataFrame:
    """The redirect log, newest first; with a limit the first of them."""
    listed = redirects.orderBy(F.desc("created_at"), "old_url")
    return listed if limit is None else listed.limit(limit)


def urgency(audit: DataFrame) -> DataFrame:
    """The first of seven findings that applies to each site."""
    c = F.col
    tot = F.greatest(c("total_posts"), F.lit(1))
    text = (
        F.when(c("ai_schema_pct") == 0, "no structured data on any post")
        .when((c("pair_posts") > 0) & (c("pair_posts") / tot * 100 > 40), F.format_string("%.0f%% of posts compete with each other", c("pair_posts") / tot * 100))
        .when((c("meta_pct") == 0) & (c("total_posts") > 0), F.format_string("no meta description on %d posts", "total_posts"))
        .when(c("ai_eeat") < 10, "no visible author information")
        .when(c("orphan_count") / tot > 0.30, F.format_string("%d pages without internal links", "orphan_count"))
        .when(c("orphan_count") >= 3, F.format_string("%d pages invisible to search engines", "orphan_count"))
        .when(c("pair_count") > 0, F.format_string("%d posts dilute each other", "pair_posts"))
        .otherwise("untapped potential")
    )
    return audit.select("site_id", text.alias("finding"))


def word_count_profile(posts: DataFrame, keys: list[str]) -> DataFrame:
    s = posts.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("word_count").alias("avg"), F.min("word_count").alias("min"), F.max("word_count").alias("max"))
    return s.join(exact_percentiles(posts, keys, "word_count", {"median": 0.5}), keys)


def distribution_counts(frames: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Counts per site and value of several columns: (site_id, dimension, value, n)."""
    parts = [df.groupBy("site_id", F.col(c).alias("value")).agg(F.count("*").alias("n")).select("site_id", F.lit(d).alias("dimension"), "value", "n") for d, (df, c) in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def score_histogram(scores: DataFrame) -> DataFrame:
    """Scored posts of each site by band."""
    s = F.col("composite_score")
    b = (
        F.when(s >= 80, "80-100 (excellent)").when(s >= 65, "65-79 (good)").when(s >= 40, "40-64 (moderate)").when(s >= 20, "20-39 (poor)").otherwise("0-19 (critical)")
    )
    return scores.groupBy("site_id", b.alias("bucket")).agg(F.count("*").alias("n"))


def early_findings(posts: DataFrame, members: DataFrame, pairs: DataFrame, problems: DataFrame, least: int = 50) -> DataFrame:
    """First numbers of each site's running analysis, once fifty of its posts are in."""
    of = lambda df: df.groupBy("site_id")
    one = side_by_side(
        of(posts).agg(F.count("*").alias("posts_sampled")), of(members).agg(F.count_distinct("cluster_id").alias("clusters_found")),
        of(pairs).agg(F.count("*").alias("pairs_found")), of(problems).agg(F.count_if(F.col("problem_type") == "thin_content").alias("thin_content")),
    )
    one = zero(one, "posts_sampled", "clusters_found", "pairs_found", "thin_content")
    return one.filter(F.col("posts_sampled") >= least).withColumn("preview_ready", F.col("clusters_found") > 0)
