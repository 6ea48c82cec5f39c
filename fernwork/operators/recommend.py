"""Recommendations, consolidation plans, calendar advice and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scale import distributed_rank, durable, top_per_group
from .pairs import severity_rank
from .vectors import nearest_to, top_matches

# fixed values: recommendation type, hours and priority of each problem type (the titles are our own);
# a comparison means high when it holds, else medium
TEMPLATES = {
    "thin_content": ("expand", "Write more on this page", 2.0, "words<300"),
    "thin_below_cluster_avg": ("expand", "Go as deep as the rest of the topic", 1.5, "words<=500"),
    "seo_title_length": ("optimize", "Bring the title to a usual length", 0.25, "low"),
    "seo_missing_meta": ("optimize", "Describe the page for search results", 0.25, "medium"),
    "seo_no_images": ("optimize", "Illustrate the page", 0.5, "low"),
    "readability_too_complex": ("optimize", "Use simpler sentences", 1.0, "medium"),
    "orphan": ("interlink", "Link here from other pages", 0.5, "high"),
    "decay_severe": ("update", "Losing visits fast: revise now", 2.0, "high"),
    "decay_moderate": ("update", "Losing visits: bring up to date", 1.0, "medium"),
    "decay_mild": ("refresh", "Ageing page: check for dated parts", 0.5, "low"),
    "seo_no_headings": ("optimize", "Divide the text by headings", 0.5, "medium"),
    "low_ai_citability": ("improve_ai_citability", "State facts that can be quoted", 2.0, "value<20"),
    "weak_eeat": ("strengthen_eeat", "Show who wrote this and why to trust it", 1.0, "value<20"),
    "missing_schema": ("add_schema", "Describe the page in structured data", 0.5, "high"),
    "poor_ai_structure": ("improve_ai_structure", "Order the text into short, closed parts", 1.5, "medium"),
    "geo_no_faq_section": ("add_faq_section", "Answer common questions at the end", 1.0, "medium"),
    "geo_no_question_headers": ("reformat_headers_geo", "Turn headings into the questions asked", 0.5, "medium"),
    "geo_low_data_density": ("increase_data_density", "Back statements with numbers", 1.5, "medium"),
    "geo_no_answer_first": ("add_answer_first", "Open with a summary", 0.5, "medium"),
    "geo_missing_faq_schema": ("add_faq_schema", "Mark up questions and answers", 0.5, "high"),
    "geo_no_updated_date": ("add_freshness_signal", "Show when the page last changed", 0.25, "low"),
}
# fixed values: how sure each problem type is
HIGH_CONFIDENCE = ["thin_content", "seo_missing_meta", "orphan", "missing_schema", "seo_no_images", "seo_title_length", "seo_no_headings"]
MEDIUM_CONFIDENCE = ["readability_too_complex", "thin_below_cluster_avg", "improve_ai_citability", "poor_ai_structure"]
SITE_WIDE = 0.30  # share of posts above which a problem type is summed up
PER_TYPE = 10  # single recommendations kept of such a type


def _lookup(values: dict[str, object], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def cluster_average(posts: DataFrame, clusters: DataFrame) -> DataFrame:
    """The cluster of largest mean word count for each post: (post_id, cluster_id, cluster_avg)."""
    m = clusters.join(posts.select("post_id", "word_count"), "post_id")
    avg = m.groupBy("cluster_id").agg(F.avg("word_count").alias("cluster_avg"))
    best = F.struct("cluster_avg", (-F.col("cluster_id")).alias("o"))
    return m.join(avg, "cluster_id").groupBy("post_id").agg(F.max(best).alias("_b")).select(
        "post_id", (-F.col("_b.o")).alias("cluster_id"), F.col("_b.cluster_avg").alias("cluster_avg")
    )


def expand_templates(problems: DataFrame, posts: DataFrame, clusters: DataFrame) -> DataFrame:
    """One recommendation per (post, problem type) of pages worth the effort."""
    p = posts.filter(
        (F.col("word_count").isNull() | (F.col("word_count") >= 100)) & ~F.coalesce("page_type", F.lit("blog")).isin("landing", "index")
    ).select("post_id", "site_id", F.col("title").alias("post_title"), "word_count")
    kind = F.col("problem_type")
    known = problems.filter(kind.isin(list(TEMPLATES))).dropDuplicates(["post_id", "problem_type"])
    rule = _lookup({k: v[3] for k, v in TEMPLATES.items()}, kind)
    words = F.coalesce("word_count", F.lit(0))
    priority = (
        F.when(rule == "words<300", F.when(words < 300, "high").otherwise("medium"))
        .when(rule == "words<=500", F.when(words > 500, "medium").otherwise("high"))
        .when(rule == "value<20", F.when(F.coalesce("value", F.lit(0.0)) < 20, "high").otherwise("medium"))
        .otherwise(rule)
    )
    confidence = F.when(kind.isin(HIGH_CONFIDENCE), "high").when(kind.isin(MEDIUM_CONFIDENCE), "medium").otherwise("low")
    name = F.left(F.coalesce(F.nullif("post_title", F.lit("")), F.lit("Untitled")), F.lit(80))
    joined = known.join(p, "post_id").join(cluster_average(posts, clusters), "post_id", "left")
    target = F.greatest(F.coalesce("cluster_avg", F.lit(1500.0)), F.lit(500.0)).cast("int")
    actions = F.array(
        F.concat(_lookup({k: v[1] for k, v in TEMPLATES.items()}, kind), F.lit(" first on the pages with most traffic")),
        F.when(kind.isin("thin_content", "thin_below_cluster_avg"), F.format_string("Aim for %d words", target))
        .otherwise(F.lit("Review the page after the change")),
    )
    return joined.select(
        "post_id", "site_id", "problem_type", "severity",
        _lookup({k: v[0] for k, v in TEMPLATES.items()}, kind).alias("rec_type"), priority.alias("priority"),
        _lookup({k: v[2] for k, v in TEMPLATES.items()}, kind).alias("effort"),
        F.concat(_lookup({k: v[1] for k, v in TEMPLATES.items()}, kind), F.lit(": "), name).alias("title"),
        actions.alias("actions"), confidence.alias("confidence"),
    )


def aggregate_site_wide(recs: DataFrame, posts: DataFrame) -> DataFrame:
    """Types on more than 30 % of a site's posts keep ten rows plus one bulk row."""
    recs = durable(recs)  # read four times
    total = posts.filter("word_count IS NULL OR word_count >= 100").groupBy("site_id").agg(F.count("*").alias("total"))
    n = recs.groupBy("site_id", "problem_type").agg(F.count_distinct("post_id").alias("n"))
    wide = n.join(total, "site_id").filter(F.col("n") / F.col("total") > SITE_WIDE)
    key = ["site_id", "problem_type"]
    order = [severity_rank(F.col("severity")), F.asc("post_id")]
    kept = top_per_group(recs.join(wide.select(*key), key, "left_semi"), key, order, PER_TYPE)
    rest = recs.join(wide.select(*key), key, "left_anti")
    cols = ["post_id", "site_id", "problem_type", "rec_type", "priority", "effort", "title", "confidence"]
    bulk = wide.join(top_per_group(kept, key, order, 1).drop("priority", "confidence"), key).select(
        "post_id", "site_id", "problem_type", "rec_type", F.lit("medium").alias("priority"), (F.col("effort") * 2).alias("effort"),
        F.format_string("Site-wide: %d of %d posts have '%s'", "n", "total", "problem_type").alias("title"), F.lit("high").alias("confidence"),
    )
    return rest.select(*cols).unionByName(kept.select(*cols)).unionByName(bulk)


def merge_titles(recs: DataFrame) -> DataFrame:
    """Recommendations of one post under one title: union of actions, largest effort."""
    return recs.groupBy("post_id", "title").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("actions")))).alias("actions"), F.max("effort").alias("effort"), F.count("*").alias("merged")
    )


def pair_recommendations(pairs: DataFrame, posts: DataFrame) -> DataFrame:
    """Redirect, merge or differentiate advice of each pair of comparable pages."""
    p = posts.filter("word_count IS NULL OR word_count >= 100").select("post_id", "title", "language")
    out = pairs.filter(F.col("resolution") != "monitor")
    for s in ("a", "b"):
        out = out.join(p.select(F.col("post_id").alias(f"post_{s}_id"), F.col("title").alias(f"_t{s}"), F.col("language").alias(f"_l{s}")), f"post_{s}_id")
    out = out.filter(F.coalesce(F.col("_la") == F.col("_lb"), F.lit(True)))
    keep_b = F.col("stronger_post_id") == F.col("post_b_id")
    keep, weak = F.when(keep_b, F.col("_tb")).otherwise(F.col("_ta")), F.when(keep_b, F.col("_ta")).otherwise(F.col("_tb"))
    r = F.col("resolution")
    cut = lambda c: F.left(c, F.lit(50))
    title = (
        F.when(r == "redirect", F.concat(F.lit("Redirect duplicate: "), cut(weak))).when(r == "merge", F.concat(F.lit("Merge overlapping content: "), cut(keep)))
        .otherwise(F.concat(F.lit("Differentiate competing content: "), cut(F.col("_ta"))))
    )
    return out.select(
        F.col("post_a_id").alias("post_id"), "post_b_id", F.when(r == "differentiate", "differentiate").otherwise("merge").alias("rec_type"),
        F.coalesce("severity", F.lit("medium")).alias("priority"), F.when(r == "redirect", 0.5).when(r == "merge", 2.0).otherwise(1.5).alias("effort"),
        F.when(r == "differentiate", "medium").otherwise("high").alias("confidence"), title.alias("title"),
    )


def high_similarity_merges(pairs: DataFrame, posts: DataFrame, recs: DataFrame, floor: float = 0.90, limit: int | None = None) -> DataFrame:
    """Merges for close pairs, the closest first; the shorter page goes. A page that already has merge advice,
    from before or from a closer pair, takes no part in another merge. ``limit`` pairs a site are looked at.

    Whether a pair stands depends on closer pairs of its pages only, so each
    round settles every pair that no open closer pair can still rule out.
    """
    wc = posts.select("post_id", F.coalesce("word_count", F.lit(0)).alias("w"))
    top = pairs.filter(F.col("cosine") >= floor)
    if limit:
        top = top_per_group(top, ["site_id"], [F.desc("cosine"), F.asc("post_a_id"), F.asc("post_b_id")], limit)
    busy = recs.filter("rec_type = 'merge'").select("post_id").distinct()
    free = top.join(busy.withColumnRenamed("post_id", "post_a_id"), "post_a_id", "left_anti").join(
        busy.withColumnRenamed("post_id", "post_b_id"), "post_b_id", "left_anti"
    )
    df = free.join(wc.select(F.col("post_id").alias("post_a_id"), F.col("w").alias("_wa")), "post_a_id").join(
        wc.select(F.col("post_id").alias("post_b_id"), F.col("w").alias("_wb")), "post_b_id"
    )
    a = F.col("_wa") >= F.col("_wb")
    open_ = durable(df.select(
        "site_id", "post_a_id", "post_b_id", F.when(a, F.col("post_b_id")).otherwise(F.col("post_a_id")).alias("post_id"),
        F.when(a, F.col("post_a_id")).otherwise(F.col("post_b_id")).alias("primary_id"), "cosine", F.struct(-F.col("cosine"), "post_a_id", "post_b_id").alias("_r"),
    ))
    done = open_.limit(0)
    while open_.limit(1).count():
        first = open_.groupBy("post_id").agg(F.min("_r").alias("_m"))
        side = lambda s: first.select(F.col("post_id").alias(f"post_{s}_id"), F.col("_m").alias(f"_m{s}"))
        sure = open_.join(side("a"), "post_a_id", "left").join(side("b"), "post_b_id", "left").filter(
            F.coalesce(F.col("_ma") >= F.col("_r"), F.lit(True)) & F.coalesce(F.col("_mb") >= F.col("_r"), F.lit(True))
        )
        new = durable(sure.select(*open_.columns))
        gone = new.select(F.col("post_id").alias("_x"), F.col("_r").alias("_n"))
        rest = open_
        for s in ("a", "b"):
            rest = rest.join(gone, (F.col(f"post_{s}_id") == F.col("_x")) & (F.col("_r") >= F.col("_n")), "left_anti")
        open_, done = durable(rest), done.unionByName(new)
    return done.select("site_id", "post_id", "primary_id", "cosine", F.when(F.col("cosine") >= 0.99, "redirect").otherwise("merge").alias("action"))


def dedup_merges(recs: DataFrame) -> DataFrame:
    """One pending merge per post, the first of its recommendations."""
    merge = (F.col("rec_type") == "merge") & (F.col("status") == "pending")
    first = top_per_group(recs.filter(merge), ["post_id"], [F.asc("rec_id")], 1)
    return recs.filter(~merge).unionByName(first)


def rescore_priorities(recs: DataFrame, scores: DataFrame) -> DataFrame:
    """Pending advice for the top 10 % of a site's pages by PageRank is critical, for the next 20 % high."""
    pending = recs.filter("status = 'pending'").join(scores.select("post_id", "pagerank"), "post_id", "left").withColumn(
        "pagerank", F.coalesce("pagerank", F.lit(0.0))
    )
    r = distributed_rank(pending, ["site_id"], [F.desc("pagerank"), F.asc("rec_id")], "_r", "_n")
    pct = (F.col("_r") - 1) / F.col("_n")
    return r.withColumn("priority", F.when(pct < 0.10, "critical").when(pct < 0.30, "high").otherwise(F.col("priority"))).drop("_r", "_n")


def recalibrate(recs: DataFrame, pairs: DataFrame, posts: DataFrame, problems: DataFrame) -> DataFrame:
    """Priority rules by overlap, length, intent and readability, applied in order."""
    near = pairs.filter("cosine >= 0.95").select(F.explode(F.array("post_a_id", "post_b_id")).alias("post_id")).distinct().withColumn("_near", F.lit(True))
    hard = problems.filter("problem_type = 'readability_too_complex'").select("post_id").distinct().withColumn("_hard", F.lit(True))
    df = recs.join(near, "post_id", "left").join(hard, "post_id", "left").join(
        posts.select("post_id", F.col("word_count").alias("_w"), F.col("content_intent").alias("_i")), "post_id", "left"
    )
    k, p = F.col("rec_type"), F.col("priority")
    money = F.coalesce(F.col("_i").isin("commercial", "transactional"), F.lit(False))
    top = (
        ((k == "merge") & F.coalesce("_near", F.lit(False))) | ((k == "expand") & F.coalesce(F.col("_w") < 200, F.lit(False)))
    )
    rise = k.isin("merge", "differentiate", "interlink") | ((k == "expand") & F.coalesce(F.col("_w") < 500, F.lit(False)))
    new = (
        F.when(top | (p == "critical"), "critical").when(rise | (p == "high"), "high").when((k == "optimize") & money, "high")
        .when((k == "optimize") & F.coalesce("_hard", F.lit(False)) & (p == "low"), "medium").otherwise(p)
    )
    return df.withColumn("priority", new).drop("_near", "_hard", "_w", "_i")


def growth_links(vectors: DataFrame, recs: DataFrame, k: int = 3) -> DataFrame:
    """For posts without advice, the most similar posts of the site's other clusters."""
    free = vectors.join(recs.select("post_id").distinct(), "post_id", "left_anti")
    return top_matches(free, vectors, k, ["site_id"], apart="cluster_id")


def growth_pillars(scores: DataFrame, recs: DataFrame, limit: int = 5) -> DataFrame:
    """Best pillars without pending growth advice among the top of each site."""
    top = top_per_group(scores.filter("role = 'pillar'"), ["site_id"], [F.desc("composite_score"), F.asc("post_id")], limit)
    busy = recs.filter("rec_type = 'growth' AND status = 'pending'").select("post_id").distinct()
    return top.join(busy, "post_id", "left_anti")


def query_summary(gsc: DataFrame, as_of: str, k: int = 10, days: int = 90) -> DataFrame:
    """Each post's top queries by clicks with their mean position."""
    q = gsc.filter(F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), days)).groupBy("post_id", "query").agg(
        F.sum("clicks").alias("clicks"), F.avg("avg_position").alias("position")
    )
    return top_per_group(q, ["post_id"], [F.desc("clicks"), F.asc("query")], k, rank="rank")


def priority_rank(c: Column) -> Column:
    return F.when(c == "critical", 0).when(c == "high", 1).when(c == "medium", 2).otherwise(3)


def shortlist(recs: DataFrame, limit: int, per_type: int = 3) -> DataFrame:
    """Each site's most urgent advice, at most three of a type, filled up from what is left."""
    order = [priority_rank(F.col("priority")), F.desc("created_at"), F.asc("rec_id")]
    cand = top_per_group(recs.filter("status = 'pending'"), ["site_id"], order, limit * 3)
    # at most 3 · limit rows a site from here on
    picked = top_per_group(cand, ["site_id", "rec_type"], order, limit * 3, rank="_t").withColumn("_late", (F.col("_t") > per_type).cast("int"))
    return top_per_group(picked, ["site_id"], [F.asc("_late"), *order], limit).drop("_t", "_late")


def consolidation_plans(clusters: DataFrame, members: DataFrame, posts: DataFrame, scores: DataFrame, pairs: DataFrame, ga4: DataFrame, as_of: str) -> DataFrame:
    """Per swamp: pillar, counts of merge candidates and dead weight, effort and priority."""
    swamp = clusters.filter("ecosystem_state = 'swamp'").select("cluster_id", "label")
    m = (
        members.join(swamp, "cluster_id").join(posts.select("post_id", "url", F.coalesce("word_count", F.lit(0)).alias("w")), "post_id")
        .join(scores.select("post_id", F.coalesce("composite_score", F.lit(0.0)).alias("s"), "role"), "post_id", "left")
    )
    pillar = m.groupBy("cluster_id", "label").agg(F.max_by(F.struct("post_id", "url", "s"), F.struct(F.coalesce("s", F.lit(0.0)), -F.col("post_id"))).alias("p"))
    rest = m.join(pillar.select("cluster_id", F.col("p.post_id").alias("_p")), "cluster_id").filter("post_id <> _p")
    dead = (F.coalesce("s", F.lit(0.0)) < 15) | (F.coalesce("role", F.lit("dead_weight")) == "dead_weight")
    counts = rest.groupBy("cluster_id").agg(
        F.count_if(~dead).alias("merge_candidates"), F.count_if(dead).alias("dead_weight"), F.sum(F.when(~dead, F.col("w")).otherwise(0)).alias("words")
    )
    views = ga4.filter(F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), 90)).groupBy("post_id").agg(F.sum("pageviews").alias("pv"))
    rival = (
        pairs.join(pillar.select("cluster_id", F.col("p.post_id").alias("_p")), "cluster_id")
        .select("cluster_id", F.when(F.col("post_a_id") == F.col("_p"), F.col("post_b_id")).otherwise(F.col("post_a_id")).alias("post_id")).distinct()
        .join(views, "post_id").groupBy("cluster_id").agg(F.sum("pv").alias("pv"))
    )
    df = pillar.join(counts, "cluster_id", "left").join(rival, "cluster_id", "left")
    gain = F.floor(F.coalesce("pv", F.lit(0)) * 0.35)
    effort = F.greatest(F.lit(1.0), F.coalesce("words", F.lit(0)) / 1000.0)
    return df.select(
        "cluster_id", "label", F.col("p.post_id").alias("pillar_id"), F.coalesce("merge_candidates", F.lit(0)).alias("merge_candidates"),
        F.coalesce("dead_weight", F.lit(0)).alias("dead_weight"), gain.alias("traffic_recovery"), effort.alias("effort"), (gain / effort).alias("priority_score"),
    )


def mark_quick_win(plans: DataFrame) -> DataFrame:
    """Flags the plan of highest priority."""
    best = plans.agg(F.max_by("cluster_id", F.struct("priority_score", -F.col("cluster_id"))).alias("_b")).withColumn("_k", F.lit(1))
    return plans.withColumn("_k", F.lit(1)).join(best, "_k").withColumn("is_quick_win", F.col("cluster_id") == F.col("_b")).drop("_k", "_b")


def redirect_map(plans: DataFrame, members: DataFrame, posts: DataFrame) -> DataFrame:
    """Old URL → pillar URL for every other post of a planned cluster."""
    url = posts.select("post_id", "url")
    target = plans.select("cluster_id", F.col("pillar_id").alias("post_id")).join(url, "post_id").select("cluster_id", F.col("post_id").alias("_p"), F.col("url").alias("new_url"))
    return members.join(target, "cluster_id").filter("post_id <> _p").join(url, "post_id").select("cluster_id", F.col("url").alias("old_url"), "new_url")


def calendar_advice(clusters: DataFrame, members: DataFrame, gsc: DataFrame, pairs: DataFrame, desert=(50, 5), meadow=(20, 3)) -> DataFrame:
    """Publishing advice by cluster state, with gap keywords and pause months."""
    state = F.col("ecosystem_state")
    g = gsc.join(members, "post_id").join(clusters.select("cluster_id", "ecosystem_state"), "cluster_id")
    gap = (
        ((state == "desert") & (F.col("impressions") > desert[0]) & (F.col("clicks") < desert[1]))
        | (~state.isin("desert", "forest", "swamp", "seedbed") & (F.col("impressions") > meadow[0]) & (F.col("clicks") < meadow[1]))
    )
    words = top_per_group(g.filter(gap).select("cluster_id", "query").distinct(), ["cluster_id"], [F.asc("query")], 5).groupBy("cluster_id").agg(
        F.array_sort(F.collect_list("query")).alias("keywords")
    )
    clicks = g.filter(state == "seedbed").groupBy("cluster_id").agg(F.avg("clicks").alias("avg_clicks"))
    n = pairs.groupBy("cluster_id").agg(F.count("*").alias("n_pairs"))
    df = clusters.join(words, "cluster_id", "left").join(clicks, "cluster_id", "left").join(n, "cluster_id", "left")
    count = F.coalesce("post_count", F.lit(0))
    pause = F.greatest(F.lit(1), F.ceil(F.coalesce("n_pairs", F.lit(0)) / F.greatest(count, F.lit(1)) * 6))
    advice = (
        F.when(state == "forest", "maintain").when(state == "swamp", "pause").when(state == "desert", "revive").otherwise("grow")
    )
    amount = (
        F.when(state == "swamp", F.greatest(F.lit(2), F.least(F.floor(count / 3), F.lit(5)))).when(state == "desert", F.greatest(F.lit(1), F.least(F.floor(count / 2), F.lit(3))))
        .when(state == "seedbed", F.when(F.coalesce("avg_clicks", F.lit(0.0)) > 2, 6).otherwise(8)).when(state == "forest", 1)
        .otherwise(F.greatest(F.lit(1), F.least(count, F.lit(3))))
    )
    return df.select(
        "cluster_id", "label", "ecosystem_state", advice.alias("advice"), F.when(state == "swamp", pause).alias("pause_months"), amount.cast("bigint").alias("amount"),
        F.array_join("keywords", ",").alias("keywords"),
    )


def calendar_summary(advice: DataFrame) -> DataFrame:
    """Clusters per kind of advice, most urgent kind first."""
    order = F.when(F.col("advice") == "pause", 1).when(F.col("advice") == "revive", 2).when(F.col("advice") == "grow", 3).otherwise(4)
    return advice.groupBy("advice").agg(F.count("*").alias("clusters"), F.min(order).alias("position")).orderBy("position")


def content_gaps(gsc: DataFrame, as_of: str, least: int = 50, ctr: float = 0.02, low: float = 5, high: float = 30, limit: int | None = None, days: int = 90) -> DataFrame:
    """Queries of each site seen often but hardly clicked at middling positions; with a limit, those seen most."""
    q = gsc.filter(F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), days)).groupBy("site_id", "query").agg(
        F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.avg("avg_position").alias("avg_position")
    )
    found = q.filter((F.col("impressions") >= least) & (F.try_divide("clicks", "impressions") < ctr) & F.col("avg_position").between(low, high))
    return top_per_group(found, ["site_id"], [F.desc("impressions"), F.asc("query")], limit) if limit else found


def closest_cluster(gaps: DataFrame, vectors: DataFrame) -> DataFrame:
    """Adds the site's cluster whose centre lies nearest to any of its posts, and that similarity: vectors(site_id, post_id, cluster_id, vec)."""
    from .clusters import mean_vectors

    # ids below zero keep centres apart from posts
    centres = mean_vectors(vectors, ["site_id", "cluster_id"]).select("site_id", (-1 - F.col("cluster_id").cast("bigint")).alias("post_id"), "vec")
    near = top_matches(vectors, centres, 1, ["site_id"])
    best = near.groupBy("site_id").agg(F.max_by(F.struct("neighbour_id", "similarity"), F.struct("similarity", "neighbour_id")).alias("_c"))
    site = vectors.schema["site_id"].dataType
    best = best.select(F.col("site_id").cast(site).alias("site_id"), (-1 - F.col("_c.neighbour_id")).alias("cluster_id"), F.col("_c.similarity").alias("similarity"))
    return gaps.join(best, "site_id", "left")


def gap_type(gaps: DataFrame) -> DataFrame:
    """missing when no cluster is similar enough: gaps(query, …, similarity?)."""
    return gaps.withColumn("gap_type", F.when(F.coalesce(F.col("similarity") < 0.3, F.lit(True)), "missing").otherwise("weak"))


def top_gap(gaps: DataFrame, clusters: DataFrame) -> DataFrame:
    """Each site's open gap of most impressions with its cluster's label."""
    top = top_per_group(gaps.filter("status = 'open'"), ["site_id"], [F.desc("impressions"), F.asc("query")], 1)
    return top.join(clusters.select("cluster_id", "label"), "cluster_id", "left")


def secondary_keywords(gsc: DataFrame, term: str, as_of: str, limit: int | None = 15) -> DataFrame:
    """Each site's other queries that contain a term, by impressions."""
    q = F.lower("query")
    recent = gsc.filter((F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), 90)) & F.contains(q, F.lit(term.lower())) & (q != term.lower()))
    found = recent.groupBy("site_id", "query").agg(F.sum("impressions").alias("impressions"))
    return top_per_group(found, ["site_id"], [F.desc("impressions"), F.asc("query")], limit) if limit else found


def keyword_rankings(gsc: DataFrame, posts: DataFrame, term: str, as_of: str, limit: int = 5) -> DataFrame:
    """Each site's posts that rank for queries with a term, by clicks."""
    recent = gsc.filter((F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), 90)) & F.contains(F.lower("query"), F.lit(term.lower())))
    q = recent.groupBy("site_id", "post_id", "query").agg(F.avg("avg_position").alias("avg_position"), F.sum("clicks").alias("clicks"))
    q = q.join(posts.select("post_id").distinct(), "post_id", "left_semi")
    top = top_per_group(q, ["site_id"], [F.desc("clicks"), F.asc("post_id"), F.asc("query")], limit)
    return top.join(posts.select("post_id", "title"), "post_id")


def draft_lookup(vectors: DataFrame, draft: list[float], gsc: DataFrame, term: str, k: int = 20) -> DataFrame:
    """Posts close to a draft or ranking for its keyword: both, embedding or keyword."""
    near = nearest_to(vectors.select("post_id", "vec"), draft, k)
    hits = gsc.filter(F.contains(F.lower("query"), F.lit(term.lower()))).groupBy("post_id").agg(
        F.avg("avg_position").alias("avg_position"), F.sum("clicks").alias("clicks")
    ).orderBy(F.desc("clicks"), "post_id").limit(k)
    src = F.when(F.col("similarity").isNull(), "keyword").when(F.col("clicks").isNull(), "embedding").otherwise("both")
    return near.join(hits, "post_id", "full_outer").withColumn("source", src)


def overlap_risk(vectors: DataFrame, draft: list[float]) -> DataFrame:
    """How much a topic repeats existing posts."""
    s = nearest_to(vectors.select("post_id", "vec"), draft, 10).agg(F.coalesce(F.max("similarity"), F.lit(0.0)).alias("max_similarity"))
    return s.withColumn("risk", F.when(F.col("max_similarity") >= 0.8, "high").when(F.col("max_similarity") >= 0.5, "medium").otherwise("low"))


def link_candidates(vectors: DataFrame, draft: list[float], scores: DataFrame, k: int = 8) -> DataFrame:
    """Similar posts, strong ones to link from, others to link to."""
    near = nearest_to(vectors.select("post_id", "vec"), draft, k)
    return near.join(scores.select("post_id", "composite_score", "pagerank"), "post_id", "left").withColumn(
        "direction", F.when(F.coalesce("pagerank", F.lit(0.0)) > 0.5, "from").otherwise("to")
    )


def cluster_peers(members: DataFrame, scores: DataFrame, k: int = 5) -> DataFrame:
    """Best posts and averages of each cluster, the context of any of its posts."""
    m = members.join(scores.select("post_id", "composite_score"), "post_id")
    stats = m.groupBy("cluster_id").agg(F.count("*").alias("posts"), F.avg("composite_score").alias("avg_score"))
    top = top_per_group(m, ["cluster_id"], [F.desc("composite_score"), F.asc("post_id")], k, rank="rank")
    return top.join(stats, "cluster_id")


def counterparts(pairs: DataFrame) -> DataFrame:
    """Each post's pair partners, closest first."""
    both = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("post_a_id").alias("post_id"), F.col("post_b_id").alias("other_id"), "cosine", "severity"),
                F.struct(F.col("post_b_id").alias("post_id"), F.col("post_a_id").alias("other_id"), "cosine", "severity"),
            )
        )
    )
    return both


def list_recommendations(recs: DataFrame, status: str | None = None, rec_type: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    df = recs
    if status:
        df = df.filter(F.col("status") == status)
    if rec_type:
        df = df.filter(F.col("rec_type") == rec_type)
    return df.orderBy(priority_rank(F.col("priority")), F.desc("created_at"), "rec_id").offset(offset).limit(limit)


def recommendation_counts(recs: DataFrame) -> DataFrame:
    """Counts by type and by priority in one pass."""
    return recs.cube("rec_type", "priority").agg(F.count("*").alias("n"), F.grouping_id().alias("g")).filter("g IN (1, 2)").drop("g")

