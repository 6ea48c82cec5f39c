"""Position alerts, impact tracking, snapshots, recaps and streaks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scale import latest, top_per_group
from .recommend import priority_rank
from .vectors import top_matches


def day(as_of: str, back: int = 0) -> Column:
    return F.date_sub(F.lit(as_of).cast("date"), back)


def side_by_side(*frames: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Brings aggregates of the same keys (one row per site by default) together; a key that a frame lacks gets nulls from it."""
    keys = keys or ["site_id"]
    return reduce(lambda a, b: a.join(b, keys, "full_outer"), frames)


def zero(df: DataFrame, *columns: str) -> DataFrame:
    """Counts of sites without rows are zero."""
    return df.na.fill(0, list(columns))



# ---- alerts --------------------------------------------------------------


def position_changes(gsc: DataFrame, as_of: str, threshold: float = 3.0, limit: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Mean position of the last three days against days 14 to 8 before; with a limit, each site's largest shifts."""
    keys = keys or ["site_id"]
    d, p = F.col("date"), F.col("avg_position")
    both = gsc.filter(d >= day(as_of, 14)).groupBy(*keys, "post_id", "query").agg(
        F.avg(F.when(d >= day(as_of, 3), p)).alias("new_position"), F.avg(F.when(d.between(day(as_of, 14), day(as_of, 8)), p)).alias("old_position"),
        F.sum(F.when(d >= day(as_of, 3), F.col("clicks"))).alias("clicks"),
    )
    change = F.col("new_position") - F.col("old_position")
    hits = both.withColumn("change", change).filter(F.abs("change") >= threshold)
    out = hits.withColumn("alert_type", F.when(F.col("change") > 0, "position_drop").otherwise("position_gain"))
    return top_per_group(out, keys, [F.desc(F.round(F.abs("change"), 9)), F.asc("post_id"), F.asc("query")], limit) if limit else out


def suppress_repeats(alerts: DataFrame, history: DataFrame, days: int = 7) -> DataFrame:
    """Drop alerts whose (post, keyword, type) was raised within the last week.

    alerts(post_id, keyword, alert_type, detected_at), history likewise.
    """
    key = ["post_id", "keyword", "alert_type"]
    seen = history.select(*key, F.col("detected_at").alias("_seen"))
    a = alerts.alias("a")
    cond = [F.col(f"a.{k}") == F.col(f"h.{k}") for k in key] + [
        F.col("h._seen") > F.date_sub(F.col("a.detected_at"), days), F.col("h._seen") <= F.col("a.detected_at")
    ]
    return a.join(seen.alias("h"), cond, "left_anti")


def alerts_feed(alerts: DataFrame, posts: DataFrame, status: str | None = None, since: str | None = None, limit: int | None = None) -> DataFrame:
    """Alerts with titles; with a limit, each site's newest."""
    df = alerts
    if status:
        df = df.filter(F.col("status") == status)
    if since:
        df = df.filter(F.col("detected_at") > F.lit(since).cast("date"))
    if limit:  # before the join, so that titles are looked up for the rows that stay
        df = top_per_group(df, ["site_id"], [F.desc("detected_at"), F.asc("post_id"), F.asc("keyword")], limit)
    return df.join(posts.select("post_id", "title"), "post_id", "left")


def check_new_posts(vectors: DataFrame, fresh: DataFrame, clusters: DataFrame, links: DataFrame, distance: float = 0.3, k: int = 5) -> DataFrame:
    """Near neighbours, cluster and link counts of newly published posts."""
    near = top_matches(vectors.join(fresh.select("post_id").distinct(), "post_id", "left_semi"), vectors, k, ["site_id"], floor=1 - distance)
    n = near.filter(1 - F.col("similarity") < distance).groupBy("post_id").agg(F.count("*").alias("similar"), F.max("similarity").alias("closest"))
    out = links.groupBy(F.col("source_post_id").alias("post_id")).agg(F.count("*").alias("outbound"))
    inn = links.filter("target_post_id IS NOT NULL").groupBy(F.col("target_post_id").alias("post_id")).agg(F.count("*").alias("inbound"))
    df = fresh.select("post_id").distinct()
    for part in (n, clusters, out, inn):
        df = df.join(part, "post_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return df.select("post_id", "cluster_id", z("similar"), "closest", z("outbound"), z("inbound"), (F.coalesce("similar", F.lit(0)) > 0).alias("at_risk"))


def ranking_trends(gsc: DataFrame, as_of: str, unit: int = 30, least: int = 7) -> DataFrame:
    """Position and clicks of the last period against the one before."""
    d = F.col("date")
    now, before = d >= day(as_of, unit), (d < day(as_of, unit)) & (d >= day(as_of, 2 * unit))
    return gsc.groupBy("post_id").agg(
        F.avg(F.when(now, F.col("avg_position"))).alias("pos_recent"), F.avg(F.when(before, F.col("avg_position"))).alias("pos_prior"),
        F.sum(F.when(now, F.col("clicks"))).alias("clicks_recent"), F.sum(F.when(before, F.col("clicks"))).alias("clicks_prior"),
        F.sum(F.when(d >= day(as_of, 3 * unit), F.col("impressions"))).alias("impressions"), F.avg(F.when(now, F.col("ctr"))).alias("avg_ctr"),
        F.min("avg_position").alias("best_position"), F.count("date").alias("rows"),
    ).filter(F.col("rows") >= least).drop("rows")


# ---- impact --------------------------------------------------------------


def impact_baseline(ga4: DataFrame, gsc: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Sessions and mean position of every post over the last period."""
    t = ga4.filter(F.col("date") >= day(as_of, days)).groupBy("post_id").agg(F.sum("sessions").alias("traffic"))
    p = gsc.filter(F.col("date") >= day(as_of, days)).groupBy("post_id").agg(F.avg("avg_position").alias("position"))
    return t.join(p, "post_id", "full_outer").withColumn("traffic", F.coalesce("traffic", F.lit(0)))


def impact_check(tracking: DataFrame, now: DataFrame, as_of: str) -> DataFrame:
    """Change since the baseline, milestone and status of all trackings at once.

    tracking(post_id, baseline_traffic, baseline_position, baseline_date), now from ``impact_baseline``.
    """
    n = F.date_diff(F.lit(as_of).cast("date"), "baseline_date")
    cur, base = F.coalesce("traffic", F.lit(0)), F.coalesce("baseline_traffic", F.lit(0))
    return tracking.join(now, "post_id", "left").select(
        "post_id", base.alias("baseline_traffic"), cur.alias("current_traffic"), (cur - base).alias("traffic_change"),
        F.bround(F.when(base > 0, (cur - base) / base * 100).otherwise(0.0), 1).alias("traffic_change_pct"),
        F.bround(F.col("baseline_position") - F.col("position"), 1).alias("position_change"), n.alias("days_since"),
        F.when(n >= 90, "90d").when(n >= 60, "60d").when(n >= 30, "30d").alias("milestone"), F.when(n >= 90, "complete").otherwise("tracking").alias("status"),
    )


def recommendation_impact(impacts: DataFrame, scores: DataFrame, gsc: DataFrame, problems: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """After-values and changes of recommendations completed over a week ago.

    impacts(post_id, completed_at, health_before, traffic_before, position_before).
    """
    g = gsc.filter(F.col("date") >= day(as_of, days)).groupBy("post_id").agg(F.sum("clicks").alias("clicks"), F.avg("avg_position").alias("pos"))
    pr = problems.groupBy("post_id").agg(F.count("*").alias("problems_after"))
    df = impacts.filter(F.col("completed_at") < day(as_of, 7)).join(scores.select("post_id", "composite_score"), "post_id").join(g, "post_id", "left").join(pr, "post_id", "left")
    tb, ta = F.coalesce("traffic_before", F.lit(0)), F.coalesce("clicks", F.lit(0))
    return df.select(
        "post_id", "completed_at", F.coalesce("composite_score", F.lit(0.0)).alias("health_after"), ta.alias("traffic_after"),
        F.coalesce("problems_after", F.lit(0)).alias("problems_after"),
        (F.coalesce("composite_score", F.lit(0.0)) - F.coalesce("health_before", F.lit(0.0))).alias("health_change"),
        F.when(tb > 0, (ta - tb) / tb * 100).otherwise(0.0).alias("traffic_change_pct"),
        (F.coalesce("position_before", F.lit(0.0)) - F.coalesce("pos", F.lit(0.0))).alias("position_change"),
    )


def impact_report(impacts: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Averages and success rate of each site's recently completed recommendations."""
    good = F.count_if(F.col("health_change") > 0)
    r1 = lambda c: F.bround(F.coalesce(F.avg(c), F.lit(0.0)), 1)
    return impacts.filter(F.col("completed_at") >= day(as_of, days)).groupBy("site_id").agg(
        F.count("*").alias("total_completed"), r1("health_change").alias("avg_health_improvement"), r1("traffic_change_pct").alias("avg_traffic_change_pct"),
        r1("position_change").alias("avg_position_improvement"), good.alias("improved"),
        F.bround(good / F.greatest(F.count("*"), F.lit(1)) * 100, 1).alias("success_rate"),
    )


# ---- history -------------------------------------------------------------


def newest_first(history: DataFrame, keys: list[str], limit: int = 90, date: str = "date") -> DataFrame:
    return top_per_group(history, keys, [F.desc(date)], limit, rank="rank")


def last_two(history: DataFrame, columns: list[str]) -> DataFrame:
    """Latest and previous snapshot of each site side by side (_new, _old)."""
    two = newest_first(history, ["site_id"], 2)
    pick = lambda n: F.max(F.when(F.col("rank") == n, F.struct(*columns)))
    return two.groupBy("site_id").agg(pick(1).alias("_new"), pick(2).alias("_old"))


def analysis_diff(history: DataFrame, factors: list[str]) -> DataFrame:
    """Factor changes of at least half a point between the last two snapshots."""
    two = last_two(history, factors).filter("_old IS NOT NULL")
    rows = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f"_old.{f}").alias("before"), F.col(f"_new.{f}").alias("after")) for f in factors])
    out = two.select("site_id", F.inline(rows)).withColumn("delta", F.bround(F.col("after") - F.col("before"), 1))
    return out.filter(F.abs("delta") >= 0.5).withColumn("degraded", F.col("delta") < F.when(F.col("factor") == "score", -3).otherwise(-5))


def analysis_report(
    history: DataFrame, factors: list[str], problems: DataFrame, scores: DataFrame, recs: DataFrame, posts: DataFrame, as_of: str, days: int = 30, fresh: int = 7
) -> DataFrame:
    """The last analysis of each site against the one before: score, factor changes by size, improvements, new issues, degradations.

    ``factors`` includes "score"; the other tables carry site_id.
    """
    moved = analysis_diff(history, factors)
    two = last_two(history, ["score"]).filter("_old IS NOT NULL")
    base = two.select("site_id", F.bround("_old.score", 1).alias("score_before"), F.bround("_new.score", 1).alias("score_after"), F.bround(F.col("_new.score") - F.col("_old.score"), 1).alias("score_delta"))
    change = F.struct((-F.abs("delta")).alias("o"), "factor", "before", "after", "delta")
    other = F.col("factor") != "score"
    changes = moved.groupBy("site_id").agg(
        F.array_sort(F.collect_list(F.when(other, change))).alias("_c"),
        F.array_sort(F.collect_list(F.when(F.col("degraded"), F.concat("factor", F.lit(" fell by "), F.format_string("%.1f", F.abs("delta")))))).alias("degradations"),
    ).withColumn("factor_changes", F.transform("_c", lambda x: F.concat(x["factor"], F.lit(" "), F.format_string("%.1f", x["delta"])))).drop("_c")
    count = lambda df, name: df.groupBy("site_id").agg(F.count("*").alias(name))
    solved = count(problems.filter(F.col("resolved_at") > day(as_of, days)), "_solved")
    marked = count(scores.filter("schema_score > 0"), "_marked")
    done = count(recs.filter((F.col("status") == "completed") & (F.col("completed_at") > day(as_of, days))), "_done")
    stale = count(posts.filter(F.col("modified_date") < F.add_months(F.lit(as_of).cast("date"), -12)), "_stale")
    new = problems.filter(F.col("resolved_at").isNull() & (F.col("detected_at") > day(as_of, fresh))).groupBy("site_id", "problem_type").agg(F.count("*").alias("n"))
    new = new.groupBy("site_id").agg(F.array_sort(F.collect_list(F.concat(F.col("n").cast("string"), F.lit(" new "), F.replace("problem_type", F.lit("_"), F.lit(" "))))).alias("_new"))
    df = base
    for part in (changes, solved, marked, done, stale, new):
        df = df.join(part, "site_id", "left")
    said = lambda *pairs: F.filter(F.array(*[F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(t))) for c, t in pairs]), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    return df.select(
        "site_id", "score_before", "score_after", "score_delta", F.coalesce("factor_changes", none).alias("factor_changes"),
        said(("_solved", " issues resolved"), ("_marked", " posts with structured data"), ("_done", " recommendations completed")).alias("improvements"),
        F.concat(F.coalesce("_new", none), said(("_stale", " posts not updated in a year"))).alias("new_issues"), F.coalesce("degradations", none).alias("degradations"),
    )


def trend_direction(history: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """Mean of the newer half of a site's snapshots minus that of the older half."""
    h = history.filter((F.col("date") >= day(as_of, days)) & F.col("score").isNotNull())
    n = h.groupBy("site_id").agg(F.count("*").alias("n"))
    # one row per site and day: a window sees at most ``days`` rows
    r = h.withColumn("r", F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("date")))).join(n, "site_id")
    newer = F.col("r") <= F.floor(F.col("n") / 2)
    diff = F.avg(F.when(newer, F.col("score"))) - F.avg(F.when(~newer, F.col("score")))
    return r.groupBy("site_id").agg(F.when(F.max("n") >= 2, diff).otherwise(0.0).alias("trend"))


def outlook(sites: DataFrame, as_of: str) -> DataFrame:
    """Seven daily outlook states: sites(site_id, trend, decay_ratio, problem_ratio)."""
    days = sites.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(6)))).withColumn("date", F.date_add(F.lit(as_of).cast("date"), F.col("offset")))
    weekend = F.dayofweek("date").isin(1, 7)
    raw = 0.5 + F.col("trend") / 20.0 - F.col("decay_ratio") * 0.3 - F.col("problem_ratio") * 0.2
    base = F.when(weekend, F.greatest(raw, F.lit(0.35))).otherwise(raw)
    s = base * (1 - F.col("offset") * 0.05) + 0.5 * (F.col("offset") * 0.05)
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))
    state = F.when(s >= 0.7, "sunny").when(s >= 0.45, "cloudy").when(s >= 0.25, "rainy").otherwise("stormy")
    return days.select("site_id", "date", F.round(s, 6).alias("level"), state.alias("state"))


def weekly_metrics(posts: DataFrame, scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """Health, efficiency and post counts of each site at the moment."""
    from .pairs import cannibal_posts

    total = posts.groupBy("site_id").agg(F.count("*").alias("total_posts"))
    s = scores.groupBy("site_id").agg(
        F.bround(F.coalesce(F.avg("composite_score"), F.lit(0.0)), 1).alias("health_score"),
        F.count_if(F.col("role").isin("pillar", "supporter")).alias("active_posts"), F.count_if(F.col("role") == "dead_weight").alias("dead_posts"),
    )
    one = side_by_side(total, s, cannibal_posts(pairs).withColumnRenamed("n", "cannibalistic_posts"))
    one = zero(one, "total_posts", "health_score", "active_posts", "dead_posts", "cannibalistic_posts")
    return one.withColumn(
        "efficiency_ratio", F.bround(F.when(F.col("total_posts") > 0, F.col("active_posts") / F.col("total_posts") * 100).otherwise(0.0), 1)
    )


def weekly_delta(snapshots: DataFrame, columns: list[str]) -> DataFrame:
    """Change of each column since the snapshot before."""
    two = last_two(snapshots, columns)
    return two.select("site_id", *[F.col(f"_new.{c}").alias(c) for c in columns], *[(F.col(f"_new.{c}") - F.col(f"_old.{c}")).alias(f"{c}_delta") for c in columns])


def weekly_report(clusters: DataFrame, pairs: DataFrame, recs: DataFrame, tracking: DataFrame, as_of: str, top: int = 5) -> DataFrame:
    """Report lines of each site: strongest clusters, new pairs, largest swamp, most urgent advice, work done and traffic gained.

    tracking(site_id, baseline_traffic, latest_traffic).
    """
    line = lambda df, kind, name, value: df.select("site_id", F.lit(kind).alias("kind"), name.alias("name"), value.cast("double").alias("value"))
    site = ["site_id"]
    best = top_per_group(clusters, site, [F.desc_nulls_last("health_score"), F.asc("cluster_id")], top)
    swamp = top_per_group(clusters.filter("ecosystem_state = 'swamp'"), site, [F.desc("post_count"), F.asc("cluster_id")], 1)
    new = pairs.groupBy("site_id").agg(F.count_if(F.col("created_at") > day(as_of, 7)).alias("n"))
    rec = top_per_group(recs.filter("status = 'pending'"), site, [priority_rank(F.col("priority")), F.desc("created_at"), F.asc("rec_id")], 1)
    done = recs.groupBy("site_id").agg(F.count_if((F.col("status") == "completed") & (F.col("completed_at") > day(as_of, 7))).alias("n"))
    gained = tracking.groupBy("site_id").agg(recovered_traffic().alias("n"))
    return reduce(DataFrame.unionByName, [
        line(best, "cluster", F.col("label"), F.col("health_score")), line(new, "new_pairs", F.lit(""), F.col("n")), line(swamp, "quick_win", F.col("label"), F.col("post_count")),
        line(rec, "top_recommendation", F.col("title"), F.col("rec_id")), line(done, "completed", F.lit(""), F.col("n")), line(gained, "recovered_traffic", F.lit(""), F.col("n")),
    ])


def recovered_traffic() -> Column:
    """Traffic above the baseline, summed over tracked posts; losses don't count against it."""
    return F.coalesce(F.sum(F.greatest(F.lit(0), F.coalesce("latest_traffic", F.lit(0)) - F.coalesce("baseline_traffic", F.lit(0)))), F.lit(0))


def monthly_delta(history: DataFrame, recs: DataFrame, problems: DataFrame, as_of: str) -> DataFrame:
    """Rounded score, its change, completed, new and pending work."""
    two = last_two(history, ["score"]).select(
        "site_id", F.bround("_new.score").alias("score"), (F.bround("_new.score") - F.bround("_old.score")).alias("score_delta")
    )
    r = recs.groupBy("site_id").agg(
        F.count_if((F.col("status") == "completed") & (F.col("completed_at") > day(as_of, 30))).alias("completed"), F.count_if(F.col("status") == "pending").alias("pending")
    )
    p = problems.groupBy("site_id").agg(F.count_if(F.col("resolved_at").isNull() & (F.col("detected_at") > day(as_of, 30))).alias("new_issues"))
    return zero(two.join(r, "site_id", "left").join(p, "site_id", "left"), "completed", "pending", "new_issues")


def since_visit(problems: DataFrame, alerts: DataFrame, recs: DataFrame, visits: DataFrame) -> DataFrame:
    """What happened at each site after its last visit: visits(site_id, visited_at)."""
    since = lambda df: df.join(visits, "site_id")
    v = F.col("visited_at")
    counts = side_by_side(
        visits.select("site_id").distinct(),
        since(problems).groupBy("site_id").agg(F.count_if((F.col("detected_at") > v) & F.col("resolved_at").isNull()).alias("new_problems")),
        since(alerts).groupBy("site_id").agg(F.count_if(F.col("detected_at") > v).alias("new_alerts")),
        since(recs).groupBy("site_id").agg(F.count_if((F.col("status") == "completed") & (F.col("completed_at") > v)).alias("completed")),
    )
    return zero(counts, "new_problems", "new_alerts", "completed")


def roi_summary(tracking: DataFrame, recs: DataFrame, history: DataFrame, as_of: str) -> DataFrame:
    """Recovered traffic, active days and first against last health of each site."""
    t = tracking.groupBy("site_id").agg(recovered_traffic().alias("recovered"))
    r = recs.filter("status = 'completed'").groupBy("site_id").agg(
        F.count("*").alias("completed"), F.date_diff(F.lit(as_of).cast("date"), F.min("completed_at")).alias("days_active")
    )
    h = history.groupBy("site_id").agg(F.min_by("score", "date").alias("initial_health"), F.max_by("score", "date").alias("current_health"))
    return zero(side_by_side(t, r, h), "recovered", "completed").withColumn("health_change", F.bround(F.col("current_health") - F.col("initial_health"), 1))


# fixed values: points per completed recommendation type, others count one
IMPACT_WEIGHTS = {"merge": 3.0, "expand": 2.0, "optimize": 1.5, "refresh": 1.5, "interlink": 1.0, "growth": 1.0, "delete": 0.5}


def impact_estimate(recs: DataFrame, posts: DataFrame, since: str | None = None) -> DataFrame:
    """Estimated health points of each site's completed work, fifteen at most."""
    done = recs.filter("status = 'completed'")
    if since:
        done = done.filter(F.col("completed_at") > F.lit(since).cast("date"))
    w = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in IMPACT_WEIGHTS.items() for x in kv]), F.col("rec_type")), F.lit(1.0))
    one = side_by_side(posts.groupBy("site_id").agg(F.count("*").alias("_n")), done.groupBy("site_id").agg(F.count("*").alias("completed"), F.sum(w).alias("_raw")))
    one = zero(one, "completed", "_raw", "_n")
    return one.select("site_id", "completed", F.bround(F.least(F.lit(15.0), F.col("_raw") / F.greatest(F.col("_n") / 50, F.lit(1.0))), 1).alias("estimated_points"))


def steward_profile(sites: DataFrame, clusters: DataFrame, members: DataFrame, posts: DataFrame, redirects: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Per user: swamps cleared, deserts revived, seedlings, redirects and gains.

    sites(site_id, user_id), clusters(site_id, cluster_id, ecosystem_state,
    post_count), redirects(site_id, old_url, status), snapshots(site_id, date, score).
    """
    own = clusters.join(sites, "site_id")
    good = F.col("ecosystem_state").isin("forest", "meadow")
    moved = members.join(posts.select("post_id", F.col("url").alias("old_url")), "post_id").join(redirects.select("site_id", "old_url"), "old_url").select(
        "site_id", "cluster_id"
    ).distinct()
    cleared = own.filter(good).join(moved, ["site_id", "cluster_id"], "left_semi").groupBy("user_id").agg(F.count("*").alias("swamps_cleared"))
    c = own.groupBy("user_id").agg(
        F.count_if(good & (F.col("post_count") <= 3)).alias("deserts_revived"),
        F.sum(F.when(F.col("ecosystem_state") == "seedbed", F.col("post_count")).otherwise(0)).alias("seedlings_planted"),
    )
    r = redirects.join(sites, "site_id").groupBy("user_id").agg(F.count("*").alias("redirects"), F.count_if(F.col("status") == "verified").alias("consolidated"))
    gain = snapshots.groupBy("site_id").agg((F.max_by("score", "date") - F.min_by("score", "date")).alias("g")).join(sites, "site_id").groupBy("user_id").agg(
        F.bround(F.sum("g"), 1).alias("health_improvement")
    )
    df = sites.select("user_id").distinct()
    for part in (cleared, c, r, gain):
        df = df.join(part, "user_id", "left")
    return df.na.fill(0)


def period_bounds(period: str) -> tuple[str, str]:
    """First and last day of YYYY or YYYY-MM."""
    import calendar

    if len(period) == 4:
        return f"{period}-01-01", f"{period}-12-31"
    y, m = int(period[:4]), int(period[5:7])
    return f"{period}-01", f"{period}-{calendar.monthrange(y, m)[1]:02d}"


def period_recap(posts: DataFrame, history: DataFrame, scores: DataFrame, clusters: DataFrame, pairs: DataFrame, period: str) -> DataFrame:
    """What a month or year brought to each site."""
    a, b = (F.lit(x).cast("date") for x in period_bounds(period))
    p = posts.groupBy("site_id").agg(
        F.count("*").alias("total_posts"), F.count_if(F.col("publish_date").between(a, b)).alias("posts_created"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("total_words")
    )
    d = F.col("date")
    h = history.groupBy("site_id").agg(
        F.min_by(F.when(d >= a, F.col("score")), F.when(d >= a, d)).alias("health_start"), F.max_by(F.when(d <= b, F.col("score")), F.when(d <= b, d)).alias("health_end")
    )
    best = F.struct("composite_score", -F.col("post_id"))
    s = scores.groupBy("site_id").agg(F.max_by("post_id", best).alias("best_post"), F.min_by("post_id", F.struct("composite_score", "post_id")).alias("worst_post"))
    states = ["swamp", "desert", "forest", "seedbed", "meadow"]
    c = clusters.groupBy("site_id").agg(
        F.count("*").alias("cluster_count"), F.max_by("label", F.struct("health_score", -F.col("cluster_id"))).alias("top_cluster"),
        *[F.count_if(F.col("ecosystem_state") == x).alias(f"{x}s") for x in states],
    )
    every = side_by_side(p, h, s, c, pairs.groupBy("site_id").agg(F.count("*").alias("pairs")))
    every = zero(every, "total_posts", "posts_created", "total_words", "cluster_count", "pairs", *[f"{x}s" for x in states])
    return every.withColumn("improvement", F.bround(F.col("health_end") - F.col("health_start"), 1))


def streaks(check_ins: DataFrame, as_of: str) -> DataFrame:
    """Current and longest run of days per user up to ``as_of``, totals and milestone."""
    d = check_ins.filter(F.col("date") <= F.lit(as_of).cast("date")).select("user_id", "date").distinct()
    # at most one row per user and day
    w = Window.partitionBy("user_id").orderBy("date")
    runs = d.withColumn("_g", F.date_sub("date", F.row_number().over(w))).groupBy("user_id", "_g").agg(F.count("*").alias("n"), F.max("date").alias("end"))
    out = runs.groupBy("user_id").agg(
        F.max_by("n", "end").alias("current_streak"), F.max("n").alias("longest_streak"), F.max("end").alias("last_check_in"), F.sum("n").alias("total_check_ins")
    )
    c = F.col("current_streak")
    return out.withColumn("milestone", F.when(c >= 100, "gold").when(c >= 30, "silver").when(c >= 7, "bronze"))


def daily_snapshots(scores: DataFrame, problems: DataFrame, gsc: DataFrame, pairs: DataFrame, clusters: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """Post, site and cluster snapshot rows of the day, ready to append."""
    today = F.lit(as_of).cast("date").alias("snapshot_date")
    pr = problems.groupBy("post_id").agg(F.count("*").alias("problems_count"))
    g = gsc.filter(F.col("date") >= day(as_of, 30)).groupBy("post_id").agg(F.sum("clicks").alias("traffic_30d"), F.avg("avg_position").alias("avg_position"))
    post = scores.join(pr, "post_id", "left").join(g, "post_id", "left").select(
        "post_id", today, "composite_score", "trend", "role", F.coalesce("traffic_30d", F.lit(0)).alias("traffic_30d"), "avg_position",
        F.coalesce("problems_count", F.lit(0)).alias("problems_count"),
    )
    site = side_by_side(
        scores.groupBy("site_id").agg(
            F.avg("composite_score").alias("avg_health_score"), F.count("*").alias("total_posts"), F.count_if(F.col("role") == "pillar").alias("pillar_count"),
            F.count_if(F.col("role") == "dead_weight").alias("dead_weight_count"),
        ),
        problems.groupBy("site_id").agg(F.count("*").alias("total_problems")), pairs.groupBy("site_id").agg(F.count("*").alias("cannibalization_pairs")),
    )
    site = zero(site, "total_posts", "pillar_count", "dead_weight_count", "total_problems", "cannibalization_pairs").select("*", today)
    cluster = clusters.select("cluster_id", today, "post_count", F.col("health_score").alias("avg_health_score"), "ecosystem_state")
    return {"post": post, "site": site, "cluster": cluster}


def token_costs(log: DataFrame, rates: DataFrame) -> DataFrame:
    """Cost per service: exact model name first, then the longest matching prefix.

    log(service, model, input_tokens, output_tokens), rates(prefix, input_rate,
    output_rate). The log is summed per model before rates are looked up; each
    model name is then cut at every length, so prefixes meet by equality.
    """
    per = log.groupBy("service", "model").agg(F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"))
    models = per.select("model").distinct().withColumn("_n", F.explode(F.sequence(F.lit(0), F.length("model"))))
    hit = models.withColumn("prefix", F.substring("model", F.lit(1), F.col("_n"))).join(rates, "prefix")
    best = latest(hit, ["model"], [F.desc(F.length("prefix"))]).select("model", "input_rate", "output_rate")
    cost = (F.col("i") * F.col("input_rate") + F.col("o") * F.col("output_rate")) / 1_000_000
    return per.join(best, "model", "left").groupBy("service").agg(F.sum(cost).alias("cost"), F.sum(F.col("i") + F.col("o")).alias("tokens"))
