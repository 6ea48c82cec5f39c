"""Content problem detectors and their merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans.scale import durable, top_per_group
from .graph import MIN_RESOLUTION, resolution
from .pairs import exact_duplicates, severity_rank

STRUCTURAL = ["landing", "index"]
# fixed values: weight of each problem type, times 100; others count 50
WEIGHTS = {
    "seo_missing_meta": 90, "seo_no_internal_links": 80, "thin_content": 70, "readability_too_complex": 60, "orphan": 60,
    "seo_no_headings": 50, "thin_below_cluster_avg": 50, "seo_title_length": 40, "seo_no_images": 30, "decay_severe": 95,
    "decay_moderate": 90, "decay_mild": 70, "velocity_decline": 70, "intent_mismatch": 80, "serp_opportunity_missed": 60,
    "missing_schema": 90, "low_ai_citability": 85, "weak_eeat": 80, "poor_ai_structure": 70, "geo_no_faq_section": 60,
    "geo_no_data_tables": 50, "geo_no_experience_markers": 50, "geo_no_question_headers": 50, "geo_low_data_density": 50,
    "geo_no_answer_first": 60, "geo_missing_faq_schema": 70, "geo_no_updated_date": 50,
}
# fixed values: reading ease below which a post is too complex, by industry
READING_FLOOR = {"saas": 35.0, "agency": 35.0, "ecommerce": 50.0, "media": 55.0, "default": 50.0}
# fixed values: words in a URL or title that change the thin-content threshold
THIN_RULES = [
    (500, ["/compare", "/vs-", " vs ", "comparison"]),
    (800, ["how-to", "guide", "tutorial", "step-by-step", "ultimate", "complete", "definitive", "checklist"]),
    (200, ["/glossary", "what-is", "definition"]),
]
IMAGE_SIGNS = [
    "<img", "<picture", "<figure", "<svg", "data-src=", "srcset=", "background-image:", 'loading="lazy"', "loading='lazy'",
]


def _row(df: DataFrame, kind, severity, value) -> DataFrame:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        "post_id", as_col(kind).alias("problem_type"), as_col(severity).alias("severity"), as_col(value).cast("double").alias("value")
    )


def _day(as_of: str, days: int) -> Column:
    return F.date_sub(F.lit(as_of).cast("date"), days)


def click_decline(gsc: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Clicks of the last period below 70 % of the one before (over ten clicks)."""
    d = F.col("date")
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("clicks"))), F.lit(0))
    both = gsc.filter(d >= _day(as_of, 2 * days)).groupBy("post_id").agg(
        part(d >= _day(as_of, days)).alias("recent"), part(d < _day(as_of, days)).alias("prev")
    )
    drop = (F.col("prev") - F.col("recent")) / F.greatest("prev", F.lit(1)) * 100
    sev = F.when(drop > 60, "severe").otherwise("moderate")
    hit = both.filter((F.col("prev") > 10) & (F.col("recent") < F.col("prev") * 0.7))
    return _row(hit, F.concat(F.lit("decay_"), sev), sev, drop)


def stale_ranking(posts: DataFrame, gsc: DataFrame, as_of: str, days: int = 90, stale: int = 365) -> DataFrame:
    """Posts untouched for a year that rank below position ten."""
    pos = gsc.filter(F.col("date") >= _day(as_of, days)).groupBy("post_id").agg(F.avg("avg_position").alias("pos")).filter("pos > 10")
    old = posts.filter(F.coalesce("modified_date", "publish_date") < _day(as_of, stale)).select("post_id")
    return _row(old.join(pos, "post_id"), "decay_mild", "medium", F.col("pos"))


def position_drop(gsc: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Once at position five or better, now worse than ten."""
    d, p = F.col("date"), F.col("avg_position")
    cut = _day(as_of, days)
    both = gsc.groupBy("post_id").agg(F.min(F.when(d < cut, p)).alias("best"), F.avg(F.when(d >= cut, p)).alias("now"))
    sev = F.when((F.col("best") <= 3) & (F.col("now") > 20), "severe").otherwise("moderate")
    return _row(both.filter("best <= 5 AND now > 10"), F.concat(F.lit("decay_"), sev), sev, F.col("now"))


def proxy_decay(posts: DataFrame, decayed: DataFrame, as_of: str, days: int = 548) -> DataFrame:
    """Decay from dates and titles alone, for posts without a measured decay."""
    upd = F.coalesce("modified_date", "publish_date")
    old = posts.filter(upd < _day(as_of, days)).join(decayed.select("post_id").distinct(), "post_id", "left_anti")
    this = F.year(F.lit(as_of).cast("date"))
    year = tx.first_match(F.col("title"), r"((?:19|20)\d{2})").cast("int")
    outdated = F.coalesce(year.between(1990, this) & (year < this - 1), F.lit(False))
    timely = F.lower("title").rlike(r"\bbest\b|\btop\s+\d|\breview\b|\bpricing\b|\bcompare\b|\bvs\b")
    kind = F.when(outdated, "decay_severe").when(timely, "decay_moderate").otherwise("decay_mild")
    months = F.date_diff(F.lit(as_of).cast("date"), upd) / 30.44
    return _row(old, kind, F.when(outdated, "high").otherwise("medium"), F.when(outdated, year).otherwise(F.bround(months, 1)))


def inbound_counts(links: DataFrame) -> DataFrame:
    return links.filter(F.col("target_post_id").isNotNull()).groupBy(F.col("target_post_id").alias("post_id")).agg(F.count("*").alias("inbound"))


def page_flags(posts: DataFrame) -> DataFrame:
    """Adds shaped and issues, what ``thin_content`` and ``seo_issues`` read from texts and markup."""
    parts = F.size(F.filter("headings", lambda h: h["level"].isin("h2", "h3")))
    shaped = (parts >= 2) & F.contains(F.coalesce("body_html", F.lit("")), F.lit("<img"))
    return posts.withColumns({"shaped": shaped, "issues": _seo_rules()})


def scan(posts: DataFrame) -> DataFrame:
    """Posts with the flags in place of texts, markup and headings, written once: each detector would read the texts again."""
    return durable(page_flags(posts).drop("body_text", "body_html", "headings", "meta_description"))


def thin_content(posts: DataFrame, links: DataFrame) -> DataFrame:
    """Word count below the threshold of the page's kind, unless well structured and linked."""
    both = F.concat(F.lower("url"), F.lit("\n"), F.lower("title"))
    limit = None
    for n, needles in THIN_RULES:
        limit = (F if limit is None else limit).when(tx.any_of(both, needles), n)
    limit = limit.otherwise(500)
    p = posts.filter((F.col("word_count") > 0) & ~F.coalesce("page_type", F.lit("blog")).isin(STRUCTURAL)).withColumn("limit", limit)
    p = p if "shaped" in p.columns else page_flags(p)
    # markup is a flag before the join
    p = p.filter(F.col("word_count") < F.col("limit")).select("post_id", "word_count", "limit", F.col("shaped").alias("_shaped")).join(inbound_counts(links), "post_id", "left")
    rescued = F.coalesce("_shaped", F.lit(False)) & (F.coalesce("inbound", F.lit(0)) >= 5)
    return _row(p.filter(~rescued), "thin_content", F.when(F.col("word_count") < F.col("limit") * 0.5, "high").otherwise("medium"), F.col("word_count"))


def thin_in_cluster(posts: DataFrame, clusters: DataFrame) -> DataFrame:
    """Under half the cluster's mean and under 800 words where the mean tops 1500."""
    p = posts.filter(F.col("word_count").isNotNull()).select("post_id", "word_count").join(clusters, "post_id")
    avg = p.groupBy("cluster_id").agg(F.avg("word_count").alias("avg_wc")).filter("avg_wc > 1500")
    hit = p.join(avg, "cluster_id").filter("word_count < avg_wc * 0.5 AND word_count < 800")
    return _row(hit, "thin_below_cluster_avg", "medium", F.col("word_count") / F.col("avg_wc"))


def high_bounce(ga4: DataFrame, as_of: str, days: int = 90, bounce: float = 0.8, seconds: float = 30) -> DataFrame:
    v = ga4.filter(F.col("date") >= _day(as_of, days)).groupBy("post_id").agg(F.avg("bounce_rate").alias("b"), F.avg("avg_time").alias("s"))
    return _row(v.filter((F.col("b") > bounce) & (F.col("s") < seconds)), "thin_high_bounce", "high", F.col("b"))


def unreliable_sites(posts: DataFrame, links: DataFrame, least: float = MIN_RESOLUTION) -> DataFrame:
    """Sites (site_id) whose share of links with a known target is below ``least``: their link checks would report the crawl, not the site."""
    placed = links.join(posts.select(F.col("post_id").alias("source_post_id"), "site_id"), "source_post_id")
    return resolution(placed, ["site_id"]).filter(F.col("resolution_rate") < least).select("site_id")


def _seo_rules() -> Column:
    """The issues that the page alone shows."""
    n = F.length(tx.strip(F.coalesce("title", F.lit(""))))
    low = F.lower(F.coalesce("body_html", F.lit("")))
    xml = low.startswith("<doc") | F.contains(F.left(low, F.lit(100)), F.lit("<doc "))

    def issue(cond: Column, kind: str, severity) -> Column:
        sev = severity if isinstance(severity, Column) else F.lit(severity)
        return F.when(cond, F.struct(F.lit(kind).alias("problem_type"), sev.alias("severity")))

    found = F.array(
        issue(F.length(tx.strip(F.coalesce("meta_description", F.lit("")))) < 10, "seo_missing_meta", "medium"),
        issue((n < 20) | (n > 70), "seo_title_length", F.when(n < 20, "medium").otherwise("low")),
        issue(~F.coalesce(F.exists("headings", lambda h: h["level"].isin("h2", "h3", "h4")), F.lit(False)), "seo_no_headings", "medium"),
        issue(~xml & ~tx.any_of(low, IMAGE_SIGNS) & (F.length("body_html") > 200), "seo_no_images", "low"),
    )
    return F.filter(found, lambda r: r.isNotNull())


def seo_issues(posts: DataFrame, links: DataFrame, gated: DataFrame | None = None) -> DataFrame:
    """Meta description, title length, headings, links and images; no link check on the sites of ``gated`` (site_id).

    Texts and markup become flags at the scan; the joins carry none of them.
    """
    p = posts.filter(~F.coalesce("page_type", F.lit("blog")).isin(STRUCTURAL))
    p = p if "issues" in p.columns else page_flags(p)
    found = p.select("post_id", F.inline("issues"))
    touched = links.select(F.explode(F.array("source_post_id", "target_post_id")).alias("post_id")).filter("post_id IS NOT NULL").distinct()
    checked = p.select("post_id", "site_id").join(gated, "site_id", "left_anti") if gated is not None else p.select("post_id")
    lone = checked.join(touched, "post_id", "left_anti").select("post_id", F.lit("seo_no_internal_links").alias("problem_type"), F.lit("high").alias("severity"))
    return found.unionByName(lone).withColumn("value", F.lit(None).cast("double"))


def orphans(posts: DataFrame, links: DataFrame, gated: DataFrame | None = None) -> DataFrame:
    """Posts that no link leads to, but for those on the sites of ``gated`` (site_id)."""
    p = posts.filter(
        (F.col("word_count").isNull() | (F.col("word_count") >= 200)) & ~F.coalesce("page_type", F.lit("blog")).isin(STRUCTURAL)
    )
    p = p.select("post_id", "site_id").join(gated, "site_id", "left_anti") if gated is not None else p.select("post_id")
    targets = links.filter(F.col("target_post_id").isNotNull()).select(F.col("target_post_id").alias("post_id")).distinct()
    return _row(p.join(targets, "post_id", "left_anti"), "orphan", "high", None)


def hard_to_read(scored: DataFrame, industries: DataFrame) -> DataFrame:
    """Reading ease below the floor of the site's industry: scored(post_id, site_id, reading_ease)."""
    floor = F.lit(50.0)
    for name, limit in READING_FLOOR.items():
        floor = F.when(F.col("industry") == name, limit).otherwise(floor)
    hit = scored.join(industries, "site_id", "left").filter(F.col("reading_ease") < floor)
    return _row(hit, "readability_too_complex", F.when(F.col("reading_ease") < 30, "high").otherwise("medium"), tx.round_even(F.col("reading_ease"), 1))


def publishing_velocity(posts: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Posts per week now, before and overall, trend and peak year of each site."""
    d = F.col("publish_date")
    dated = posts.filter(d.isNotNull())
    base = dated.groupBy("site_id").agg(
        F.count("*").alias("dated_posts"), F.count_if(d >= _day(as_of, days)).alias("recent"),
        F.count_if((d >= _day(as_of, 2 * days)) & (d < _day(as_of, days))).alias("previous"), F.date_diff(F.max(d), F.min(d)).alias("range_days"),
    )
    years = dated.groupBy("site_id", F.year(d).alias("y")).agg(F.count("*").alias("n"), F.min(d).alias("first"))
    peak = years.groupBy("site_id").agg(F.max(F.struct("n", (-F.unix_date("first")).alias("o"), "y")).alias("_p"))
    r, p = F.col("recent"), F.col("previous")
    trend = F.when((p > 0) & (r < p * 0.5), "declining").when(r > p * 1.5, "accelerating").otherwise("stable")
    return base.join(peak, "site_id").filter("dated_posts >= 5").select(
        "site_id", "dated_posts", "recent", "previous", "range_days",
        F.bround(r / 13, 2).alias("recent_weekly"), F.bround(p / 13, 2).alias("previous_weekly"),
        F.bround(F.col("dated_posts") / F.greatest(F.lit(1.0), F.col("range_days") / 7), 2).alias("overall_weekly"),
        F.col("_p.y").alias("peak_year"), F.col("_p.n").alias("peak_posts"), trend.alias("trend"),
    )


def velocity_decline(posts: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """One problem on the newest post of every site that slowed down."""
    slow = publishing_velocity(posts, as_of, days).filter("trend = 'declining'").select("site_id", "recent_weekly")
    newest = top_per_group(posts.select("site_id", "post_id", "publish_date"), ["site_id"], [F.desc_nulls_last("publish_date"), F.asc("post_id")], 1)
    return _row(newest.join(slow, "site_id"), "velocity_decline", "medium", F.col("recent_weekly"))


def duplicate_problems(posts: DataFrame) -> DataFrame:
    """Every copy but the first of a repeated content."""
    return _row(exact_duplicates(posts), "duplicate_content", "critical", F.col("canonical_id"))


def group_related(problems: DataFrame) -> DataFrame:
    """Orphans swallow the missing-links problem; thin posts mark the cluster variant.

    A post has one row per type at most, so its rows meet in a window and the
    detectors behind ``problems`` run once.
    """
    kind = F.col("problem_type")
    of_post = Window.partitionBy("post_id")
    has = lambda x: F.max(kind == x).over(of_post)
    df = problems.withColumns({"_o": has("orphan"), "_t": has("thin_content")})
    return df.filter(~(F.col("_o") & (kind == "seo_no_internal_links"))).withColumn(
        "related_to", F.when(F.col("_t") & (kind == "thin_below_cluster_avg"), "thin_content")
    ).drop("_o", "_t")


def severity_score(problem_type: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, problem_type), F.lit(50))


def merge_problems(old: DataFrame, new: DataFrame, as_of: str) -> DataFrame:
    """One row per (post, type): the last rule wins and the first detection date stays.

    new(post_id, problem_type, severity, value, rule).
    """
    key = ["post_id", "problem_type"]
    latest = new.groupBy(*key).agg(F.max_by(F.struct("severity", "value"), "rule").alias("_v"))
    seen = old.groupBy(*key).agg(F.min("first_detected_at").alias("_first"))
    today = F.lit(as_of).cast("date")
    return latest.join(seen, key, "left").select(
        *key, "_v.severity", "_v.value", severity_score(F.col("problem_type")).alias("severity_score"),
        today.alias("detected_at"), F.coalesce("_first", today).alias("first_detected_at"),
    )


def detectors(
    posts: DataFrame, gsc: DataFrame, ga4: DataFrame, links: DataFrame, clusters: DataFrame, scored: DataFrame, industries: DataFrame, as_of: str,
    days: int = 90, velocity_days: int = 90, bounce: float = 0.8, seconds: float = 30, least_resolved: float = MIN_RESOLUTION,
) -> dict[str, DataFrame]:
    """Every detector over the posts of all sites, in the order in which a later one overrides an earlier one.

    Link checks leave out the sites whose links mostly have no known target.
    Texts, daily facts and links are read once; posts of ``scan`` come without texts.
    """
    posts = posts if "issues" in posts.columns else scan(posts)
    gsc = durable(gsc.select("post_id", "date", "clicks", "avg_position"))
    links = durable(links.select("source_post_id", "target_post_id"))
    decline = click_decline(gsc, as_of, days)
    gated = durable(unreliable_sites(posts, links, least_resolved))
    return {
        "decline": decline, "stale": stale_ranking(posts, gsc, as_of), "drop": position_drop(gsc, as_of, days),
        "proxy": proxy_decay(posts, decline, as_of), "thin": thin_content(posts, links), "cluster": thin_in_cluster(posts, clusters),
        "bounce": high_bounce(ga4.join(posts.select("post_id"), "post_id", "left_semi"), as_of, bounce=bounce, seconds=seconds),
        "seo": seo_issues(posts, links, gated), "orphan": orphans(posts, links, gated), "reading": hard_to_read(scored, industries),
        "velocity": velocity_decline(posts, as_of, velocity_days), "duplicate": duplicate_problems(posts),
    }


def detect_all(parts: dict[str, DataFrame], old: DataFrame, as_of: str) -> DataFrame:
    """Union of all detectors, merged, with related problems grouped."""
    rows = [df.select("post_id", "problem_type", "severity", "value").withColumn("rule", F.lit(i)) for i, df in enumerate(parts.values())]
    return group_related(merge_problems(old, reduce(lambda a, b: a.unionByName(b), rows), as_of))


# fixed values: family each problem type is counted under
FAMILIES = [
    ("decay", "decay_"), ("thin", "thin_"), ("seo", "seo_"), ("orphan", "orphan"), ("readability", "readability"), ("velocity", "velocity"),
    ("duplicate", "duplicate_content"), ("ai_readiness", "geo_"), ("ai_readiness", "missing_schema"), ("ai_readiness", "low_ai_citability"),
    ("ai_readiness", "weak_eeat"), ("ai_readiness", "poor_ai_structure"),
]


def family_counts(problems: DataFrame, posts: DataFrame) -> DataFrame:
    """Problems of each site by family; a type of no family counts as other."""
    fam = F.lit("other")
    for name, prefix in reversed(FAMILIES):
        fam = F.when(F.col("problem_type").startswith(prefix), name).otherwise(fam)
    placed = problems.select("post_id", fam.alias("family")).join(posts.select("post_id", "site_id"), "post_id")
    return placed.groupBy("site_id", "family").agg(F.count("*").alias("n"))


def list_problems(problems: DataFrame, problem_type: str | None = None, severity: str | None = None, by: str = "severity", limit: int | None = None, offset: int = 0) -> DataFrame:
    """Page of unresolved problems (all without a limit), worst first."""
    df = problems.filter(F.col("resolved_at").isNull())
    if problem_type:
        df = df.filter(F.col("problem_type") == problem_type)
    if severity:
        df = df.filter(F.col("severity") == severity)
    order = F.desc(severity_score(F.col("problem_type"))) if by == "weight" else severity_rank(F.col("severity"))
    out = df.orderBy(order, "post_id", "problem_type").offset(offset)
    return out.limit(limit) if limit else out
