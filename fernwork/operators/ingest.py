"""Loading, merging and diffing of posts and daily metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import html as hx
from ..functions import text as tx
from ..functions import urls as ux
from ..plans.scale import top_per_group

META_LIMIT = 320  # characters kept of a meta description


# ---- sources -------------------------------------------------------------


def cms_posts(rows: DataFrame, raw: str = "json") -> DataFrame:
    """CMS JSON documents → posts; meta falls back plugin → og → excerpt."""
    schema = (
        "link string, slug string, date string, modified string, title struct<rendered:string>, "
        "content struct<rendered:string>, excerpt struct<rendered:string>, categories array<bigint>, tags array<bigint>, "
        "yoast_head_json struct<description:string, og_description:string>"
    )
    j = rows.withColumn("_j", F.from_json(raw, schema))
    cut = lambda c: F.nullif(F.substring(tx.strip(c), 1, META_LIMIT), F.lit(""))
    body = F.coalesce(F.col("_j.content.rendered"), F.lit(""))
    text = hx.visible_text(body)
    return j.select(
        *[c for c in rows.columns if c != raw],
        F.coalesce("_j.link", F.lit("")).alias("url"),
        F.coalesce("_j.slug", F.lit("")).alias("slug"),
        F.coalesce("_j.title.rendered", F.lit("Untitled")).alias("title"),
        text.alias("body_text"),
        tx.word_count(text).alias("word_count"),
        hx.iso_timestamp(F.col("_j.date")).alias("publish_date"),
        hx.iso_timestamp(F.col("_j.modified")).alias("modified_date"),
        F.coalesce(
            cut(F.col("_j.yoast_head_json.description")),
            cut(F.col("_j.yoast_head_json.og_description")),
            F.nullif(F.substring(hx.inner_text(F.col("_j.excerpt.rendered")), 1, META_LIMIT), F.lit("")),
        ).alias("meta_description"),
        F.col("_j.categories").alias("category_ids"),
        F.col("_j.tags").alias("tag_ids"),
    )


def resolve_terms(posts: DataFrame, terms: DataFrame, ids: str, out: str, key: str = "post_id") -> DataFrame:
    """Names of a post's term ids in list order; unknown ids are dropped."""
    named = (
        posts.select(key, F.posexplode(ids).alias("_pos", "term_id"))
        .join(terms.select("term_id", "name"), "term_id")
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("_pos", "name"))).alias("_names"))
    )
    return posts.join(named, key, "left").withColumn(
        out, F.coalesce(F.transform("_names", lambda s: s["name"]), F.array().cast("array<string>"))
    ).drop("_names")


def feed_urls(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """URLs named by sitemap, sitemap index, RSS or Atom documents (kind, url)."""
    def found(kind: str, path: str) -> Column:
        texts = F.filter(F.transform(F.xpath(xml, F.lit(path)), lambda u: tx.strip(u)), lambda u: u != "")
        return F.transform(texts, lambda u: F.struct(F.lit(kind).alias("kind"), u.alias("url")))

    parts = F.concat(
        *[
            found(kind, path)
            for kind, path in [
                ("sitemap", "//*[local-name()='sitemap']/*[local-name()='loc']/text()"),
                ("url", "//*[local-name()='url']/*[local-name()='loc']/text()"),
                ("item", "//*[local-name()='item']/*[local-name()='link']/text()"),
                (
                    "entry",
                    "//*[local-name()='entry']/*[local-name()='link'][@rel='alternate' or "
                    "(not(../*[local-name()='link'][@rel='alternate']) and not(preceding-sibling::*[local-name()='link']))]/@href",
                ),
            ]
        ]
    )
    return docs.select(*[c for c in docs.columns if c != xml], F.inline(parts))


def filter_url_patterns(urls: DataFrame, patterns: list[str], url: str = "url") -> DataFrame:
    """Keep URLs whose lower-cased path contains one of the patterns."""
    if not patterns:
        return urls
    return urls.filter(tx.any_of(F.lower(ux.path(F.col(url))), patterns))


def filter_disallowed(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Drop URLs a robots rule forbids: the first matching rule of the host decides.

    rules(host, pos, allow, prefix). A host's rules come from one small file,
    so they travel as one array per host and URLs are never multiplied.
    """
    per_host = rules.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("pos", "allow", "prefix"))).alias("_rules"))
    p = F.when(ux.path(F.col(url)) == "", F.lit("/")).otherwise(ux.path(F.col(url)))
    first = F.try_element_at(F.filter("_rules", lambda r: p.startswith(r["prefix"])), F.lit(1))
    return (
        urls.withColumn("host", ux.netloc(F.col(url)))
        .join(per_host, "host", "left")
        .filter(F.coalesce(first["allow"], F.lit(True)))
        .drop("_rules")
    )


def crawl_cap(urls: DataFrame, limit: int, url: str = "url") -> DataFrame:
    """The ``limit`` shallowest URLs, ties by URL."""
    return urls.withColumn("depth", ux.depth(F.col(url))).orderBy("depth", url).limit(limit)


# ---- daily metrics -------------------------------------------------------


def load_search_rows(raw: DataFrame, posts: DataFrame) -> DataFrame:
    """Raw (page, query, date, …) rows matched to posts; last row of a key wins."""
    u = F.col("url")
    bare = F.regexp_extract(u, r"^([^?#]*)", 1)
    keys = posts.select(
        "post_id", F.explode(F.array_distinct(F.array(F.rtrim(u, F.lit("/")), F.rtrim(bare, F.lit("/"))))).alias("_page")
    ).groupBy("_page").agg(F.max("post_id").alias("post_id"))
    return (
        raw.withColumn("_page", F.rtrim("page", F.lit("/")))
        .join(keys, "_page")
        .groupBy("post_id", F.col("date").cast("date").alias("date"), "query")
        .agg(
            F.max_by(
                F.struct(
                    F.coalesce("impressions", F.lit(0)).alias("impressions"),
                    F.coalesce("clicks", F.lit(0)).alias("clicks"),
                    F.coalesce("position", F.lit(0.0)).alias("avg_position"),
                    F.coalesce("ctr", F.lit(0.0)).alias("ctr"),
                ),
                "row_id",
            ).alias("_m")
        )
        .select("post_id", "date", "query", "_m.*")
    )


def search_page_days(raw: DataFrame, top: int = 10) -> DataFrame:
    """(page, date) totals with impression-weighted ctr and position and the
    top queries by clicks (clicks > 0, ties by query)."""
    per_query = raw.groupBy(ux.normalize_url(F.col("page")).alias("page"), "date", "query").agg(
        F.sum("clicks").alias("clicks"),
        F.sum("impressions").alias("impressions"),
        F.sum(F.col("ctr") * F.col("impressions")).alias("_ctr"),
        F.sum(F.col("position") * F.col("impressions")).alias("_pos"),
        F.count("*").alias("_rows"),
    )
    weighted = lambda c: F.when(F.sum("impressions") > 0, F.sum(c) / F.sum("impressions")).otherwise(F.lit(0.0))
    days = per_query.groupBy("page", "date").agg(
        F.sum("clicks").alias("clicks"),
        F.sum("impressions").alias("impressions"),
        weighted("_ctr").alias("ctr"),
        weighted("_pos").alias("avg_position"),
        F.sum("_rows").alias("query_count"),
    )
    best = top_per_group(
        per_query.filter("clicks > 0").select("page", "date", "query", "clicks"),
        ["page", "date"], [F.desc("clicks"), F.asc("query")], top, rank="_rn",
    )
    lists = best.groupBy("page", "date").agg(F.array_sort(F.collect_list(F.struct("_rn", "query"))).alias("_q"))
    return days.join(lists, ["page", "date"], "left").select(
        *days.columns,
        F.coalesce(F.array_join(F.transform("_q", lambda s: s["query"]), ","), F.lit("")).alias("top_queries"),
    )


def load_traffic_rows(raw: DataFrame, posts: DataFrame) -> DataFrame:
    """Raw analytics rows (pagePath, yyyymmdd strings) matched to posts by path."""
    keys = posts.groupBy(F.lower(F.rtrim(ux.path(F.col("url")), F.lit("/"))).alias("_path")).agg(
        F.max("post_id").alias("post_id")
    )
    typed = raw.filter(F.length("date") == 8).select(
        F.lower(F.rtrim(F.coalesce("pagePath", F.lit("")), F.lit("/"))).alias("_path"),
        F.to_date("date", "yyyyMMdd").alias("date"),
        F.coalesce(F.expr("try_cast(screenPageViews AS bigint)"), F.lit(0)).alias("pageviews"),
        F.coalesce(F.expr("try_cast(sessions AS bigint)"), F.lit(0)).alias("sessions"),
        F.coalesce(F.expr("try_cast(bounceRate AS double)"), F.lit(0.0)).alias("bounce_rate"),
        F.coalesce(F.expr("try_cast(averageSessionDuration AS double)"), F.lit(0.0)).alias("avg_session_duration"),
        F.coalesce(F.expr("try_cast(engagedSessions AS bigint)"), F.lit(0)).alias("engaged_sessions"),
    )
    return typed.join(keys, "_path").drop("_path")


def sync_window(facts: DataFrame, sites: DataFrame, as_of: str, lag: int = 3, back: int = 90) -> DataFrame:
    """Per site: first and last date still to fetch, and whether any remains."""
    last = facts.groupBy("site_id").agg(F.max("date").alias("last_date"))
    today = F.lit(as_of).cast("date")
    return sites.select("site_id").distinct().join(last, "site_id", "left").select(
        "site_id",
        F.coalesce(F.date_add("last_date", 1), F.date_sub(today, back)).alias("start_date"),
        F.date_sub(today, lag).alias("end_date"),
    ).withColumn("due", F.col("start_date") <= F.col("end_date"))


# ---- merging -------------------------------------------------------------


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Union by key where the highest version wins; combines before the shuffle."""
    rest = [c for c in old.columns if c not in keys]
    both = old.unionByName(new)
    return (
        both.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.col(version)).alias("_row"))
        .select(*keys, "_row.*")
    )


def recrawl_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Status per URL: new, updated (hash differs), unchanged or deleted."""
    o = old.select("url", F.col("content_hash").alias("old_hash"))
    n = new.select("url", F.col("content_hash").alias("new_hash"))
    return o.join(n, "url", "full_outer").select(
        "url",
        F.when(F.col("old_hash").isNull(), "new")
        .when(F.col("new_hash").isNull(), "deleted")
        .when(F.col("old_hash") != F.col("new_hash"), "updated")
        .otherwise("unchanged").alias("status"),
    )


def soft_delete(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old posts with http_status 410 where the fresh crawl lacks the URL."""
    seen = new.select("url").distinct().withColumn("_seen", F.lit(True))
    return old.join(seen, "url", "left").withColumn(
        "http_status", F.when(F.col("_seen").isNull(), F.lit(410)).otherwise(F.col("http_status"))
    ).drop("_seen")


def embedding_candidates(posts: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Posts with text whose embedding is missing or was made from other text."""
    e = embeddings.select("post_id", F.col("content_hash").alias("_hash"))
    return (
        posts.filter(F.coalesce("body_text", F.lit("")) != "")
        .join(e, "post_id", "left")
        .filter(F.col("_hash").isNull() | (F.col("_hash") != F.col("content_hash")))
        .drop("_hash")
    )


# fixed values: how old a site's data may get, and how many sites one run takes
REFRESH_RULES = {"analytics": (1, 50), "crawl": (7, 20), "embed": (30, 10)}


def refresh_due(sites: DataFrame, as_of: str, kind: str, embeds: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Sites whose data is too old, stalest first; with a limit (``REFRESH_RULES`` has that of one run) the first of them."""
    days, _ = REFRESH_RULES[kind]
    first = lambda df: df if limit is None else df.limit(limit)
    limit_ts = F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp")
    if kind == "embed":
        per_site = embeds.groupBy("site_id").agg(
            F.max((F.col("stale") | (F.col("updated_at") < limit_ts)).cast("int")).alias("_due")
        )
        due = sites.join(per_site, "site_id", "left").filter(F.col("_due").isNull() | (F.col("_due") == 1))
        return first(due.drop("_due").orderBy("site_id"))
    column = {"analytics": "last_sync_at", "crawl": "last_crawl_at"}[kind]
    due = sites.filter(F.col(column).isNull() | (F.col(column) < limit_ts))
    if kind == "analytics":
        due = due.filter("connected")
    return first(due.orderBy(F.asc_nulls_first(column), "site_id"))


# ---- sinks ---------------------------------------------------------------


def redirect_lines(redirects: DataFrame, fmt: str) -> DataFrame:
    """One export line per (old_url, new_url): htaccess, plugin or csv."""
    old, new = F.col("old_url"), F.col("new_url")
    quoted = lambda c: F.replace(c, F.lit('"'), F.lit('""'))
    if fmt == "htaccess":
        rest = F.regexp_replace(old, r"^.*?//", "")
        p = F.when(F.contains(old, F.lit("//")), F.regexp_replace(rest, r"^[^/]*/", "")).otherwise(old)
        p = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))
        line = F.concat(F.lit("Redirect 301 "), p, F.lit(" "), new)
    elif fmt == "plugin":
        line = F.format_string('"%s","%s",0,301', quoted(old), quoted(new))
    else:
        line = F.format_string('"%s","%s"', quoted(old), quoted(new))
    return redirects.select(F.lit(fmt).alias("fmt"), line.alias("line"))


# fixed values: first lines of each export format
REDIRECT_HEADERS = {
    "htaccess": ["# Redirect map - paste into your .htaccess file", "# Make sure mod_rewrite is enabled", ""],
    "plugin": ["source,target,regex,type"],
    "csv": ["old_url,new_url"],
}


def write_redirects(redirects: DataFrame, fmt: str, path: str) -> None:
    """Text files with the header of the format in the first part."""
    spark = redirects.sparkSession
    head = spark.createDataFrame([(h,) for h in REDIRECT_HEADERS[fmt]], "value string").coalesce(1)
    head.unionByName(redirect_lines(redirects, fmt).select(F.col("line").alias("value"))).write.mode("overwrite").text(path)


def write_site_table(df: DataFrame, path: str, partition: str = "site_id") -> None:
    """Replace only the sites present in ``df`` (delete + insert per site)."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )


def replace_sites(df: DataFrame, sites: DataFrame, path: str, partition: str = "site_id") -> int:
    """Replace the rows of all ``sites`` (one column), also of those that ``df`` has no rows of; returns the run's number.

    Rows go to ``rows/run=N`` first; the list of the sites that run N covers
    goes to ``sites/run=N`` last, as one file, and only that makes the rows
    count. A run that fails before leaves the earlier rows in force, and the
    next run writes over what it left. One writer at a time. Rows of sites
    outside the list are refused; a null site is a site like others.
    """
    spark = df.sparkSession
    if "run" in df.columns:
        raise ValueError("the column name run is taken")
    covered = sites.select(partition).distinct()
    out = df.select(partition).distinct().join(covered.withColumnRenamed(partition, "_site"), F.col(partition).eqNullSafe(F.col("_site")), "left_anti")
    stray = out.first()
    if stray is not None:
        raise ValueError(f"rows of {partition} {stray[0]!r}, which the run does not cover")
    last = _runs(spark, path, covered.schema).agg(F.max("run")).first()[0]
    run = 0 if last is None else last + 1
    df.write.mode("overwrite").parquet(f"{path}/rows/run={run}")
    covered.coalesce(1).write.mode("overwrite").parquet(f"{path}/sites/run={run}")
    return run


def _runs(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(site, run) of all runs that were finished."""
    named = StructType([*schema, StructField("run", LongType())])
    try:
        return spark.read.schema(named).parquet(f"{path}/sites")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], named)


def site_rows(spark: SparkSession, path: str, partition: str = "site_id") -> DataFrame:
    """The rows in force: of each site those of the last run that covers it. One run at least has been finished."""
    rows = spark.read.parquet(f"{path}/rows")
    runs = _runs(spark, path, rows.select(partition).schema)
    now = runs.groupBy(F.col(partition).alias("_site")).agg(F.max("run").alias("_run"))
    return rows.join(now, (F.col("run") == F.col("_run")) & F.col(partition).eqNullSafe(F.col("_site")), "left_semi").drop("run")


def compact_sites(spark: SparkSession, path: str, target: str, partition: str = "site_id") -> None:
    """The rows in force as the first run of a new table, sorted by site so that its files can be skipped by it."""
    rows = site_rows(spark, path, partition)
    known = _runs(spark, path, rows.select(partition).schema).select(partition)
    replace_sites(rows.repartitionByRange(partition).sortWithinPartitions(partition), known, target, partition)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)

