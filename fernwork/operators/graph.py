"""Internal link graph: PageRank, link health and flows between clusters."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.scale import durable
from .vectors import top_matches

MIN_RESOLUTION = 0.20  # share of resolved links below which the graph is not trusted
EDGES_PER_SPLIT = 1_000_000  # a hub's out-edges are spread over this many per piece


def pagerank(
    nodes: DataFrame, edges: DataFrame, damping: float = 0.85, tol: float = 1e-6, max_iter: int | None = None
) -> DataFrame:
    """Rank per (site, node): nodes(site_id, id), edges(site_id, src, dst).

    Edges are laid out once by (src, piece) and checkpointed; each round only
    moves the rank vector, and a hub's rank is copied to each of its pieces.
    Mass of nodes without out-links is shared evenly inside the site. Stops
    when every site's L1 change is below n · tol; the change shrinks by the
    damping factor each round, so that comes after about log(tol) / log(damping)
    rounds. With ``max_iter`` rounds that don't suffice, it fails.
    """
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes = nodes.select("site_id", "id").distinct()
    known = nodes.withColumnRenamed("id", "dst")
    edges = (
        edges.select("site_id", "src", "dst").distinct()
        .join(known, ["site_id", "dst"], "left_semi")
        .join(nodes.withColumnRenamed("id", "src"), ["site_id", "src"], "left_semi")
    )
    degree = edges.groupBy("site_id", F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    sizes = nodes.groupBy("site_id").agg(F.count("*").alias("n"))
    state = durable(
        nodes.join(degree, ["site_id", "id"], "left").join(sizes, "site_id").select(
            "site_id", "id", "n", F.coalesce("degree", F.lit(0)).alias("degree"),
            F.ceil(F.coalesce("degree", F.lit(0)) / EDGES_PER_SPLIT).cast("int").alias("pieces"),
            (F.lit(1.0) / F.col("n")).alias("rank"),
        )
    )
    layout = durable(
        edges.join(state.select("site_id", F.col("id").alias("src"), "pieces"), ["site_id", "src"])
        .select("site_id", "src", F.pmod(F.xxhash64("dst"), F.col("pieces")).cast("int").alias("piece"), "dst")
        .repartition(parts, "site_id", "src", "piece"),
        layout=True,
    )
    n_sites = state.select("site_id").distinct().count()
    for number in count(1):
        if max_iter and number > max_iter:
            raise RuntimeError(f"PageRank has not settled after {max_iter} rounds")
        share = state.filter("degree > 0").select(
            "site_id", F.col("id").alias("src"),
            F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"),
            (F.col("rank") / F.col("degree")).alias("share"),
        )
        got = (
            layout.join(share, ["site_id", "src", "piece"])
            .groupBy("site_id", F.col("dst").alias("id")).agg(F.sum("share").alias("got"))
        )
        loose = state.filter("degree = 0").groupBy("site_id").agg(F.sum("rank").alias("loose"))
        fresh = state.join(got, ["site_id", "id"], "left").join(loose, "site_id", "left").select(
            "site_id", "id", "n", "degree", "pieces",
            ((1 - damping) / F.col("n") + damping * (F.coalesce("got", F.lit(0.0)) + F.coalesce("loose", F.lit(0.0)) / F.col("n"))).alias("rank"),
            F.col("rank").alias("old"),
        )
        # the summed change relative to the limits rides along with the checkpoint
        seen = Observation()
        change = F.abs(F.col("rank") - F.col("old")) / (F.col("n") * tol)
        fresh = durable(fresh.observe(seen, F.sum(change).alias("total")))
        state = fresh.drop("old")
        total = seen.get["total"] or 0.0
        if total < 1:
            break  # no site can be above its limit
        if total < n_sites:
            # some site may be: look at each one (with one site the total decides)
            worst = fresh.groupBy("site_id").agg(F.sum(change).alias("g")).agg(F.max("g")).first()[0]
            if worst < 1:
                break
    return state.select("site_id", "id", F.col("rank").alias("pagerank"))


def resolution(links: DataFrame, keys: list[str]) -> DataFrame:
    """Share of links with a known target and whether link checks can be trusted."""
    ratio = F.avg(F.col("target_post_id").isNotNull().cast("double"))
    return links.groupBy(*keys).agg(
        F.count("*").alias("total_links"), F.count("target_post_id").alias("resolved_links"), ratio.alias("resolution_rate")
    ).withColumn("reliable", F.col("resolution_rate") >= MIN_RESOLUTION)


def site_pagerank(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """PageRank where enough links resolve, else 1/n for every node of the site.

    links(site_id, source_post_id, target_post_id).
    """
    rate = resolution(links, ["site_id"]).filter("reliable AND resolved_links > 0").select("site_id")
    edges = links.filter(F.col("target_post_id").isNotNull()).select(
        "site_id", F.col("source_post_id").alias("src"), F.col("target_post_id").alias("dst")
    )
    ranked = pagerank(nodes.join(rate, "site_id", "left_semi"), edges.join(rate, "site_id", "left_semi"))
    sizes = nodes.groupBy("site_id").agg(F.count("*").alias("_n"))
    return (
        nodes.join(sizes, "site_id").join(ranked, ["site_id", "id"], "left")
        .select("site_id", "id", F.coalesce("pagerank", 1 / F.col("_n")).alias("pagerank"))
    )


def _inside(domain: str | Column) -> Column:
    """Whether a target URL names the own domain: one domain, or a column with that of each link's site."""
    return F.contains("target_url", domain if isinstance(domain, Column) else F.lit(domain))


def broken_links(links: DataFrame, posts: DataFrame, domain: str | Column, keys: list[str] | None = None) -> DataFrame:
    """Links to the own domain whose URL is not a known post; with ``keys`` (as site_id) not one of the same site."""
    known = posts.select(*(keys or []), F.col("url").alias("target_url")).distinct()
    return links.filter(_inside(domain)).join(known, [*(keys or []), "target_url"], "left_anti")


def outbound_counts(links: DataFrame, domain: str | Column) -> DataFrame:
    """External links per source post."""
    return links.filter(~_inside(domain)).groupBy(F.col("source_post_id").alias("post_id")).agg(
        F.count("*").alias("external_links")
    )


def link_counts(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Inbound and outbound internal link counts, zero where there are none."""
    inbound = links.filter(F.col("target_post_id").isNotNull()).groupBy(F.col("target_post_id").alias("post_id")).agg(
        F.count("*").alias("inbound")
    )
    outbound = links.groupBy(F.col("source_post_id").alias("post_id")).agg(F.count("*").alias("outbound"))
    return (
        nodes.select("post_id").join(inbound, "post_id", "left").join(outbound, "post_id", "left")
        .select("post_id", F.coalesce("inbound", F.lit(0)).alias("inbound"), F.coalesce("outbound", F.lit(0)).alias("outbound"))
    )


def inbound_stats(links: DataFrame, posts: DataFrame) -> DataFrame:
    """Mean and largest inbound count and the most linked title of each site."""
    per = links.filter(F.col("target_post_id").isNotNull()).groupBy("site_id", F.col("target_post_id").alias("post_id")).agg(F.count("*").alias("n"))
    titles = per.join(posts.select("post_id", "title"), "post_id").groupBy("site_id", "title").agg(F.sum("n").alias("n"))
    # most links first, ties by title
    top = titles.groupBy("site_id").agg(F.min_by(F.struct("title", "n"), F.struct(-F.col("n"), F.col("title"))).alias("_t"))
    stats = per.groupBy("site_id").agg(F.round(F.avg("n"), 1).alias("avg_in"), F.max("n").alias("max_in"))
    return stats.join(top, "site_id", "left").select("site_id", "avg_in", "max_in", F.col("_t.title").alias("most_linked"), F.col("_t.n").alias("most_linked_count"))


def cluster_flows(links: DataFrame, clusters: DataFrame) -> DataFrame:
    """Links between cluster pairs, both ways (from < to)."""
    s = clusters.select(F.col("post_id").alias("source_post_id"), F.col("cluster_id").alias("_a"))
    d = clusters.select(F.col("post_id").alias("target_post_id"), F.col("cluster_id").alias("_b"))
    both = links.join(s, "source_post_id").join(d, "target_post_id").filter("_a <> _b")
    flows = both.groupBy(F.least("_a", "_b").alias("from_cluster"), F.greatest("_a", "_b").alias("to_cluster")).agg(
        F.count_if(F.col("_a") < F.col("_b")).alias("forward_links"), F.count_if(F.col("_a") > F.col("_b")).alias("backward_links")
    )
    f, b = F.col("forward_links"), F.col("backward_links")
    return flows.withColumns(
        {
            "total_links": f + b,
            "bidirectional_ratio": F.bround(F.least(f, b) / F.greatest(f, b, F.lit(1)), 2),
            "width": F.bround(F.least((f + b) / 3.0, F.lit(5.0)), 2),
        }
    )


def flow_quality(flows: DataFrame, scores: DataFrame) -> DataFrame:
    """Quality of a flow from the mean health of its two clusters."""
    eng = scores.groupBy("cluster_id").agg(F.avg("composite_score").alias("_s")).select(
        "cluster_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_s") / 100)).alias("_e")
    )
    a = eng.select(F.col("cluster_id").alias("from_cluster"), F.col("_e").alias("_ea"))
    b = eng.select(F.col("cluster_id").alias("to_cluster"), F.col("_e").alias("_eb"))
    mean = (F.coalesce("_ea", F.lit(0.0)) + F.coalesce("_eb", F.lit(0.0))) / 2
    quality = F.when(mean > 0.7, "sparkling").when(mean > 0.4, "clear").when(mean > 0.2, "murky").otherwise("toxic")
    return flows.join(a, "from_cluster", "left").join(b, "to_cluster", "left").withColumn("quality", quality).drop("_ea", "_eb")


def orphan_suggestions(vectors: DataFrame, links: DataFrame, k: int = 5, floor: float = 0.20) -> DataFrame:
    """For each post without inbound links, similar posts of its site that already link out.

    When fewer than a fifth of a site's orphans find a partner, the site gets one
    general row instead (neighbour_id null, rank 0). vectors(site_id, post_id, vec).
    """
    targets = links.filter(F.col("target_post_id").isNotNull()).select(F.col("target_post_id").alias("post_id")).distinct()
    sources = links.select(F.col("source_post_id").alias("post_id")).distinct()
    orphans = vectors.join(targets, "post_id", "left_anti")
    found = top_matches(orphans, vectors.join(sources, "post_id", "left_semi"), k, ["site_id"], floor=floor)
    found = found.withColumn("site_id", F.col("site_id").cast(vectors.schema["site_id"].dataType))
    all_ = orphans.groupBy("site_id").agg(F.count("*").alias("_all"), F.min("post_id").alias("_first"))
    counts = all_.join(found.groupBy("site_id").agg(F.count_distinct("post_id").alias("_good")), "site_id", "left").withColumn(
        "_sparse", F.coalesce("_good", F.lit(0)) < F.col("_all") * 0.2
    )
    rows = found.join(counts, "site_id").filter("NOT _sparse").select("site_id", "post_id", "neighbour_id", "similarity", "rank")
    site = counts.filter("_sparse").select(
        "site_id", F.col("_first").alias("post_id"), F.lit(None).cast("bigint").alias("neighbour_id"),
        F.lit(None).cast("double").alias("similarity"), F.lit(0).alias("rank"),
    )
    return rows.unionByName(site)


def link_breakdown(links: DataFrame, nodes: DataFrame, blog: str = "/blog/") -> DataFrame:
    """Resolved and unresolved links of each site, inside and outside the blog, and its orphan count: nodes(site_id, post_id)."""
    open_ = F.col("target_post_id").isNull()
    in_blog = F.contains("target_url", F.lit(blog))
    stats = links.groupBy("site_id").agg(
        F.count("*").alias("total"), F.count_if(~open_).alias("resolved"),
        F.count_if(open_ & ~in_blog).alias("non_blog"), F.count_if(open_ & in_blog).alias("unresolved_blog"),
    )
    targets = links.filter(~open_).select(F.col("target_post_id").alias("post_id")).distinct()
    orphans = nodes.join(targets, "post_id", "left_anti").groupBy("site_id").agg(F.count("*").alias("orphans"))
    return stats.join(orphans, "site_id", "full_outer").na.fill(0, ["total", "resolved", "non_blog", "unresolved_blog", "orphans"])
