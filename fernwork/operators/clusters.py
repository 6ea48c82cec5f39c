"""Embedding centroids, topic clusters, their quality and layout."""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scale import durable
from .density import forest, labelled
from .vectors import dot, top_matches, unit

# fixed values: sizes and limits of clustering
SMALL_SITE = 15  # posts below which a site is one cluster
MAX_CLUSTER = 25  # posts above which a cluster is split again
FAIR_SILHOUETTE = 0.1  # below it the smallest cluster grows by one, twice
MOST_NOISE = 0.6  # share of noise above which a split is rejected


def mean_vectors(df: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """Mean vector per key; the summarizer merges partial sums map-side."""
    return (
        df.groupBy(*keys)
        .agg(Summarizer.mean(array_to_vector(F.col(vec))).alias("_m"), F.count("*").alias("n"))
        .select(*keys, vector_to_array("_m").alias(vec), "n")
    )


def centre_vectors(df: DataFrame, keys: list[str]) -> DataFrame:
    """Subtract the mean vector of the group and scale to unit length."""
    means = mean_vectors(df, keys).select(*keys, F.col("vec").alias("_mean"))
    moved = df.join(means, keys).withColumn("vec", F.zip_with("vec", "_mean", lambda a, b: a - b)).drop("_mean")
    return moved.withColumn("vec", unit(F.col("vec")))


def mean_similarity(df: DataFrame) -> DataFrame:
    """Mean of the cosine matrix (zero diagonal) of each site's vectors.

    The sum over all pairs of unit vectors is |sum|² − n, so no pairs are formed.
    """
    m = mean_vectors(df.withColumn("vec", unit(F.col("vec"))), ["site_id"])
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    return m.select("site_id", "n", (square - 1.0 / F.col("n")).alias("mean_similarity"))


def min_cluster_size(n: Column) -> Column:
    """Smallest cluster kept, by number of posts of the site."""
    return (
        F.when(n < 20, F.greatest(F.lit(2), F.floor(n / 5)))
        .when(n < 100, F.greatest(F.lit(3), F.floor(n / 10)))
        .when(n < 500, F.greatest(F.lit(5), F.floor(n / 20)))
        .when(n < 1000, F.lit(12))
        .otherwise(F.lit(20))
    ).cast("int")


def core_samples(n: Column) -> Column:
    """Neighbours that a core distance reaches to, by number of posts of the site."""
    return F.when(n < 20, 1).when(n < 100, 2).when(n < 1000, 3).otherwise(5)


def nearest_centroids(points: DataFrame, centroids: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Closest centroid of each point by Euclidean distance (ties by lowest id).

    |x − c|² is smallest where x·c − |c|²/2 is largest, a dot product of
    vectors with one extra coordinate.
    """
    group = group or []
    half = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) / 2
    left = points.select("post_id", *group, F.concat("vec", F.array(F.lit(-1.0))).alias("vec"))
    # ids below zero keep centroids apart from points that share their number
    right = centroids.select(
        (-1 - F.col("cluster_id").cast("bigint")).alias("post_id"), *group, F.concat("vec", F.array(half(F.col("vec")))).alias("vec")
    )
    best = _typed(top_matches(left, right, 1, group, metric="dot"), points, group)
    return best.select(*group, "post_id", (-1 - F.col("neighbour_id")).alias("cluster_id"))


def _typed(found: DataFrame, like: DataFrame, group: list[str]) -> DataFrame:
    """Group columns of a vector search in their own types again."""
    return found.withColumns({g: F.col(g).cast(like.schema[g].dataType) for g in group}) if group else found


def silhouettes(df: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Squared-distance silhouette per point among the clusters of its group: (*group, post_id, cluster_id, vec) → + silhouette.

    The mean squared distance from x to a cluster is |x|² + E|y|² − 2x·E[y],
    so cluster means stand in for all pairs; the best other cluster of each
    point comes from a blocked top-2 search.
    """
    group = group or []
    key, point = [*group, "cluster_id"], [*group, "post_id"]
    stats = mean_vectors(df, key).join(df.groupBy(*key).agg(F.avg(dot(F.col("vec"), F.col("vec"))).alias("sq")), key)
    own = df.join(stats.select(*key, F.col("vec").alias("_m"), "n", "sq"), key)
    x2 = dot(F.col("vec"), F.col("vec"))
    mean_sq = F.greatest(F.lit(0.0), x2 + F.col("sq") - 2 * dot(F.col("vec"), F.col("_m")))
    own = own.select(
        *point, "cluster_id", x2.alias("x2"), "n",
        F.when(F.col("n") > 1, mean_sq * F.col("n") / (F.col("n") - 1)).otherwise(F.lit(0.0)).alias("a"),
    )
    left = df.select(*point, F.concat(F.transform("vec", lambda v: 2 * v), F.array(F.lit(-1.0))).alias("vec"))
    right = stats.select(*group, (-1 - F.col("cluster_id").cast("bigint")).alias("post_id"), F.concat("vec", F.array(F.col("sq"))).alias("vec"))
    near = _typed(top_matches(left, right, 2, group, metric="dot"), df, group).select(
        *point, (-1 - F.col("neighbour_id")).alias("_other"), F.col("similarity").alias("_s")
    )
    b = near.join(own.select(*point, "cluster_id"), point).filter("_other <> cluster_id").groupBy(*point).agg(F.max("_s").alias("_s"))
    joined = own.join(b, point, "left").withColumn("b", F.greatest(F.lit(0.0), F.col("x2") - F.col("_s")))
    value = F.when((F.col("n") <= 1) | F.col("b").isNull(), F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    )
    return joined.select(*point, "cluster_id", value.alias("silhouette"))


def cluster_silhouettes(df: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Mean silhouette per cluster of each group, and of all points of a group under cluster_id null."""
    group = group or []
    s = silhouettes(df, group)
    mean = [F.avg("silhouette").alias("silhouette"), F.count("*").alias("n")]
    whole = s.groupBy(*group).agg(*mean).withColumn("cluster_id", F.lit(None).cast(df.schema["cluster_id"].dataType))
    return s.groupBy(*group, "cluster_id").agg(*mean).unionByName(whole)


def absorb(df: DataFrame, drop: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Move members of the listed clusters to the nearest remaining centroid of their group; without one they stay."""
    group = group or []
    key, point = [*group, "cluster_id"], [*group, "post_id"]
    bad = drop.select(*key).distinct()
    keep = df.join(bad, key, "left_anti")
    lost = df.join(bad, key, "left_semi")
    moved = nearest_centroids(lost, mean_vectors(keep, key), group).select(*point, F.col("cluster_id").alias("_new"))
    return df.join(moved, point, "left").withColumn("cluster_id", F.coalesce(F.col("_new"), F.col("cluster_id").cast("bigint"))).drop("_new")


def absorb_small(df: DataFrame, minimum: int, group: list[str] | None = None) -> DataFrame:
    """Dissolve clusters below the minimum size."""
    return absorb(df, df.groupBy(*(group or []), "cluster_id").agg(F.count("*").alias("n")).filter(F.col("n") < minimum), group)


def negative_clusters(per: DataFrame, group: list[str]) -> DataFrame:
    """Clusters (*group, cluster_id, s) with a negative silhouette, of groups with at least three clusters and one that is not negative."""
    totals = per.groupBy(*group).agg(F.count("*").alias("_total"), F.count_if(F.col("s") < 0).alias("_bad"))
    judged = per.join(totals, group) if group else per.withColumn("_k", F.lit(1)).join(totals.withColumn("_k", F.lit(1)), "_k")
    return judged.filter("s < 0 AND _total >= 3 AND _bad < _total").select(*group, "cluster_id")


def dissolve_negative(df: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Dissolve clusters of negative silhouette in groups of at least three clusters."""
    group = group or []
    per = durable(silhouettes(df, group).groupBy(*group, "cluster_id").agg(F.avg("silhouette").alias("s")))
    return absorb(df, negative_clusters(per, group), group)


def topic_clusters(vectors: DataFrame) -> DataFrame:
    """One cluster for each post, all sites in one plan: (site_id, post_id, vec) → + cluster_id, the least post of the cluster.

    Density clusters of the vectors centred within the site; where their mean
    silhouette is poor the smallest size grows by one, twice at most. Noise goes to the nearest
    centroid of the site, clusters of negative silhouette are dissolved. Sites
    below fifteen posts, and those without any density cluster, stay whole. A
    null site is none: its posts have no row.
    """
    base = durable(vectors.filter("site_id IS NOT NULL").select("site_id", "post_id", "vec"))
    sizes = durable(base.groupBy("site_id").agg(F.count("*").alias("n"), F.min("post_id").cast("bigint").alias("first")))
    large = base.join(sizes.filter(F.col("n") >= SMALL_SITE).select("site_id"), "site_id")
    centred = durable(centre_vectors(large, ["site_id"]).select(F.col("site_id").cast("string").alias("grp"), "post_id", "vec"))
    smallest = min_cluster_size(F.col("n"))
    tries = sizes.select(F.col("site_id").cast("string").alias("grp"), F.array(smallest, smallest + 1, smallest + 2).alias("sizes"))
    labels = durable(labelled(forest(centred, core_samples(F.col("n"))), tries))
    held = labels.filter("label >= 0").join(centred, ["grp", "post_id"]).select(
        F.concat_ws("|", F.col("tried").cast("string"), "grp").alias("key"), "grp", "tried", "post_id", F.col("label").alias("cluster_id"), "vec"
    )
    judged = silhouettes(held.select("key", "post_id", "cluster_id", "vec"), ["key"])
    per = durable(judged.groupBy("key", "cluster_id").agg(F.avg("silhouette").alias("s"), F.count("*").alias("m")))
    whole = per.groupBy("key").agg(F.try_divide(F.sum(F.col("s") * F.col("m")), F.sum("m")).alias("score"), F.count("*").alias("c"))
    fair = whole.filter((F.col("c") >= 2) & (F.col("score") >= FAIR_SILHOUETTE)).join(held.select("key", "grp", "tried").distinct(), "key")
    last = labels.groupBy("grp").agg(F.max("tried").alias("last"))
    chosen = durable(last.join(fair.groupBy("grp").agg(F.min("tried").alias("tried")), "grp", "left").select("grp", F.coalesce("tried", "last").alias("tried")))
    points = labels.join(chosen, ["grp", "tried"]).join(centred, ["grp", "post_id"]).select("grp", "post_id", F.col("label").alias("cluster_id"), "vec")
    settled = durable(absorb(points, points.filter("cluster_id < 0"), ["grp"]))
    poor = per.join(chosen.select(F.concat_ws("|", F.col("tried").cast("string"), "grp").alias("key"), "grp"), "key").select("grp", "cluster_id", "s")
    done = durable(absorb(settled, negative_clusters(poor, ["grp"]), ["grp"])).select(F.col("grp").alias("_grp"), "post_id", "cluster_id")
    found = base.withColumn("_grp", F.col("site_id").cast("string")).join(done, ["_grp", "post_id"], "left").join(sizes.select("site_id", "first"), "site_id")
    return found.select("site_id", "post_id", "vec", F.when(F.col("cluster_id") >= 0, F.col("cluster_id")).otherwise(F.col("first")).alias("cluster_id"))


def split_large(df: DataFrame, limit: int = MAX_CLUSTER, depth: int | None = None) -> DataFrame:
    """Split every cluster above ``limit`` posts until none is left but those that reject it.

    (post_id, vec, cluster_id) → (post_id, cluster_id, path, rejected): path
    names the child of each level by its least post. All open clusters of a
    round are split in one pass by density around their own mean. Fewer than
    two children, or noise above 60 %, reject a split and end that path; noise
    goes to the nearest child. ``depth`` ends the rounds early.
    """
    state = durable(df.select("post_id", "vec", F.col("cluster_id").cast("string").alias("grp"), F.lit(False).alias("rejected")))
    level = 0
    while depth is None or level < depth:
        sizes = state.filter("NOT rejected").groupBy("grp").agg(F.count("*").alias("n")).filter(F.col("n") > limit)
        open_ = durable(state.drop("rejected").join(sizes, "grp"))
        if open_.isEmpty():
            break
        centred = durable(centre_vectors(open_.select("grp", "post_id", "vec"), ["grp"]))
        least = sizes.select("grp", F.array(F.greatest(F.lit(3), F.floor(F.col("n") / 10)).cast("int")).alias("sizes"))
        labels = durable(labelled(forest(centred, F.lit(2)), least).select("grp", "post_id", F.col("label").alias("cluster_id")))
        counts = labels.groupBy("grp").agg(F.count_distinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("children"), F.avg((F.col("cluster_id") < 0).cast("double")).alias("noise"))
        good = durable(counts.filter((F.col("children") >= 2) & (F.col("noise") <= MOST_NOISE)).select("grp"))
        parts = open_.join(good, "grp", "left_semi").join(labels, ["grp", "post_id"]).select("grp", "post_id", "cluster_id", "vec")
        moved = absorb(parts, parts.filter("cluster_id < 0"), ["grp"]).select("grp", "post_id", F.concat_ws(".", "grp", F.col("cluster_id").cast("string")).alias("_next"))
        ended = open_.select("grp").distinct().join(good, "grp", "left_anti").withColumn("_ended", F.lit(True))
        state = state.join(moved, ["grp", "post_id"], "left").join(ended, "grp", "left")
        state = durable(state.select("post_id", "vec", F.coalesce("_next", "grp").alias("grp"), F.coalesce("_ended", "rejected").alias("rejected")))
        level += 1
    return state.join(df.select("post_id", "cluster_id"), "post_id").select("post_id", "cluster_id", F.col("grp").alias("path"), "rejected")


def circle_layout(index: Column, n: Column) -> list[Column]:
    """Places the posts of a tiny site on a circle of radius two."""
    angle = 2 * math.pi * index / F.greatest(n, F.lit(1))
    return [(F.cos(angle) * 2.0).alias("x"), (F.sin(angle) * 2.0).alias("y")]


def small_site_labels(posts: DataFrame, clusters: DataFrame) -> DataFrame:
    """Cluster per post, forced to 0 on sites below fifteen posts."""
    sizes = posts.groupBy("site_id").agg(F.count("*").alias("_n"))
    return posts.join(sizes, "site_id").join(clusters, "post_id", "left").select(
        "post_id", "site_id", F.when(F.col("_n") < SMALL_SITE, F.lit(0)).otherwise(F.col("cluster_id")).alias("cluster_id")
    )


def leaf_clusters(clusters: DataFrame) -> DataFrame:
    """Clusters that are nobody's parent."""
    parents = clusters.filter(F.col("parent_cluster_id").isNotNull()).select(F.col("parent_cluster_id").alias("cluster_id")).distinct()
    return clusters.join(parents, "cluster_id", "left_anti")


def cluster_centres(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Mean x, y of the members, zero without any: members(cluster_id, x, y)."""
    c = members.groupBy("cluster_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return clusters.join(c, "cluster_id", "left").withColumns({"x": F.coalesce("x", F.lit(0.0)), "y": F.coalesce("y", F.lit(0.0))})


def centroid_nearest(vectors: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Per cluster the cosine distance from its centroid to the nearest post of the site, ``group`` being the site's key."""
    group = group or []
    cents = mean_vectors(vectors, [*group, "cluster_id"])
    left = cents.select(*group, (-1 - F.col("cluster_id").cast("bigint")).alias("post_id"), "vec")
    best = _typed(top_matches(left, vectors.select(*group, "post_id", "vec"), 1, group), vectors, group)
    return best.select(
        *group, (-1 - F.col("post_id")).alias("cluster_id"), F.col("neighbour_id").alias("post_id"), (1 - F.col("similarity")).alias("distance")
    )


def membership_report(posts: DataFrame, clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Totals of assigned, multi-assigned and unassigned posts."""
    m = members.join(posts.select("post_id").distinct(), "post_id", "left_semi").groupBy("post_id").agg(F.count("*").alias("c"))
    totals = m.agg(
        F.count("*").alias("distinct_assigned"), F.sum("c").alias("total_assignments"), F.count_if(F.col("c") > 1).alias("multi_assigned")
    )
    lone = posts.select("post_id").join(m, "post_id", "left_anti").agg(F.count("*").alias("unassigned"))
    one = F.lit(1).alias("_k")
    return totals.select("*", one).join(lone.select("*", one), "_k").drop("_k")


def count_mismatches(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Stored against actual member count of each cluster."""
    actual = members.groupBy("cluster_id").agg(F.count("*").alias("actual"))
    return clusters.join(actual, "cluster_id", "left").select(
        "cluster_id", F.col("post_count").alias("stored"), F.coalesce("actual", F.lit(0)).alias("actual")
    ).withColumn("ok", F.col("stored") == F.col("actual"))


def flatten_parents(clusters: DataFrame, members: DataFrame, vectors: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Posts that sit only in a parent cluster move to the leaf of most similar centroid within their site (``group``, columns of ``vectors``)."""
    group = group or []
    leaves = leaf_clusters(clusters).select("cluster_id")
    in_leaf = members.join(leaves, "cluster_id", "left_semi")
    stuck = members.join(leaves, "cluster_id", "left_anti").select("post_id").distinct().join(
        in_leaf.select("post_id"), "post_id", "left_anti"
    )
    placed = vectors.select(*group, "post_id", "vec")
    cents = mean_vectors(in_leaf.select("post_id", "cluster_id").join(placed, "post_id"), [*group, "cluster_id"])
    right = cents.select(*group, (-1 - F.col("cluster_id").cast("bigint")).alias("post_id"), "vec")
    best = top_matches(stuck.join(placed, "post_id"), right, 1, group)
    return best.select("post_id", (-1 - F.col("neighbour_id")).alias("cluster_id"), "similarity")
