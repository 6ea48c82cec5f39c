"""Maps the star-schema, document, page and event tables onto the site model.

Each property is one logical table (posts, metrics, links, embeddings …); the
matching DuckDB text lives in ``plans.oracle``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from .scale import spread, tune

AS_OF = "2024-01-31"  # the day after the last event


def at_site(df: DataFrame, by: str = "post_id") -> DataFrame:
    """The rows dealt to five sites by an id."""
    return df.withColumn("site_id", (F.col(by) % 5).cast("bigint"))


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def pages(self) -> DataFrame:
        return spread(self.raw("pages"), "page_id")

    @cached_property
    def posts(self) -> DataFrame:
        """Documents as posts; short lines act as h2 headings, others as paragraphs."""
        d = spread(self.raw("documents"), "doc_id")
        day = F.col("doc_id") * 37 % 1200
        publish = F.date_sub(F.lit(AS_OF).cast("date"), day.cast("int"))
        title = F.regexp_extract("text", r"^[^.\n]*", 0)
        lines = F.split("text", "\n")
        # one to six words; a long line is left after its seventh
        short = lambda x: x.rlike(r"\A\s*+\S++(?:\s++\S++){0,5}+\s*+\z")
        return d.select(
            F.col("doc_id").alias("post_id"),
            F.col("source").alias("site_id"),
            F.concat(
                F.lit("https://"), "source", F.lit(".example.com/blog/"),
                F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), F.lit("-"), F.col("doc_id").cast("string"),
            ).alias("url"),
            title.alias("title"),
            F.col("text").alias("body_text"),
            F.array_join(
                F.transform(
                    lines,
                    lambda x: F.when(short(x), F.concat(F.lit("<h2>"), x, F.lit("</h2>"))).otherwise(
                        F.concat(F.lit("<p>"), x, F.lit("</p>"))
                    ),
                ),
                "\n",
            ).alias("body_html"),
            F.transform(
                F.filter(lines, short), lambda x: F.struct(F.lit("h2").alias("level"), tx.strip(x).alias("text"))
            ).alias("headings"),
            publish.alias("publish_date"),
            F.when(F.col("doc_id") % 3 == 0, F.lit(None).cast("date"))
            .otherwise(F.least(F.lit(AS_OF).cast("date"), F.date_add(publish, (F.col("doc_id") * 13 % 400).cast("int"))))
            .alias("modified_date"),
            tx.word_count(F.col("text")).alias("word_count"),
            F.when(F.col("doc_id") % 4 == 0, F.lit(None)).otherwise(
                F.nullif(F.regexp_extract("text", r"\n([^.\n]*)", 1), F.lit(""))
            ).alias("meta_description"),
            F.col("lang").alias("language"),
            F.when(F.col("doc_id") % 17 == 0, "landing")
            .when(F.col("doc_id") % 19 == 0, "product")
            .when(F.col("doc_id") % 23 == 0, "glossary")
            .otherwise("blog").alias("page_type"),
            F.element_at(
                F.array(*[F.lit(x) for x in ["informational", "commercial", "transactional", "navigational"]]),
                (F.col("doc_id") % 4 + 1).cast("int"),
            ).alias("content_intent"),
            tx.content_hash(F.col("text")).alias("content_hash"),
        )

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.col("vec_id").alias("post_id"),
            F.col("embedding").cast("array<double>").alias("vec"),
            F.col("label").alias("cluster_id"),
        )

    @cached_property
    def post_clusters(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("post_id"), F.col("label").alias("cluster_id"))

    @cached_property
    def clusters(self) -> DataFrame:
        """One row per label; the two highest labels hang below label 0."""
        return (
            self.post_clusters.groupBy("cluster_id")
            .agg(F.count("*").alias("post_count"))
            .select(
                "cluster_id",
                F.concat(F.lit("cluster "), F.col("cluster_id").cast("string")).alias("label"),
                F.when(F.col("cluster_id") >= 8, F.lit(0)).alias("parent_cluster_id"),
                "post_count",
            )
        )

    @cached_property
    def cluster_states(self) -> DataFrame:
        """Clusters with stored state and mean health."""
        health = self.scores.groupBy("cluster_id").agg(F.round(F.avg("composite_score"), 6).alias("health_score"))
        # fixed values: cluster states
        states = F.array(*map(F.lit, ["swamp", "desert", "forest", "seedbed", "meadow"]))
        return self.clusters.join(health, "cluster_id").withColumn(
            "ecosystem_state", F.element_at(states, F.col("cluster_id") % 5 + 1)
        )

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events").select(
            "event_id", "ts", F.to_date("ts").alias("date"), "user_id", "event_type", "value",
            F.get_json_object("props", "$.k").cast("long").alias("k"),
        )

    @cached_property
    def ga4(self) -> DataFrame:
        return self.events.groupBy(F.col("k").alias("post_id"), "date").agg(
            F.count_if(F.col("event_type") == "view").alias("pageviews"),
            F.count_distinct("user_id").alias("sessions"),
            F.count_if(F.col("event_type") == "click").alias("engaged_sessions"),
            F.avg((F.col("event_type") == "error").cast("double")).alias("bounce_rate"),
            F.round(F.avg("value"), 6).alias("avg_time"),
        )

    @cached_property
    def gsc(self) -> DataFrame:
        return (
            self.events.groupBy(
                F.col("user_id").alias("post_id"), "date", F.concat(F.lit("q"), F.col("k").cast("string")).alias("query")
            )
            .agg(
                F.count("*").alias("impressions"),
                F.count_if(F.col("event_type") == "click").alias("clicks"),
                # the tiny offset keeps means of positions off exact rounding halves
                (F.round(F.least(F.lit(100.0), 1 + F.avg("value")), 6) + F.lit(1e-9)).alias("avg_position"),
            )
            .withColumn("ctr", F.col("clicks") / F.col("impressions"))
        )

    @cached_property
    def links(self) -> DataFrame:
        """Clicks are resolved internal links user → k, sign-ups are unresolved ones."""
        inner = F.col("event_type") == "click"
        return (
            self.events.filter(F.col("event_type").isin("click", "signup"))
            .select(
                F.col("user_id").alias("source_post_id"),
                F.when(inner, F.concat(F.lit("https://site.example.com/p/"), F.col("k").cast("string")))
                .otherwise(
                    F.concat(
                        F.when(F.col("k") % 2 == 0, F.lit("https://site.example.com/gone/"))
                        .otherwise(F.lit("https://partner.example.org/")),
                        F.col("k").cast("string"),
                    )
                ).alias("target_url"),
                F.when(inner, F.col("k")).alias("target_post_id"),
            )
            .distinct()
        )

    @cached_property
    def scores(self) -> DataFrame:
        """Stored score columns as the health job writes them, one row per clustered post."""
        traffic = self.events.filter(F.col("event_type") == "view").groupBy(F.col("k").alias("post_id")).agg(
            F.count("*").alias("traffic")
        )
        p = F.col("post_id")
        base = self.post_clusters.join(traffic, "post_id", "left").select(
            "post_id", "cluster_id", F.coalesce("traffic", F.lit(0)).alias("traffic"),
        )
        comp = F.round(10 + (p * 7919 % 8500) / 100, 2)
        return base.select(
            "post_id", "cluster_id", "traffic",
            comp.alias("composite_score"),
            F.round((p * 31 % 1000) / 10, 1).alias("traffic_score"),
            F.round((p * 57 % 1000) / 10, 1).alias("ranking_score"),
            F.round((p * 91 % 1000) / 10, 1).alias("freshness_score"),
            F.round((p * 113 % 1000) / 10, 1).alias("content_depth_score"),
            F.when(p % 9 == 0, F.lit(None)).otherwise((p * 17 % 101).cast("double")).alias("ai_citability_score"),
            F.when(p % 7 == 0, F.lit(None)).otherwise((p * 29 % 101).cast("double")).alias("eeat_score"),
            (p * 41 % 101).cast("double").alias("schema_score"),
            (p * 53 % 101).cast("double").alias("extraction_score"),
            F.element_at(F.array(*map(F.lit, ["growing", "stable", "declining", "dead", "unknown"])), (p % 5 + 1).cast("int")).alias("trend"),
            F.when(comp >= 80, "pillar").when(comp >= 50, "supporter").when(p % 6 == 0, "competitor")
            .when(comp >= 25, "supporter").otherwise("dead_weight").alias("role"),
            F.round((p * 7 % 1000) / 1000, 3).alias("pagerank"),
        )

    @cached_property
    def pairs(self) -> DataFrame:
        """Stored overlap pairs: every clustered post with two later posts of its cluster."""
        e = self.post_clusters
        a = e.select(F.col("post_id").alias("post_a_id"), "cluster_id")
        step = F.explode(F.array(F.lit(10), F.lit(30)))
        cand = a.withColumn("step", step).withColumn("post_b_id", F.col("post_a_id") + F.col("step"))
        b = e.select(F.col("post_id").alias("post_b_id"))
        cos = F.round(0.4 + (F.col("post_a_id") * 37 + F.col("step") * 11) % 600 / 1000, 3)
        return cand.join(b, "post_b_id").select(
            "post_a_id", "post_b_id", "cluster_id",
            cos.alias("cosine"),
            (F.col("post_a_id") * 3 % 7).alias("n_shared"),
            F.when(cos >= 0.9, "critical").when(cos >= 0.75, "high").when(cos >= 0.6, "medium").otherwise("low").alias("severity"),
            F.round(cos * 100, 1).alias("severity_score"),
            F.when(cos >= 0.9, "redirect").when(cos >= 0.75, "merge").when(cos >= 0.6, "differentiate").otherwise("monitor").alias("resolution"),
            F.when(F.col("post_a_id") % 2 == 0, F.col("post_a_id")).otherwise(F.col("post_b_id")).alias("stronger_post_id"),
            F.date_sub(F.lit(AS_OF).cast("date"), (F.col("post_a_id") % 40).cast("int")).alias("created_at"),
        )

    @cached_property
    def problems(self) -> DataFrame:
        """Stored problems: one or two types per post."""
        # fixed values: sample of problem types
        types = ["traffic_decay", "thin_content", "seo_no_meta", "orphan_page", "readability_low", "weak_eeat"]
        arr = F.array(*map(F.lit, types))
        p = self.post_clusters.select("post_id", "cluster_id")
        rows = p.withColumn("n", F.explode(F.expr("sequence(0, cast(post_id % 3 as int))"))).select(
            "post_id", "cluster_id",
            F.element_at(arr, ((F.col("post_id") + F.col("n") * 2) % 6 + 1).cast("int")).alias("problem_type"),
            "n",
        )
        return rows.select(
            "post_id", "cluster_id", "problem_type",
            F.element_at(F.array(*map(F.lit, ["low", "medium", "high", "critical"])), ((F.col("post_id") + F.col("n")) % 4 + 1).cast("int")).alias("severity"),
            F.date_sub(F.lit(AS_OF).cast("date"), (F.col("post_id") % 45).cast("int")).alias("detected_at"),
            F.when(F.col("post_id") % 5 == 0, F.date_sub(F.lit(AS_OF).cast("date"), (F.col("post_id") % 11).cast("int"))).alias("resolved_at"),
        )

    @cached_property
    def recs(self) -> DataFrame:
        """Stored recommendations derived from the problems."""
        # fixed values: recommendation types and levels
        types = ["optimize", "update", "merge", "redirect", "growth", "interlink"]
        pr = self.problems
        h = F.col("post_id") * 5 + F.length("problem_type")
        return pr.select(
            (F.col("post_id") * 100 + F.length("problem_type")).alias("rec_id"),
            "post_id", "cluster_id",
            F.element_at(F.array(*map(F.lit, types)), (h % 6 + 1).cast("int")).alias("rec_type"),
            F.element_at(F.array(*map(F.lit, ["critical", "high", "medium", "low"])), (h % 4 + 1).cast("int")).alias("priority"),
            F.element_at(F.array(*map(F.lit, ["low", "medium", "high"])), (h % 3 + 1).cast("int")).alias("effort"),
            F.concat(F.lit("Fix "), "problem_type").alias("title"),
            F.element_at(F.array(*map(F.lit, ["pending", "in_progress", "completed", "dismissed"])), (h % 4 + 1).cast("int")).alias("status"),
            F.date_sub(F.lit(AS_OF).cast("date"), (F.col("post_id") % 30).cast("int")).alias("created_at"),
            F.when(h % 4 == 2, F.date_sub(F.lit(AS_OF).cast("date"), (F.col("post_id") % 20).cast("int"))).alias("completed_at"),
        )

    @cached_property
    def history(self) -> DataFrame:
        """Daily site snapshots from the event stream (site = user_id mod 5); means are kept off rounding halves."""
        return (
            self.events.groupBy((F.col("user_id") % 5).alias("site_id"), "date")
            .agg(
                F.round(F.avg(F.least(F.col("value"), F.lit(100.0))) + 1e-7, 2).alias("score"),
                F.round(F.avg(F.when(F.col("event_type") == "view", F.least("value", F.lit(100.0)))) + 1e-7, 2).alias("traffic"),
                F.round(F.avg(F.when(F.col("event_type") == "click", F.least("value", F.lit(100.0)))) + 1e-7, 2).alias("ranking"),
                F.round(F.avg(F.when(F.col("event_type") == "purchase", F.least("value", F.lit(100.0)))) + 1e-7, 2).alias("engagement"),
                F.count("*").alias("total_posts"),
                F.count_if(F.col("event_type") == "error").alias("problems"),
            )
        )
