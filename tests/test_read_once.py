"""Jobs over pages read texts and markup once, however many of their parts look at them."""

from pyspark.sql import functions as F

from fernwork.operators import health, problems, recommend
from fernwork.plans import catalog_health, catalog_problems
from fernwork.plans.tables import AS_OF, Tables

DATA = "/root/testdata/sf0.001"


def watched(df, column):
    """The rows with a counter of how often ``column`` of a row was read."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def read(x):
        seen.add(1)
        return x

    look = F.udf(read, df.schema[column].dataType).asNondeterministic()
    return df.withColumn(column, look(column)), seen


def test_health_job_reads_markup_once(spark):
    t = Tables(spark, DATA)
    posts = t.posts.withColumns({"reading_ease": F.lit(50.0), "og": F.lit(False), "jsonld": F.lit(False), "canonical": F.lit(False)}).localCheckpoint()
    ai = t.scores.select("post_id", "ai_citability_score", "eeat_score", "schema_score", "extraction_score")
    rest = (t.post_clusters, t.ga4, t.gsc, t.links, t.pairs, ai, AS_OF, catalog_health.UNIT)
    plain = health.health_job(posts, *rest).sort("post_id").collect()
    pages, seen = watched(posts, "body_html")
    assert health.health_job(pages, *rest).sort("post_id").collect() == plain and plain
    assert seen.value == posts.count()


def test_recommendations_read_markup_once(spark):
    t = Tables(spark, DATA)
    posts = catalog_problems.hposts(t).withColumn("reading_ease", F.lit(40.0)).localCheckpoint()
    pages, seen = watched(posts, "body_html")
    scan = problems.scan(pages)
    found = problems.detect_all(catalog_problems.parts(t, scan), catalog_problems.known(t), AS_OF)
    rows = recommend.aggregate_site_wide(recommend.expand_templates(found, scan, t.post_clusters), scan).collect()
    assert rows and seen.value == posts.count()


def test_site_wide_rows_come_from_one_run(spark):
    recs = spark.range(40).selectExpr(
        "id AS post_id", "'a' AS site_id", "'thin_content' AS problem_type", "'high' AS severity", "'expand' AS rec_type", "'high' AS priority",
        "1.0D AS effort", "concat('t', id) AS title", "'high' AS confidence",
    )
    rows, seen = watched(recs, "title")
    out = recommend.aggregate_site_wide(rows, recs.selectExpr("post_id", "site_id", "500 AS word_count"))
    assert out.count() == recommend.PER_TYPE + 1
    assert seen.value == 40
