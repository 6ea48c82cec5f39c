"""File readers: sitemaps, feeds, CMS exports and daily metric files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import cms_posts
from ..plans.scale import written


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """URL list of sitemap files, split by element so one file can feed many tasks."""
    return (
        spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
        .select(F.trim("loc").alias("url"), "lastmod").filter("url <> ''")
    )


def read_sitemap_tree(spark: SparkSession, folder: str, fetched: DataFrame, start: list[str], depth: int | None = None) -> DataFrame:
    """(url, lastmod, sitemap) of every sitemap that the start URLs lead to through index files, to any depth.

    ``folder`` holds the fetched files, plain or compressed; fetched(url, file)
    says where each URL lies, with ``file`` as Spark names it in
    ``_metadata.file_path``. Index files are followed round by round as a
    join of the last round's files with the links between files, leaving out
    those seen before, so loops end; ``depth`` bounds the rounds. An index
    gives no URLs of its own. Files that were not fetched or can't be parsed
    give none either; a URL in two sitemaps comes once for each.
    """

    def local(file: Column) -> Column:
        return F.regexp_replace(file, "^file:/+", "/")  # the same local file may be named with one slash or three

    def elements(tag: str, schema: str) -> DataFrame:
        rows = spark.read.format("xml").option("rowTag", tag).option("recursiveFileLookup", True).schema(schema).load(folder)
        return rows.select(F.trim("loc").alias("loc"), *rows.columns[1:], local(F.col("_metadata.file_path")).alias("file")).filter("loc <> ''")

    files = fetched.select("url", local(F.col("file")).alias("file")).distinct()
    named = elements("sitemap", "loc string")
    links = written(named.join(files.withColumnRenamed("file", "to"), F.col("loc") == F.col("url")).select("file", "to").distinct())
    seen = reached = written(files.filter(F.col("url").isin(start)).select("file").distinct())
    rounds = 0
    while not reached.isEmpty() and (depth is None or rounds < depth):
        reached = written(links.join(reached, "file").select(F.col("to").alias("file")).distinct().join(seen, "file", "left_anti"))
        seen, rounds = seen.unionByName(reached), rounds + 1
    leaves = seen.join(named.select("file").distinct(), "file", "left_anti")
    urls = elements("url", "loc string, lastmod string").join(leaves, "file")
    return urls.join(files.withColumnRenamed("url", "sitemap"), "file").select(F.col("loc").alias("url"), "lastmod", "sitemap")


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.format("xml").option("rowTag", "item").schema("link string, title string").load(path)
        .select(F.trim("link").alias("url"), "title").filter("url <> ''")
    )


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Alternate link of each entry, else its first link."""
    entries = (
        spark.read.format("xml").option("rowTag", "entry")
        .schema("title string, link array<struct<_href:string,_rel:string>>").load(path)
    )
    alt = F.try_element_at(F.filter("link", lambda x: x["_rel"] == "alternate"), F.lit(1))
    first = F.try_element_at("link", F.lit(1))
    return entries.select(F.trim(F.coalesce(alt["_href"], first["_href"])).alias("url"), "title").filter("url <> ''")


def read_cms(spark: SparkSession, path: str) -> DataFrame:
    """One JSON post per line."""
    return cms_posts(spark.read.text(path).withColumnRenamed("value", "json"))

