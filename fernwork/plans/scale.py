"""Execution helpers that keep plans safe on skewed, very large inputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split hot join partitions even when the split costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # let row_number() <= k drop rows ahead of the shuffle for every k in use
    "spark.sql.optimizer.windowGroupLimitThreshold": "2000",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator relies on.

    No operator forces a broadcast: AQE turns a shuffle join into a broadcast
    join only after it has measured the built side at run time, and splits hot
    partitions of the joins that stay shuffled.
    """
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)
    return spark


def session(app: str = "fernwork", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, a temporary folder serves a local master; on a cluster
    other machines could not see that folder, so the call fails there.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="spark-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame, layout: bool = False) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that survives executor loss.

    The folder is that of ``shared_folder``. With ``layout`` the result
    keeps the hash partitioning it was written with, so that later joins on
    those keys do not shuffle it again; that needs a fixed (non-adaptive) plan.
    """
    spark = df.sparkSession
    shared_folder(spark)
    if not layout:
        return df.checkpoint(eager=True)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # a new frame is planned under the setting of the moment
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def written(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder, read again.

    Like ``durable``, but nothing of the old plan stays: loops of joins keep
    plans of one size, and the size of the table is known to the planner.
    """
    path = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition an input that has fewer splits than the cluster has cores.

    A table of many files keeps its own splits and is not shuffled; a single
    small file would otherwise run its text work on one core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def top_per_group(df: DataFrame, keys: list, order: list, k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows of each group.

    ``row_number() <= k`` is planned with a WindowGroupLimit ahead of the
    shuffle, so a hot group sends at most k rows from each map task.
    """
    name = rank or "_rn"
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return top_per_group(df, keys, order, 1)


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Interpolated percentiles from a value → frequency table.

    The first aggregate combines map-side, so the second one only sees the
    distinct values of a group, never its rows. Use on integers or on values
    rounded to a fixed number of decimals.
    """
    freq = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    aggs = [F.percentile(F.col(value), F.lit(p), F.col("_n")).alias(a) for a, p in probs.items()]
    return freq.groupBy(*keys).agg(*aggs)


def upper_median(df: DataFrame, keys: list[str], value: str, alias: str) -> DataFrame:
    """Element n // 2 of each sorted group, through a value → frequency table."""
    freq = durable(df.groupBy(*keys, value).agg(F.count("*").alias("_n")))  # read twice
    run = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    tot = freq.groupBy(*keys).agg(F.sum("_n").alias("_tot"))
    cum = freq.withColumn("_cum", F.sum("_n").over(run)).join(tot, keys)
    return (
        cum.filter(F.col("_cum") > F.floor(F.col("_tot") / 2))
        .groupBy(*keys)
        .agg(F.min(value).alias(alias))
    )


def distributed_rank(df: DataFrame, keys: list[str], order: list[Column], rank: str, size: str) -> DataFrame:
    """Exact row number and row count per group without one task per group.

    Rows are range-partitioned on (keys, order); each slice numbers its own
    rows and adds the row counts of the slices before it, so a group that
    holds most of the table is still spread over many tasks. ``order`` must be
    a total order.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(k) for k in keys]
    part = durable(
        df.repartitionByRange(n, *cols, *order)
        .sortWithinPartitions(*cols, *order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    # one row per (group, slice): bounded by groups + slices
    heads = part.groupBy(*keys, "_pid").agg(F.count("*").alias("_cnt"), F.min("_pos").alias("_first"))
    run = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("_before", F.coalesce(F.sum("_cnt").over(run), F.lit(0)))
    sizes = heads.groupBy(*keys).agg(F.sum("_cnt").alias(size))
    return (
        part.join(heads.select(*keys, "_pid", "_first", "_before"), [*keys, "_pid"])
        .join(sizes, keys)
        .withColumn(rank, (F.col("_pos") - F.col("_first") + F.col("_before") + 1).cast("long"))
        .drop("_pid", "_pos", "_first", "_before")
    )
