"""Shared helpers: shared-folder tables, byte words, Arrow iteration."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernwork.plans.scale import shared_folder

#: ASCII upper case to lower case; everything but digits, letters and non-ASCII bytes to a space.
ITEM_BYTES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared checkpoint folder.

    Cuts the lineage: the files survive lost executors, are computed once and
    can be read column by column.
    """
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def binary_texts(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    return batch.column(column).cast(pa.large_binary() if pa.types.is_large_string(batch.column(column).type) else pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each hold about ``limit`` bytes: very long texts then don't meet in memory."""
    for batch in batches:
        total, start = 0, 0
        lengths = pc.binary_length(batch.column(column)).to_pylist()
        for i, n in enumerate(lengths):
            total += n or 0
            if total >= limit:
                yield batch.slice(start, i + 1 - start)
                total, start = 0, i + 1
        if start < len(lengths):
            yield batch.slice(start)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where ``use`` has it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def n_words(text: Column) -> Column:
    """Number of runs of characters other than space and \\t \\n \\v \\f \\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ordinal(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Row number from 0 in a total order, without one task for all rows.

    Range partitions number their own rows and add the sizes of those before
    them; that list has one row per partition. Window functions over it and
    the join with it stay small whatever the input.
    """
    pid, pos = fresh(df, "_pid"), fresh(df, "_pos")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = saved(
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn(pid, F.spark_partition_id())
        .withColumn(pos, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    before = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    heads = part.groupBy(pid).agg(F.count("*").alias("_n")).select(pid, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return part.join(heads, pid).withColumn(name, F.col(pos) + F.col("_before")).drop(pid, pos, "_before")
