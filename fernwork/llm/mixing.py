"""Mixing sources to target weights by capped water-filling.

The mix holds ``total`` times the words of all documents. Each source's share
follows its weight; a share above ``epochs`` times the source's words is clamped
there and the excess is shared among the others by weight, until no share is
above its limit. A source at target / size = whole + fraction takes every
document ``whole`` times, and by a seeded order of its documents once more until
the fraction of its words is reached (the document at the border is taken if
that comes nearer). ``epochs`` may be fractional: at 1.5 half a source's words
come twice, and no document more than twice.

The seeded order is that of md5(seed:id). The place where the fraction ends is
found from word sums of 4096 ranges of that order per source, then of 4096
ranges within the one where it ends, so no source is ordered in one task.

Null text has size 0; a null source is a source of its own, last in order. Rows
that share an id and a source are taken alike. Empty input gives an empty mix.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, n_words, ordinal, saved, table

TOTAL, EPOCHS, WEIGHTS, SEED = 1.5, 2.0, (3.0, 1.0, 2.0), 17


def targets(sources: DataFrame, total: float, epochs: float) -> DataFrame:
    """(source, size, weight) -> the same and target; one row per source throughout.

    Each round clamps what is above its limit and shares the rest anew. Only
    two sums a round come to the driver. A round clamps a source at least, and
    in practice all that exceed the level of the round.
    """
    words = sources.agg(F.sum("size")).first()[0] or 0
    limit = F.col("size") * F.lit(float(epochs))
    state = sources.withColumn("full", F.col("size") == 0)
    budget = words * total
    while True:
        clamped, free = state.agg(F.sum(F.when(F.col("full"), limit).otherwise(0.0)), F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0.0))).first()
        level = (budget - (clamped or 0.0)) / free if free else 0.0
        above = ~F.col("full") & (F.col("weight") * F.lit(level) > limit)
        if not state.filter(above).limit(1).count():
            break
        state = saved(state.withColumn("full", F.col("full") | above))
    return state.select("source", "size", "weight", F.when(F.col("full"), limit).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def _border(ranges: DataFrame, part: str) -> DataFrame:
    """(source, quota) joined to word sums by range: the first range where the sum passes what is left, and the rest on entering it."""
    run = Window.partitionBy("source").orderBy(part)
    sums = ranges.withColumn("end", F.sum("words").over(run)).withColumn("entry", F.col("quota") - (F.col("end") - F.col("words")))
    return sums.filter((F.col("entry") >= 0) & (F.col("end") > F.col("quota")))


def repetitions(docs: DataFrame, weight_of, total: float = TOTAL, epochs: float = EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, copies) for each row of ``docs``.

    ``weight_of`` gives the weight of a source from its place in code point
    order (a column from 0, nulls last).
    """
    null = F.col("source").isNull()
    order = [null, F.col("source")]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), n_words(F.col(f"`{text_col}`")).alias("size"))
    rows = saved(rows.withColumn("at", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit(""))))))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("size"))
    sources = saved(ordinal(sizes, order, "place").select("source", "size", weight_of(F.col("place")).alias("weight")))
    plan = targets(sources, total, epochs)
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0)
    plan = saved(plan.withColumn("whole", F.floor(rate)).withColumn("quota", F.col("target") - F.col("whole") * F.col("size")).withColumnRenamed("size", "source_size"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    first, second = F.substring("at", 1, 3), F.substring("at", 4, 3)

    # where the fraction ends, in two steps of 4096 ranges
    coarse = saved(rows.groupBy("source", first.alias("p1")).agg(F.sum("size").alias("words")))
    edge1 = saved(_border(coarse.join(plan.select(F.col("source").alias("s"), "quota"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "p1").select(F.col("source").alias("s1"), F.col("p1").alias("e1"), F.col("entry").alias("q1")))
    inside = rows.join(edge1, F.col("source").eqNullSafe(F.col("s1")) & (first == F.col("e1")))
    fine = inside.groupBy("source", second.alias("p2")).agg(F.sum("size").alias("words"), F.first("q1").alias("quota"))
    edge2 = saved(_border(fine, "p2").select(F.col("source").alias("s2"), F.col("p2").alias("e2"), F.col("entry").alias("q2")))
    # the last ranges: a 16-millionth of a source each
    run = Window.partitionBy("source").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    last = inside.join(edge2, F.col("source").eqNullSafe(F.col("s2")) & (second == F.col("e2")))
    last = last.groupBy("source", "at").agg(F.sum("size").alias("words"), F.first("q2").alias("q2")).withColumn("end", F.sum("words").over(run))
    taken = last.filter(F.col("end") - F.col("words") / 2 <= F.col("q2")).groupBy("source").agg(F.max("at").alias("to"))

    limits = plan.join(edge1, F.col("source").eqNullSafe(F.col("s1")), "left").join(edge2, F.col("source").eqNullSafe(F.col("s2")), "left")
    limits = limits.join(taken.withColumnRenamed("source", "s3"), F.col("source").eqNullSafe(F.col("s3")), "left")
    stop = F.coalesce("to", F.concat("e1", "e2"), "e1")
    limits = saved(limits.select(F.col("source").alias("s"), "source_size", "target", "whole", F.when(F.col("quota") <= 0, "").otherwise(F.coalesce(stop, F.lit("g"))).alias("stop")))
    extra = (F.col("at") <= F.col("stop")).cast("int")
    copies = F.when(F.col("size") == 0, F.col("whole")).otherwise(F.least(F.col("whole") + extra, F.lit(ceil(epochs)))).cast("int")
    joined = rows.join(limits, F.col("source").eqNullSafe(F.col("s")))
    return joined.select("id", "source", "size", "source_size", "target", copies.alias("copies"))


def cycle(weights: tuple[float, ...]):
    """Weights that repeat along the order of the sources."""

    def of(place: Column) -> Column:
        return F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))).cast("int"))

    return of


def mix(docs: DataFrame, weight_of=None, id_col: str = "doc_id", copy_col: str = "copy", **options) -> DataFrame:
    """The mixed rows: each row of ``docs`` as often as it is taken, numbered from 1 in ``copy_col``."""
    weight_of = weight_of or cycle(WEIGHTS)
    source_col = options.get("source_col", "source")
    plan = repetitions(docs, weight_of, id_col=id_col, **options).filter("copies > 0").groupBy("id", "source").agg(F.max("copies").alias("copies"))
    key, src, n = fresh(docs, "_key"), fresh(docs, "_src"), fresh(docs, "_n")
    plan = plan.select(F.col("id").alias(key), F.col("source").alias(src), F.col("copies").alias(n))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(key)) & F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col(src))
    return docs.join(plan.hint("merge"), same).withColumn(copy_col, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(key, src, n)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    plan = repetitions(docs, cycle(WEIGHTS))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('17:' || coalesce(doc_id::VARCHAR, '')) AS at FROM documents
),
s AS (
  SELECT source, sum(size)::BIGINT AS size, ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w
  FROM d GROUP BY source
),
r AS (SELECT *, 2.0 * size / w AS ratio FROM s),
o AS (
  SELECT *, (SELECT sum(size) FROM s) * 1.5 AS budget,
    sum(2 * size) OVER (ORDER BY ratio, source ROWS UNBOUNDED PRECEDING) - 2 * size AS clamped,
    sum(w) OVER (ORDER BY ratio DESC, source DESC ROWS UNBOUNDED PRECEDING) AS free
  FROM r
),
v AS (SELECT max((budget - clamped)::DOUBLE / free) AS level FROM o WHERE (budget - clamped)::DOUBLE / free <= ratio),
t AS (SELECT r.source, r.size, CASE WHEN size = 0 THEN 0.0 ELSE least(2.0 * size, w * coalesce(level, 1e300)) END::DOUBLE AS target FROM r, v),
q AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE floor(target / size) END AS whole FROM t),
c AS (
  SELECT d.doc_id, d.size, q.size AS source_size, q.target, q.whole, q.target - q.whole * q.size AS quota,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.at ROWS UNBOUNDED PRECEDING) - d.size / 2.0 AS middle
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target, (size * least(2, whole + CASE WHEN quota > 0 AND middle <= quota THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
