"""Subtree totals by parallel tree contraction.

A round compresses every chain of nodes with one child into an edge and then
rakes the leaves into their parents, so the number of leaves at least halves
and the rounds are logarithmic in the size of the tree, not in its depth.
Afterwards the rounds are undone in reverse: each compressed node gets its
total from the node at the end of its chain.

A chain is compressed in two steps: window sums over blocks of a path (``path``
and ``level`` say where nodes are likely to follow each other; a poor hint costs
time only), then pointer doubling over what is left, in joins of unique keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

BLOCK = 1024


def chains(unary: DataFrame, n: int, block: int) -> DataFrame:
    """(id, to, s0, …): for each node with one child, the node at the end of its chain and what the chain adds to that one's total.

    ``unary`` has id, child, path, level and s0, …: its own values and those of the edge below.
    """
    piece = [F.col("path"), F.floor(F.col("level") / block)]
    down = Window.partitionBy(*piece).orderBy(F.desc("level"), "id")
    cut = ~F.lag("id").over(down).eqNullSafe(F.col("child"))
    runs = unary.withColumn("cut", cut.cast("int")).withColumn("run", F.sum("cut").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    along = Window.partitionBy(*piece, "run").orderBy(F.desc("level"), "id").rowsBetween(Window.unboundedPreceding, 0)
    found = saved(runs.select("id", F.first("child").over(along).alias("to"), *[F.sum(f"s{i}").over(along).alias(f"s{i}") for i in range(n)]))
    while True:
        ahead = found.select(F.col("id").alias("to"), F.col("to").alias("next"), *[F.col(f"s{i}").alias(f"t{i}") for i in range(n)])
        joined = found.join(ahead, "to", "left")
        found = saved(
            joined.select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved"), *[(F.col(f"s{i}") + F.coalesce(f"t{i}", F.lit(0))).alias(f"s{i}") for i in range(n)])
        )
        moved = not found.filter("moved").isEmpty()
        found = found.drop("moved")
        if not moved:
            return found


def subtree_totals(nodes: DataFrame, values: list[str], block: int = BLOCK) -> DataFrame:
    """(id, values): for each node the sums over its subtree, itself included.

    ``nodes`` has id (unique, not null), parent, path, level and the values, of
    type long. They must form a forest; a node whose parent is null or missing
    is a root. No nodes give no rows.
    """
    n = len(values)
    own, edge, s = ([f"{k}{i}" for i in range(n)] for k in ("own", "edge", "s"))
    active = saved(nodes.select("id", "parent", "path", "level", *[F.col(v).cast("long").alias(o) for v, o in zip(values, own)], *[F.lit(0).cast("long").alias(e) for e in edge]))
    raked, compressed = [], []
    while not active.isEmpty():
        kids = active.filter("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("kids"), F.min("id").alias("child"))
        state = saved(active.join(kids.withColumnRenamed("parent", "id"), "id", "left"))
        # compress
        below = state.select(F.col("id").alias("child"), *[F.col(e).alias(f"below_{e}") for e in edge])
        unary = state.filter("kids = 1").join(below, "child")
        found = chains(unary.select("id", "child", "path", "level", *[(F.col(o) + F.col(f"below_{e}")).alias(k) for o, e, k in zip(own, edge, s)]), n, block)
        compressed.append(found)
        tops = state.filter("kids = 1").join(found.select(F.col("id").alias("parent")), "parent", "left_anti")
        tops = tops.join(found, "id").select(F.col("to").alias("id"), F.col("parent").alias("above"), F.lit(True).alias("top"), *[(F.col(e) + F.col(k)).alias(f"new_{e}") for e, k in zip(edge, s)])
        kept = saved(
            state.filter("kids IS NULL OR kids > 1").join(tops, "id", "left").select(
                "id", F.when(F.col("top"), F.col("above")).otherwise(F.col("parent")).alias("parent"), "path", "level", F.col("kids").isNull().alias("leaf"), *own,
                *[F.coalesce(f"new_{e}", e).alias(e) for e in edge],
            )
        )
        # rake
        leaves = kept.filter("leaf")
        raked.append(leaves.select("id", *own))
        sums = leaves.groupBy("parent").agg(*[F.sum(F.col(o) + F.col(e)).alias(f"more_{o}") for o, e in zip(own, edge)]).withColumnRenamed("parent", "id")
        active = saved(kept.filter("NOT leaf").join(sums, "id", "left").select("id", "parent", "path", "level", *[(F.col(o) + F.coalesce(f"more_{o}", F.lit(0))).alias(o) for o in own], *edge))
    totals = active.select("id", *own)
    for part in raked:
        totals = totals.unionByName(part)
    for found in reversed(compressed):
        ends = totals.select(F.col("id").alias("to"), *own)
        totals = totals.unionByName(saved(found.join(ends, "to").select("id", *[(F.col(o) + F.col(k)).alias(o) for o, k in zip(own, s)])))
    return totals.select("id", *[F.col(o).alias(v) for o, v in zip(own, values)])
