"""2-D map positions by a neighbour-graph layout, for all sites in one plan.

Each post is tied to its nearest posts of the site, weighted by a scale of its
own. A few steps of a random walk over that graph give the start (its slowest
directions, made orthogonal per site); then rounds of attraction along the
edges and of repulsion from posts drawn by a hash move the posts. Edges lie
packed in one piece per pair of blocks of posts and stay in their partitions; a
round sends the places of the blocks to their pieces and adds up what comes of
them. Vectors are read once, for the neighbours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scale import distributed_rank, durable, written
from .vectors import top_neighbours

# fixed values: neighbours of the map and the share of the way to the cluster's centre
NEIGHBOURS = 15
PULL = 0.15
WALKS = 8  # steps of the start
ROUNDS = 24  # steps of the layout
DRAWN = 5  # posts that push a post away in each step
KEY = ["site_id", "post_id"]
SIDE = 65536  # posts of a block …
MOST = 128  # … until a site has so many


def neighbour_graph(df: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(site_id, post_id, other, w): edges in both directions; the nearest post has weight 1, others fall off at the post's own scale."""
    near = top_neighbours(df, k, ["site_id"]).select(F.col("site_id").cast(df.schema["site_id"].dataType), "post_id", F.col("neighbour_id").alias("other"), (1 - F.col("similarity")).alias("d"))
    scale = near.groupBy(*KEY).agg(F.min("d").alias("least"), F.greatest(F.avg("d") - F.min("d"), F.lit(1e-6)).alias("scale"))
    one = near.join(scale, KEY).select(*KEY, "other", F.exp(-(F.col("d") - F.col("least")) / F.col("scale")).alias("w"))
    both = one.unionByName(one.select("site_id", F.col("other").alias("post_id"), F.col("post_id").alias("other"), "w"))
    # near from either side: a + b - ab
    return both.groupBy(*KEY, "other").agg((F.sum("w") - F.when(F.count("*") > 1, F.min("w") * F.max("w")).otherwise(F.lit(0.0))).alias("w"))


def _drawn(seed: int) -> Column:
    return F.pmod(F.xxhash64("post_id", F.lit(seed)), F.lit(1 << 20)) / float(1 << 19) - 1


def _blocks(graph: DataFrame, ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packs a site's posts into blocks of near ``SIDE`` and its edges into one piece per pair of blocks.

    ranked(site_id, post_id, rank, n, degree, x, y) → places(site_id, _b, _of, n, h, degree, x, y), pieces(site_id, _b, _o, i, j, w):
    one row each, numbers as bytes. Pieces keep their partitions, so rounds move places only.
    """
    of = F.least(F.ceil(F.col("n") / SIDE), F.lit(MOST)).cast("int")
    size = F.ceil(F.col("n") / of).cast("int")
    ranked = ranked.withColumns({"_of": F.ceil(F.col("n") / size).cast("int"), "_b": F.floor((F.col("rank") - 1) / size).cast("int"), "i": ((F.col("rank") - 1) % size).cast("int")})
    at = written(ranked.withColumn("h", F.xxhash64("post_id")))
    site = f"site_id {at.schema['site_id'].dataType.simpleString()}"

    def places(t: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        out = t.slice(0, 1).select(["site_id", "_b", "_of", "n"])
        for name in ("h", "degree", "x", "y"):
            out = out.append_column(name, _packed(t.column(name).to_numpy()))
        return out

    def pieces(t: pa.Table) -> pa.Table:
        t = t.sort_by([("i", "ascending"), ("j", "ascending")])
        out = t.slice(0, 1).select(["site_id", "_b", "_o"])
        keep = t.filter(pc.is_valid(t.column("w")))
        for name, kind in (("i", "int32"), ("j", "int32"), ("w", "float64")):
            out = out.append_column(name, _packed(keep.column(name).to_numpy().astype(kind)))
        return out

    packed = written(at.groupBy("site_id", "_b").applyInArrow(places, f"{site}, _b int, _of int, n bigint, h binary, degree binary, x binary, y binary"))
    own = at.select("site_id", "post_id", "_b", "i")
    other = at.select("site_id", F.col("post_id").alias("other"), F.col("_b").alias("_o"), F.col("i").alias("j"))
    edges = graph.join(own, KEY).join(other, ["site_id", "other"]).select("site_id", "_b", "_o", "i", "j", "w")
    # pairs of blocks without edges still push each other
    none = packed.select("site_id", "_b", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)).alias("_o"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(None).cast("double").alias("w"))
    every = edges.unionByName(none).groupBy("site_id", "_b", "_o").applyInArrow(pieces, f"{site}, _b int, _o int, i binary, j binary, w binary")
    parts = int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed, durable(every.repartition(parts, "site_id", "_b", "_o"), layout=True)


def _packed(a: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())


def _numbers(t: pa.Table, name: str, kind: str = "float64") -> np.ndarray:
    return np.frombuffer(t.column(name)[0].as_py(), kind)


def _hashed(values: int, seed: np.ndarray) -> np.ndarray:
    """``F.xxhash64`` of one more int after what gave ``seed``."""
    p = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
    h = (seed.view(np.uint64) + p[3] + np.uint64(4)) ^ (np.array([values], np.uint64) * p[0])
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * p[1] + p[2]
    h = (h ^ (h >> np.uint64(33))) * p[1]
    h = (h ^ (h >> np.uint64(29))) * p[2]
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _limits(a: np.ndarray) -> np.ndarray:
    return np.clip(a, -4.0, 4.0)


def _step(pieces: DataFrame, places: DataFrame, move, t: int | None = None) -> DataFrame:
    """One round: pieces meet the places of both their blocks, then ``move`` takes each block's table and its sums sx, sy (pull), fx, fy (push, with a round ``t``)."""
    to = lambda mine, other, side: places.select("site_id", F.col("_b").alias(mine), F.explode(F.sequence(F.lit(0), F.col("_of") - 1)).alias(other), F.lit(side).alias("side"), "n", "_of", "h", "x", "y")
    right = to("_o", "_b", 1).withColumn("h", F.lit(None).cast("binary"))
    met = to("_b", "_o", 0).unionByName(right)
    names = ("sx", "sy", "fx", "fy")
    site = f"site_id {places.schema['site_id'].dataType.simpleString()}"

    def meet(piece: pa.Table, ends: pa.Table) -> pa.Table:
        ends = ends.sort_by("side")
        a, b = ends.slice(0, 1), ends.slice(1, 1)
        ax, ay, bx, by = (_numbers(z, c) for z in (a, b) for c in ("x", "y"))
        i, j, w = _numbers(piece, "i", "int32"), _numbers(piece, "j", "int32"), _numbers(piece, "w")
        sums = [np.bincount(i, w * z[j], len(ax)) if len(i) else np.zeros(len(ax)) for z in (bx, by)]
        if t is None:
            sums += [np.zeros(0)] * 2
        else:
            n, of, h = a.column("n")[0].as_py(), a.column("_of")[0].as_py(), _hashed(t, _numbers(a, "h", "int64"))
            size = -(-n // of)
            own, block = piece.column("_b")[0].as_py(), piece.column("_o")[0].as_py()
            fx, fy = np.zeros(len(ax)), np.zeros(len(ax))
            for s in range(DRAWN):
                rank = _hashed(s, h) % n
                rows = np.flatnonzero(rank // size == block)
                cols = rank[rows] - block * size
                if own == block:
                    rows, cols = rows[rows != cols], cols[rows != cols]
                dx, dy = bx[cols] - ax[rows], by[cols] - ay[rows]
                d2 = dx * dx + dy * dy
                push = -2 / ((0.01 + d2) * (1 + d2))
                fx[rows] += _limits(push * dx)
                fy[rows] += _limits(push * dy)
            sums += [fx, fy]
        out = piece.select(["site_id", "_b"])
        for name, z in zip(names, sums):
            out = out.append_column(name, _packed(z))
        return out

    def moved(place: pa.Table, sums: pa.Table) -> pa.Table:
        total = {c: np.sum([np.frombuffer(z.as_py()) for z in sums.column(c)], axis=0) for c in names}
        degree = _numbers(place, "degree")
        for c, z in zip("xy", move({c: _numbers(place, c) for c in "xy"}, degree, total)):
            place = place.set_column(place.column_names.index(c), c, _packed(z))
        return place

    key = ["site_id", "_b"]
    sums = pieces.groupBy(*key, "_o").cogroup(met.groupBy(*key, "_o")).applyInArrow(meet, f"{site}, _b int, sx binary, sy binary, fx binary, fy binary")
    return written(places.groupBy(*key).cogroup(sums.groupBy(*key)).applyInArrow(moved, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in places.schema)))


def _pull(sum_: np.ndarray, degree: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The weighted mean of a post's neighbours; its own place if it has none."""
    return np.where(degree > 0, sum_ / np.where(degree > 0, degree, 1), own)


def walk(pieces: DataFrame, places: DataFrame, steps: int = WALKS) -> DataFrame:
    """The two slowest directions of a lazy random walk, each centred and scaled per site."""
    half = lambda at, degree, s: [(at[c] + _pull(s[f"s{c}"], degree, at[c])) / 2 for c in "xy"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in places.schema)

    def moments(t: pa.Table) -> pa.Table:
        x, y = _numbers(t, "x"), _numbers(t, "y")
        values = dict(m=len(x), ax=x.mean(), ay=y.mean(), vx=x.var(), vy=y.var(), cov=np.mean((x - x.mean()) * (y - y.mean())))
        out = t.select(["site_id"])
        for name, v in values.items():
            out = out.append_column(name, pa.array([float(v)]))
        return out

    def scaled(t: pa.Table, sums: pa.Table) -> pa.Table:
        m, ax, ay, vx, vy, cov = (sums.column(c).to_numpy() for c in ("m", "ax", "ay", "vx", "vy", "cov"))
        mx, my = np.average(ax, weights=m), np.average(ay, weights=m)
        vx, vy, cov = np.average(vx + (ax - mx) ** 2, weights=m), np.average(vy + (ay - my) ** 2, weights=m), np.average(cov + (ax - mx) * (ay - my), weights=m)
        lean = cov / vx if vx else 0.0
        size = lambda v: max(np.sqrt(max(v, 0.0)), 1e-12)
        x, y = [np.frombuffer(z.as_py()) - mx for z in t.column("x")], [np.frombuffer(z.as_py()) - my for z in t.column("y")]
        y = [b - lean * a for a, b in zip(x, y)]
        for c, z, by in (("x", x, size(vx)), ("y", y, size(vy - lean * cov))):
            t = t.set_column(t.column_names.index(c), c, pa.array([(v / by).tobytes() for v in z], pa.binary()))
        return t

    site = f"site_id {places.schema['site_id'].dataType.simpleString()}"
    for _ in range(steps):
        step = _step(pieces, places, half)
        sums = step.groupBy("site_id", "_b").applyInArrow(moments, f"{site}, m double, ax double, ay double, vx double, vy double, cov double")
        # a block meets the moments of all blocks of its site: six numbers each
        every = sums.join(step.select("site_id", F.col("_b").alias("_to")), "site_id").withColumnRenamed("_to", "_b")
        places = written(step.groupBy("site_id", "_b").cogroup(every.groupBy("site_id", "_b")).applyInArrow(scaled, schema))
    return places


def layout(pieces: DataFrame, places: DataFrame, rounds: int = ROUNDS, start: float = 10.0) -> DataFrame:
    """Each step takes a post towards the weighted mean of its neighbours and away from ``DRAWN`` posts of the site; steps shrink. ``start`` scales the first places."""

    def move(step: float):
        return lambda at, degree, s: [at[c] + step * _limits(_limits(_pull(s[f"s{c}"], degree, at[c]) - at[c]) + s[f"f{c}"]) for c in "xy"]

    def wide(t: pa.Table) -> pa.Table:
        for c in "xy":
            t = t.set_column(t.column_names.index(c), c, _packed(start * _numbers(t, c)))
        return t

    places = places.groupBy("site_id", "_b").applyInArrow(wide, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in places.schema))
    for t in range(rounds):
        places = _step(pieces, written(places) if not t else places, move(1 - t / rounds), t)
    return places


def map_positions(df: DataFrame, pull: float = PULL, k: int = NEIGHBOURS, rounds: int = ROUNDS) -> DataFrame:
    """(site_id, post_id, vec, cluster_id) → (site_id, post_id, cluster_id, x, y), each post drawn to its cluster's centre by ``pull``.

    A post without neighbours stays where its id puts it. The result depends on
    the rows only, not on their order or partitions, up to rounding.
    """
    graph = written(neighbour_graph(df.select(*KEY, "vec"), k))
    degree = graph.groupBy(*KEY).agg(F.sum("w").alias("degree"))
    ranked = written(distributed_rank(df.select(*KEY, "cluster_id"), ["site_id"], [F.col("post_id")], "rank", "n"))
    degrees = ranked.join(degree, KEY, "left").select(*KEY, "rank", "n", F.coalesce("degree", F.lit(0.0)).alias("degree"), _drawn(1).alias("x"), _drawn(2).alias("y"))
    places, pieces = _blocks(graph, degrees)
    last = layout(pieces, walk(pieces, places), rounds)
    site = f"site_id {places.schema['site_id'].dataType.simpleString()}"

    def rows(t: pa.Table) -> pa.Table:
        x, y, n, of, b = _numbers(t, "x"), _numbers(t, "y"), *(t.column(c)[0].as_py() for c in ("n", "_of", "_b"))
        rank = pa.array(b * -(-n // of) + 1 + np.arange(len(x)), pa.int64())
        sites = pa.chunked_array([pa.array([t.column("site_id")[0].as_py()] * len(x), t.schema.field("site_id").type)])
        return pa.table({"site_id": sites, "rank": rank, "x": pa.array(x), "y": pa.array(y)})

    found = last.groupBy("site_id", "_b").applyInArrow(rows, f"{site}, rank bigint, x double, y double")
    return draw_together(ranked.join(found, ["site_id", "rank"]), pull).select(*KEY, "cluster_id", "x", "y")


def draw_together(places: DataFrame, pull: float = PULL) -> DataFrame:
    """Each post moves by ``pull`` of the way to its cluster's centre within the site; posts without a cluster stay."""
    key = ["site_id", "cluster_id"]
    centre = places.filter("cluster_id IS NOT NULL").groupBy(*key).agg(F.avg("x").alias("_cx"), F.avg("y").alias("_cy"))
    to = lambda c: F.col(c) + pull * F.coalesce(F.col(f"_c{c}") - F.col(c), F.lit(0.0))
    return places.join(centre, key, "left").withColumns({"x": to("x"), "y": to("y")}).drop("_cx", "_cy")
