"""Density clusters of unit vectors, for all groups in one plan.

The distance of two vectors is their Euclidean distance; the reach distance is
the largest of it and both core distances, a core distance being that to the
``samples``-th nearest other vector. A minimum spanning forest of reach
distances is built, condensed to the splits whose sides both hold ``smallest``
vectors, and the clusters of most excess of mass are kept; other vectors are
noise.

A group of up to ``DENSE`` vectors is one task's work, without its matrix: memory
grows with the vectors only. A larger one goes
through Borůvka rounds over the lists of its nearest neighbours: a component's
best listed edge counts if no unlisted one can be shorter, and a search among
the vectors of other components settles those for which that stays open, but for
the largest component of a group: the others hook onto it. Searched for are only
vectors that can have a shorter edge than the best listed one. What comes together for a group is its forest: 24 bytes a vector, no vectors.

Ties of distance are settled by the ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scale import written
from . import vectors as vx

DENSE = 16384  # vectors of a group that one task joins, in 16,384 steps of one product of a vector with those left
STRIP = 1024  # vectors whose core distances are found at once
LISTED = 16  # neighbours listed for each vector of a larger group
EDGES = "grp string, a bigint, b bigint, w double"
FLAT = 1e-6  # distances below count as this one


def forest(df: DataFrame, samples: Column) -> DataFrame:
    """(grp, a, b, w): the minimum spanning forest of (grp, post_id, vec), unit vectors; ``samples`` is a column of ``n``, the group's size."""
    sizes = written(df.groupBy("grp").agg(F.count("*").alias("n")).withColumn("samples", samples.cast("int")))
    sized = df.join(sizes, "grp")
    small = sized.filter(F.col("n") <= DENSE).select("grp", "post_id", "vec", "samples").groupBy("grp").applyInArrow(_dense, EDGES)
    if sizes.filter(F.col("n") > DENSE).isEmpty():
        return small
    return small.unionByName(_wide(written(sized.filter(F.col("n") > DENSE).select("grp", "post_id", "vec", "n", "samples"))))


def _dense(t: pa.Table) -> pa.Table:
    """Prim's steps over one group; vectors that are joined leave the arrays."""
    t = t.sort_by("post_id")
    ids, m = t.column("post_id").to_numpy().copy(), vx._matrix(t)
    n = len(ids)
    if n < 2:
        return _edges("", [], [], [])
    core = _core(m, min(t.column("samples")[0].as_py(), n - 1))
    best, origin, out = np.full(n, -np.inf), np.full(n, ids[0]), []
    i = 0
    for left in range(n - 1, 0, -1):
        x, own, reach = m[i].copy(), ids[i], core[i]
        for array in (ids, m, core, best, origin):  # the last one takes the place of the one that is joined
            array[i] = array[left]
        near = np.minimum(np.round(m[:left] @ x, 12), np.minimum(core[:left], reach))
        closer = near > best[:left]
        tied = np.flatnonzero(near == best[:left])
        if len(tied):
            closer[tied] = _less(ids[tied], own, origin[tied])
        best[:left][closer], origin[:left][closer] = near[closer], own
        top = np.flatnonzero(best[:left] == best[:left].max())
        # ties: the edge of the least ids
        a, b, i = min((min(ids[j], origin[j]), max(ids[j], origin[j]), j) for j in top)
        out.append((a, b, best[i]))
    return _edges(t.column("grp")[0].as_py(), *zip(*out))


def _core(m: np.ndarray, k: int) -> np.ndarray:
    """Similarity of each vector to its k-th nearest other one."""
    parts = []
    for i in range(0, len(m), STRIP):
        s = np.round(m[i : i + STRIP] @ m.T, 12)
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        parts.append(np.partition(s, len(m) - k, axis=1)[:, len(m) - k].copy())  # a view would hold the strip
    return np.concatenate(parts)


def _less(ids: np.ndarray, new: int, old: np.ndarray) -> np.ndarray:
    """Where the edge to ``new`` comes before that to the origin so far, by its ids."""
    low, high = np.minimum(ids, new), np.maximum(ids, new)
    low_old, high_old = np.minimum(ids, old), np.maximum(ids, old)
    return (low < low_old) | ((low == low_old) & (high < high_old))


def _edges(grp: str, a, b, similarity) -> pa.Table:
    w = np.sqrt(np.maximum(0.0, 2 - 2 * np.array(similarity, float)))
    return pa.table({"grp": pa.array([grp] * len(a), pa.string()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "w": pa.array(w)})


def _wide(df: DataFrame) -> DataFrame:
    """Borůvka rounds over all large groups at once."""
    vectors = df.select("grp", "post_id", "vec")
    listed = written(vx.top_neighbours(vectors, LISTED, ["grp"]).withColumn("s", F.round("similarity", 12)))
    want = F.least(F.col("samples"), F.col("n") - 1)
    core = df.select("grp", "post_id", want.alias("rank")).join(listed, ["grp", "post_id", "rank"]).select("grp", "post_id", F.col("s").alias("cap"))
    last = listed.filter(F.col("rank") == LISTED).select("grp", "post_id", F.col("s").alias("last"))
    nodes = written(vectors.join(core, ["grp", "post_id"]).join(last, ["grp", "post_id"], "left"))
    cap = lambda name: nodes.select("grp", F.col("post_id").alias(name), F.col("cap").alias(f"cap_{name}"))
    pairs = listed.select("grp", F.least("post_id", "neighbour_id").alias("a"), F.greatest("post_id", "neighbour_id").alias("b"), "s").groupBy("grp", "a", "b").agg(F.max("s").alias("s"))
    edges = written(pairs.join(cap("a"), ["grp", "a"]).join(cap("b"), ["grp", "b"]).select("grp", "a", "b", F.least("s", "cap_a", "cap_b").alias("s"), F.col("a").alias("ca"), F.col("b").alias("cb")))
    labels = nodes.select("grp", "post_id", F.col("post_id").alias("comp"))
    # what an edge that isn't listed can reach at most
    bound = nodes.select("grp", F.col("post_id").alias("comp"), F.coalesce(F.least("cap", "last"), F.lit(-2.0)).alias("most"))
    found, exact = [], None
    while True:
        both = edges.unionByName(edges.select("grp", "a", "b", "s", F.col("cb").alias("ca"), F.col("ca").alias("cb")))
        best = both.groupBy("grp", F.col("ca").alias("comp")).agg(F.min(F.struct((-F.col("s")).alias("far"), "a", "b", "cb")).alias("best"))
        heads = bound.join(best, ["grp", "comp"])
        if exact is not None:  # components whose best edge has just been searched for among all vectors
            heads = heads.join(exact.withColumn("settled", F.lit(True)), ["grp", "comp"], "left").withColumn("most", F.when(F.col("settled"), F.lit(-2.0)).otherwise(F.col("most")))
        picks = written(heads.filter(-F.col("best.far") >= F.col("most")).select("grp", "comp", F.col("best.a").alias("a"), F.col("best.b").alias("b"), (-F.col("best.far")).alias("s"), F.col("best.cb").alias("to")))
        if picks.isEmpty():
            counts = bound.groupBy("grp").agg(F.count("*").alias("c")).filter("c > 1").select("grp")
            open_ = written(labels.join(counts, "grp"))
            if open_.isEmpty():
                break
            exact = written(_lesser(open_))
            known = written(best.select("grp", "comp", (-F.col("best.far")).alias("known")))
            more = _foreign(nodes.join(open_, ["grp", "post_id"]), exact, known)
            edges = written(edges.unionByName(more.drop("comp")).groupBy("grp", "a", "b", "ca", "cb").agg(F.max("s").alias("s")).select("grp", "a", "b", "s", "ca", "cb"))
            continue
        exact = None
        found.append(picks.select("grp", "a", "b", "s").distinct())
        roots = _roots(picks)
        merged = lambda x, key: x.join(roots.withColumnRenamed("comp", key), ["grp", key], "left").withColumn(key, F.coalesce("root", key)).drop("root")
        edges = written(merged(merged(edges, "ca"), "cb").filter("ca <> cb"))
        labels = written(merged(labels, "comp"))
        bound = written(merged(bound, "comp").groupBy("grp", "comp").agg(F.max("most").alias("most")))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.distinct().select("grp", "a", "b", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("s"))).alias("w"))


def _lesser(labels: DataFrame) -> DataFrame:
    """(grp, comp) of all components but the largest one of each group."""
    sizes = labels.groupBy("grp", "comp").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("grp").agg(F.max_by("comp", F.struct("m", "comp")).alias("comp"))
    return sizes.join(largest, ["grp", "comp"], "left_anti").select("grp", "comp")


def _foreign(points: DataFrame, searched: DataFrame, known: DataFrame) -> DataFrame:
    """The edge of least reach distance from each ``searched`` component to another one, by a search over all vectors of its group.

    ``known`` (grp, comp, known) has the best listed edge: a vector takes part
    if an edge that isn't listed can reach it. Components that gain nothing have no row.
    """
    most = F.coalesce(F.least("cap", "last"), F.lit(-2.0))
    # ties by the ids need the edges that equal the known one too
    able = points.join(searched, ["grp", "comp"]).join(known, ["grp", "comp"], "left").filter(F.col("known").isNull() | (most >= F.col("known"))).drop("known")
    near = vx.top_matches(able, points, 1, ["grp"], apart="comp", cap="cap")
    of = lambda name, comp: points.select("grp", F.col("post_id").alias(name), F.col("comp").alias(comp))
    best = near.join(of("post_id", "comp"), ["grp", "post_id"]).groupBy("grp", "comp").agg(
        F.min(F.struct((-F.round("similarity", 12)).alias("far"), F.least("post_id", "neighbour_id").alias("a"), F.greatest("post_id", "neighbour_id").alias("b"))).alias("e")
    )
    rows = best.select("grp", "comp", F.col("e.a").alias("a"), F.col("e.b").alias("b"), (-F.col("e.far")).alias("s"))
    return rows.join(of("a", "ca"), ["grp", "a"]).join(of("b", "cb"), ["grp", "b"])


def _roots(picks: DataFrame) -> DataFrame:
    """(grp, comp, root) of components that each hook onto another one: pointer doubling, the lesser of a mutual pair being the root."""
    back = picks.select("grp", F.col("comp").alias("to"), F.col("to").alias("back"))
    first = picks.join(back, ["grp", "to"], "left")
    up = written(first.select("grp", "comp", F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("to")), F.col("comp")).otherwise(F.col("to")).alias("root")))
    while True:
        above = up.select("grp", F.col("comp").alias("root"), F.col("root").alias("next"))
        step = written(up.join(above, ["grp", "root"], "left").select("grp", "comp", F.coalesce("next", "root").alias("next"), "root"))
        up = step.select("grp", "comp", F.col("next").alias("root"))
        if step.filter("next <> root").isEmpty():
            return up


def condense(a: np.ndarray, b: np.ndarray, w: np.ndarray, smallest: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, labels) of one group's spanning tree: the least id of the cluster, -1 for noise."""
    order = np.lexsort((b, a, w))
    ids, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    n, m = len(ids), len(a)
    ends = ends.reshape(2, m)[:, order].T.tolist()
    level = 1 / np.maximum(w[order], FLAT)
    # merges from the shortest edge on: node n + i joins two nodes
    parent, node, size = list(range(n)), list(range(n)), [1] * (n + m)
    sides = []
    for i, (x, y) in enumerate(ends):
        roots = []
        for v in (x, y):
            while parent[v] != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            roots.append(v)
        p, q = (node[r] for r in roots)
        sides.append((p, q))
        size[n + i] = size[p] + size[q]
        low, high = sorted(roots, key=lambda r: size[node[r]])
        parent[low] = high
        node[high] = n + i
    # leaves below a node stand together in one order
    start = [0] * (n + m)
    for i in reversed(range(m)):
        p, q = sides[i]
        start[p], start[q] = start[n + i], start[n + i] + size[p]
    place = np.empty(n, int)
    place[np.array(start[:n])] = np.arange(n)
    # from the root down: clusters, their births and what their vectors add until they leave
    births, above, mass, spans = [0.0], [-1], [0.0], [(0, n)]
    at = {n + m - 1: 0}
    for i in reversed(range(m)):
        cluster = at.pop(n + i, None)
        if cluster is None:
            continue
        p, q = sides[i]
        if min(size[p], size[q]) >= smallest:
            for side in (p, q):
                mass[cluster] += size[side] * (level[i] - births[cluster])
                at[side] = len(births)
                births.append(level[i])
                above.append(cluster)
                mass.append(0.0)
                spans.append((start[side], start[side] + size[side]))
            continue
        for side in (p, q):
            if size[side] >= smallest:
                at[side] = cluster
            else:
                mass[cluster] += size[side] * (level[i] - births[cluster])
    below = [0.0] * len(births)
    chosen = [False] * len(births)
    for c in reversed(range(1, len(births))):
        chosen[c] = mass[c] >= below[c]
        below[above[c]] += max(mass[c], below[c])
    labels, inside = np.full(n, -1, np.int64), [False] * len(births)
    for c in range(1, len(births)):  # parents come first, so the outermost chosen cluster counts
        inside[c] = chosen[c] or inside[above[c]]
        if chosen[c] and not inside[above[c]]:
            s, e = spans[c]
            labels[place[s:e]] = ids[place[s:e]].min()
    return ids, labels


def labelled(edges: DataFrame, smallest: DataFrame) -> DataFrame:
    """(grp, post_id, label, tried): clusters of each tree for each of the sizes in ``smallest`` (grp, sizes)."""

    def run(t: pa.Table) -> pa.Table:
        a, b, w = (t.column(c).to_numpy() for c in ("a", "b", "w"))
        parts = []
        for tried, size in enumerate(t.column("sizes")[0].as_py()):
            ids, labels = condense(a, b, w, size)
            grp = pa.array([t.column("grp")[0].as_py()] * len(ids), pa.string())
            parts.append(pa.table({"grp": grp, "post_id": ids, "label": labels, "tried": pa.array([tried] * len(ids), pa.int32())}))
        return pa.concat_tables(parts)

    return edges.join(smallest, "grp").groupBy("grp").applyInArrow(run, "grp string, post_id bigint, label bigint, tried int")
