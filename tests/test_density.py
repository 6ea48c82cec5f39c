"""Density clusters against a plain version, splitting, and clusters of several sites."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fernwork.operators import clusters as cl
from fernwork.operators import density as dn
from fernwork.operators import layout as lay


def blobs(n, dim, groups, spread, seed):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(groups, dim))[np.arange(n) % groups] + spread * rng.normal(size=(n, dim))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def plain_reach(m, k):
    d = np.sqrt(np.maximum(0, 2 - 2 * np.round(m @ m.T, 12)))
    np.fill_diagonal(d, np.inf)
    core = np.sort(d, axis=1)[:, k - 1]
    return np.maximum(d, np.maximum(core[:, None], core[None, :]))


def plain_tree(reach):
    """Kruskal over all pairs."""
    n = len(reach)
    pairs = sorted((reach[i, j], i, j) for i in range(n) for j in range(i + 1, n))
    of, out = list(range(n)), []
    for w, i, j in pairs:
        if of[i] != of[j]:
            old, new = of[i], of[j]
            of = [new if x == old else x for x in of]
            out.append((w, i, j))
    return out


def plain_clusters(tree, n, smallest):
    """Condensed tree by cutting the longest edge again and again."""
    out = []  # (members, birth, mass, children)

    def parts(edges, members):
        of = {v: v for v in members}
        def find(v):
            while of[v] != v:
                v = of[v]
            return v
        for _, i, j in edges:
            of[find(i)] = find(j)
        groups = {}
        for v in members:
            groups.setdefault(find(v), set()).add(v)
        return list(groups.values())

    def grow(members, edges, birth):
        me = {"members": set(members), "mass": 0.0, "children": []}
        edges = sorted(edges)
        while True:
            if not edges:
                return me
            w, i, j = edges.pop()
            level = 1 / max(w, dn.FLAT)
            sides = parts(edges, members)
            big = [s for s in sides if len(s) >= smallest]
            if len(big) == 2:
                me["mass"] += len(members) * (level - birth)
                me["children"] = [grow(s, [e for e in edges if e[1] in s], level) for s in big]
                return me
            for s in sides:
                if len(s) < smallest:
                    me["mass"] += len(s) * (level - birth)
            if not big:
                return me
            members = big[0]
            edges = [e for e in edges if e[1] in members]

    def choose(c):
        below = [choose(x) for x in c["children"]]
        inner, picked = sum(x for x, _ in below), [p for _, y in below for p in y]
        return (c["mass"], [c["members"]]) if c["mass"] >= inner else (inner, picked)

    root = grow(set(range(n)), list(tree), 0.0)
    labels = [-1] * n
    for c in root["children"]:
        for members in choose(c)[1]:
            for v in members:
                labels[v] = min(members)
    return labels


@pytest.mark.parametrize("dense", [2048, 0])
def test_clusters_of_two_sites_equal_the_plain_version(spark, monkeypatch, dense):
    monkeypatch.setattr(dn, "DENSE", dense)
    sites = {"a": blobs(170, 8, 5, 0.35, 1), "b": blobs(130, 6, 3, 0.5, 2)}
    rows = [(g, i, m[i].tolist()) for g, m in sites.items() for i in range(len(m))]
    df = spark.createDataFrame(rows, "grp string, post_id bigint, vec array<double>")
    edges = dn.forest(df, F.when(F.col("n") < 150, 2).otherwise(3)).collect()
    smallest = spark.createDataFrame([("a", [6, 9]), ("b", [5])], "grp string, sizes array<int>")
    frame = spark.createDataFrame(edges, dn.EDGES)
    got = {(r.grp, r.tried, r.post_id): r.label for r in dn.labelled(frame, smallest).collect()}
    for g, m in sites.items():
        tree = plain_tree(plain_reach(m, 3 if g == "a" else 2))
        mine = sorted((round(e.w, 9), e.a, e.b) for e in edges if e.grp == g)
        assert len(mine) == len(m) - 1 and mine == sorted((round(w, 9), i, j) for w, i, j in tree)
        for tried, size in enumerate([6, 9] if g == "a" else [5]):
            want = plain_clusters(tree, len(m), size)
            assert [got[g, tried, i] for i in range(len(m))] == want
            assert len(set(want) - {-1}) >= 2


def test_forest_of_equal_vectors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    m = np.concatenate((np.tile([[1.0, 0, 0]], (60, 1)), rng.normal(size=(40, 3))))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([("g", i, m[i].tolist()) for i in range(len(m))], "grp string, post_id bigint, vec array<double>")
    weights = []
    for dense in (2048, 0):
        monkeypatch.setattr(dn, "DENSE", dense)
        edges = dn.forest(df, F.lit(2)).collect()
        assert len(edges) == len(m) - 1
        weights.append(sum(e.w for e in edges))
    assert weights[0] == pytest.approx(weights[1]) == pytest.approx(sum(w for w, _, _ in plain_tree(plain_reach(m, 2))))


def test_topics_of_several_sites(spark):
    first, second = blobs(120, 12, 3, 0.15, 5), blobs(90, 12, 2, 0.15, 6)
    rows = [(1, i, first[i].tolist()) for i in range(120)] + [(2, 1000 + i, second[i].tolist()) for i in range(90)]
    rows += [(3, 2000 + i, first[i].tolist()) for i in range(9)] + [(None, 3000, first[0].tolist())]
    out = cl.topic_clusters(spark.createDataFrame(rows, "site_id bigint, post_id bigint, vec array<double>")).collect()
    assert len(out) == 219 and {r.cluster_id for r in out if r.site_id == 3} == {2000}
    for site, start, groups in ((1, 0, 3), (2, 1000, 2)):
        made = {}
        for r in out:
            if r.site_id == site:
                made.setdefault(r.cluster_id, set()).add((r.post_id - start) % groups)
        assert len(made) == groups and all(len(v) == 1 for v in made.values()) and set(made) == {start + i for i in range(groups)}


def test_splitting_leaves_nothing_large_but_what_rejects_it(spark):
    m = blobs(240, 12, 12, 0.1, 7)
    lone = blobs(60, 40, 1, 3.0, 8)
    rows = [(i, m[i].tolist(), i % 2) for i in range(240)] + [(500 + i, lone[i].tolist(), 7) for i in range(60)] + [(900 + i, m[i].tolist(), 9) for i in range(20)]
    rows = [(p, v + [0.0] * (40 - len(v)), c) for p, v, c in rows]
    out = cl.split_large(spark.createDataFrame(rows, "post_id bigint, vec array<double>, cluster_id int"), limit=25).collect()
    assert len(out) == len(rows)
    sizes = {}
    for r in out:
        assert r.path.split(".")[0] == str(r.cluster_id)
        sizes.setdefault((r.path, r.rejected), []).append(r.post_id)
    assert all(len(v) <= 25 or rejected for (_, rejected), v in sizes.items())
    assert sum(len(v) == 20 and len({p % 12 for p in v}) == 1 for (path, _), v in sizes.items() if path[0] in "01") == 12
    assert {path for path, _ in sizes if path[0] == "9"} == {"9"}


def test_groups_keep_clusters_of_their_site(spark):
    """A lone post moves to a cluster of its own site, though another site's is nearer."""
    rows = [(0, 1, 10, [1.0, 0.0]), (0, 2, 10, [1.0, 0.1]), (0, 3, 11, [0.0, 1.0]), (1, 4, 20, [0.0, 1.0]), (1, 5, 20, [0.1, 1.0]), (1, 6, 21, [5.0, 1.0])]
    df = spark.createDataFrame(rows, "site_id bigint, post_id bigint, cluster_id int, vec array<double>")
    moved = {r.post_id: r.cluster_id for r in cl.absorb_small(df, 2, ["site_id"]).collect()}
    assert moved[3] == 10 and moved[6] == 20
    near = {r.cluster_id: r.post_id for r in cl.centroid_nearest(df, ["site_id"]).collect()}
    assert near == {10: 1, 11: 3, 20: 4, 21: 6} or near == {10: 2, 11: 3, 20: 5, 21: 6} or near == {10: 1, 11: 3, 20: 5, 21: 6} or near == {10: 2, 11: 3, 20: 4, 21: 6}


def trust(m, xy, k=10):
    """Share of the neighbours on the map that are neighbours in space, by rank."""
    rank = lambda d: np.argsort(np.argsort(d + np.diag(np.full(len(d), -1.0)), axis=1), axis=1)
    space, flat = rank(1 - m @ m.T), rank(((xy[:, None] - xy[None, :]) ** 2).sum(axis=2))
    n = len(m)
    lost = np.where((flat >= 1) & (flat <= k), np.maximum(0, space - k), 0).sum()
    return 1 - 2 * lost / (n * k * (2 * n - 3 * k - 1))


def test_map_keeps_neighbours_better_than_a_projection(spark):
    sites = {1: blobs(180, 20, 15, 0.2, 3), 2: blobs(120, 20, 10, 0.2, 4)}
    rows = [(s, 1000 * s + i, m[i].tolist(), i % 7) for s, m in sites.items() for i in range(len(m))] + [(3, 9000, [1.0] + [0.0] * 19, None)]
    out = lay.map_positions(spark.createDataFrame(rows, "site_id bigint, post_id bigint, vec array<double>, cluster_id int"), pull=0.0).collect()
    assert len(out) == len(rows) and all(np.isfinite([r.x, r.y]).all() for r in out)
    for s, m in sites.items():
        xy = np.array([[r.x, r.y] for r in sorted((r for r in out if r.site_id == s), key=lambda r: r.post_id)])
        _, _, v = np.linalg.svd(m - m.mean(axis=0), full_matrices=False)
        # less than half of what the two main directions lose
        assert 1 - trust(m, xy) < 0.5 * (1 - trust(m, m @ v[:2].T))


def test_tree_of_one_task_holds_no_matrix():
    """6,000 vectors: their matrix would be 288 MB."""
    m = blobs(6000, 8, 40, 0.3, 9)
    t = pa.table({"grp": ["g"] * 6000, "post_id": np.arange(6000), "vec": pa.array(list(m)), "samples": [2] * 6000})
    tracemalloc.start()
    edges = dn._dense(t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert edges.num_rows == 5999 and len(set(edges["a"].to_pylist()) | set(edges["b"].to_pylist())) == 6000
    assert peak < 250e6


def test_largest_component_is_not_searched(spark, monkeypatch):
    """Components that the lists can't join hook onto the largest, whose vectors ask for nothing; the tree is that of all pairs."""
    monkeypatch.setattr(dn, "DENSE", 0)
    rng = np.random.default_rng(10)
    of = np.array([0] * 80 + [1] * 30 + [2] * 25)
    m = 4 * np.eye(6)[of] + 0.2 * rng.normal(size=(135, 6))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    asked, search = [], dn.vx.top_matches
    monkeypatch.setattr(dn.vx, "top_matches", lambda left, *a, **k: asked.append({r.post_id for r in left.select("post_id").collect()}) or search(left, *a, **k))
    df = spark.createDataFrame([("g", i, m[i].tolist()) for i in range(135)], "grp string, post_id bigint, vec array<double>")
    edges = dn.forest(df, F.lit(2)).collect()
    assert sorted((round(e.w, 9), e.a, e.b) for e in edges) == sorted((round(w, 9), i, j) for w, i, j in plain_tree(plain_reach(m, 2)))
    assert asked and all(found and min(found) >= 80 for found in asked)


def test_layout_rounds_over_blocks_equal_plain_ones(spark, monkeypatch):
    """Blocks of a site smaller than the site change nothing: posts are pulled by edges and pushed by drawn posts of all blocks."""
    monkeypatch.setattr(lay, "SIDE", 30)
    rng, n = np.random.default_rng(6), 70
    w = np.where(rng.random((n, n)) < 0.1, rng.random((n, n)), 0)
    w[0] = w[:, 0] = 0
    w = np.triu(w, 1) + np.triu(w, 1).T
    graph = spark.createDataFrame([(1, 100 + int(i), 100 + int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w))], "site_id bigint, post_id bigint, other bigint, w double")
    xy, degree = rng.normal(size=(n, 2)), w.sum(axis=1)
    rows = [(1, 100 + i, i + 1, n, float(degree[i]), *xy[i].tolist()) for i in range(n)] + [(2, 500, 1, 1, 0.0, 1.0, 2.0)]
    ranked = spark.createDataFrame(rows, "site_id bigint, post_id bigint, rank bigint, n bigint, degree double, x double, y double")
    places, pieces = lay._blocks(graph, ranked)
    got = {(r.site_id, r._b): np.stack([np.frombuffer(r.x), np.frombuffer(r.y)], axis=1) for r in lay.layout(pieces, places, 2, 1.0).collect()}
    seeds = F.array(*[F.xxhash64("post_id", F.lit(t), F.lit(s)) for t in range(2) for s in range(lay.DRAWN)])
    drawn = np.array([r.d for r in ranked.filter("site_id = 1").orderBy("rank").select(seeds.alias("d")).collect()]).reshape(n, 2, lay.DRAWN) % n
    for t in range(2):
        pull = np.where(degree[:, None] > 0, w @ xy / np.maximum(degree, 1e-300)[:, None] - xy, 0)
        push = np.zeros((n, 2))
        for i in range(n):
            for j in drawn[i, t]:
                d = xy[j] - xy[i]
                push[i] += np.clip(-2 / ((0.01 + d @ d) * (1 + d @ d)) * d, -4, 4) if i != j else 0
        xy = xy + (1 - t / 2) * np.clip(np.clip(pull, -4, 4) + push, -4, 4)
    assert sorted(got) == [(1, 0), (1, 1), (1, 2), (2, 0)] and got[2, 0].tolist() == [[1.0, 2.0]]
    assert np.concatenate([got[1, b] for b in range(3)]) == pytest.approx(xy, abs=1e-9)
