"""Scores, graph, vectors and windows against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernwork.operators import clusters as cl
from fernwork.operators import graph as g
from fernwork.operators import health as h
from fernwork.operators import pairs as pr
from fernwork.operators import problems as pb
from fernwork.operators import tracking as tr
from fernwork.operators import vectors as vx
from fernwork.plans import scale


def val(spark, col):
    return spark.range(1).select(col).first()[0]


@pytest.mark.parametrize(
    "recent,prev,two,want",
    [(0, 0, 0, ("unknown", 30.0)), (2, 1, 3, ("dead", 0.0)), (100, 50, 150, ("growing", 100.0)), (50, 100, 150, ("declining", 0.0)), (100, 100, 200, ("stable", 50.0)), (10, 0, 10, ("growing", 100.0))],
)
def test_traffic_trend(spark, recent, prev, two, want):
    r = val(spark, h.traffic_trend(F.lit(recent), F.lit(prev), F.lit(two)))
    assert (r.trend, r.score) == want


def test_rank_engagement_freshness(spark):
    assert val(spark, h.ranking_score(F.lit(1.0))) == 100 and val(spark, h.ranking_score(F.lit(50.0))) == 0
    assert val(spark, h.engagement_score(F.lit(0.0), F.lit(None).cast("double"))) == pytest.approx(0.4 * 50 + 0.6 * 20)
    fresh = [val(spark, h.freshness_score(F.date_sub(F.lit("2024-01-31").cast("date"), d), "2024-01-31", F.lit(False))) for d in (0, 60, 270, 730, 4000)]
    assert fresh[0] == 100 and fresh == sorted(fresh, reverse=True) and fresh[-1] == 30
    assert val(spark, h.freshness_score(F.lit(None).cast("date"), "2024-01-31", F.lit(False))) == 35


@pytest.mark.parametrize("ga4,gsc", [(True, True), (True, False), (False, True), (False, False)])
def test_weights_sum_to_one(spark, ga4, gsc):
    w = h.factor_weights(F.lit(ga4), F.lit(gsc))
    assert sum(spark.range(1).select(*w.values()).first()) == pytest.approx(1.0)


def test_roles(spark):
    role = lambda s, share, pv, rival, seen=True, page="blog": val(spark, h.assign_role(F.lit(s), F.lit(share), F.lit(pv), F.lit(rival), F.lit(seen), F.lit(page)))
    assert role(60.0, 0.5, 10, False) == "pillar" and role(60.0, 0.5, 10, True) == "competitor" and role(60.0, 0.5, 10, False, page="landing") == "supporter"
    assert role(10.0, 0.5, 10, False) == "dead_weight" and role(35.0, 0.0, 5, False) == "supporter" and role(20.0, 0.0, 0, False, False) == "at_risk"


def test_severity_and_overlap(spark):
    s = lambda c, n: val(spark, pr.severity(F.lit(c).cast("double"), F.lit(n)))
    assert [s(0.7, 1), s(0.6, 0), s(0.5, 1), s(0.5, 0), s(None, 3), s(None, 1)] == ["critical", "high", "high", "medium", "medium", "low"]
    o = lambda c, n, u: val(spark, pr.overlap_score(F.lit(c).cast("double"), F.lit(n), F.lit(u)))
    assert o(0.5, 0, 0) == 0.5 and o(None, 1, 4) == 0.25 and o(1.0, 4, 4) == pytest.approx(1.0) and o(None, 0, 0) == 0


def test_pagerank_hub_and_dangling(spark):
    nodes = spark.createDataFrame([("s", i) for i in range(6)] + [("t", i) for i in range(3)], "site_id string, id int")
    edges = spark.createDataFrame([("s", i, 0) for i in range(1, 5)] + [("s", 0, 1), ("s", 1, 0)], "site_id string, src int, dst int")
    rows = g.pagerank(nodes, edges).collect()
    s = {r.id: r.pagerank for r in rows if r.site_id == "s"}
    assert sum(s.values()) == pytest.approx(1.0) and max(s, key=s.get) == 0 and s[5] == pytest.approx(s[2])
    assert all(r.pagerank == pytest.approx(1 / 3) for r in rows if r.site_id == "t")


def vectors(spark, n=150, dim=12, groups=3, seed=3):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim)) + 2 * rng.normal(size=(groups, dim))[np.arange(n) % groups]
    return m, spark.createDataFrame([(i, m[i].tolist(), i % groups) for i in range(n)], "post_id bigint, vec array<double>, cluster_id int")


def cosines(m):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return s


@pytest.mark.parametrize("block", [1024, 20])
def test_blocked_search_equals_brute_force(spark, block):
    m, df = vectors(spark)
    s = cosines(m)
    got = {}
    for r in vx.top_neighbours(df, 4, block=block).collect():
        got.setdefault(r.post_id, []).append((r["rank"], r.neighbour_id))
    assert all([x for _, x in sorted(got[i])] == np.argsort(-s[i], kind="stable")[:4].tolist() for i in range(len(m)))
    want = {(i, j) for i in range(len(m)) for j in range(i + 1, len(m)) if s[i, j] >= 0.7}
    pairs = {(r.post_a_id, r.post_b_id) for r in vx.similar_pairs(df, 0.7, block=block, cell="cluster_id").collect()}
    assert pairs == want
    cross = vx.top_matches(df, df, 2, block=block, floor=0.2, apart="cluster_id").collect()
    for r in cross:
        assert r.post_id % 3 != r.neighbour_id % 3 and r.similarity >= 0.2
    best = {r.post_id: r.neighbour_id for r in cross if r["rank"] == 1}
    for i in range(len(m)):
        row = np.where(np.arange(len(m)) % 3 == i % 3, -9, s[i])
        assert best.get(i) == (int(np.argmax(row)) if row.max() >= 0.2 else None)


def test_search_skips_cells_out_of_reach(spark, monkeypatch):
    """On separate blobs under a fifth of the pairs of cells is computed, and the result is that of all pairs."""
    rng = np.random.default_rng(11)
    m = (6 * rng.normal(size=(20, 16)))[np.arange(2000) % 20] + rng.normal(size=(2000, 16))
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(len(m))], "post_id bigint, vec array<double>")
    met, cells = [], []
    rows, listed = vx._pair_rows, vx._block_list
    monkeypatch.setattr(vx, "_pair_rows", lambda v, pairs, extra=None: met.append(pairs.count()) or rows(v, pairs, extra))
    monkeypatch.setattr(vx, "_block_list", lambda v: cells.append(v.select("_blk").distinct().count()) or listed(v))
    got = {}
    for r in vx.top_neighbours(df, 3, block=50).collect():
        got.setdefault(r.post_id, []).append((r["rank"], r.neighbour_id))
    s = cosines(m)
    assert all([x for _, x in sorted(got[i])] == np.argsort(-s[i], kind="stable")[:3].tolist() for i in range(len(m)))
    assert cells[0] >= 40 and sum(met) < 0.2 * cells[0] * (cells[0] + 1) / 2


def test_search_reads_rows_twice_and_sends_singles_where_exact(spark, monkeypatch):
    """What a search is given runs twice at most; coordinates are sent in single precision if that changes none."""
    rng = np.random.default_rng(4)
    rough = rng.normal(size=(600, 8)).astype(np.float32).astype(float)
    schema = "post_id bigint, vec array<double>"
    sent, rows = [], vx._tile_rows
    monkeypatch.setattr(vx, "_tile_rows", lambda left, *more: sent.append(left.schema["vec"].dataType.elementType.simpleString()) or rows(left, *more))
    for m, kind in ((rough, "float"), (rough + 1e-12, "double")):
        read = spark.sparkContext.accumulator(0)

        def seen(batches):
            for b in batches:
                read.add(b.num_rows)
                yield b

        df = spark.createDataFrame([(i, m[i].tolist()) for i in range(len(m))], schema).mapInArrow(seen, schema)
        sent.clear()
        got = {r.post_id: r.similarity for r in vx.top_matches(df, df, 3, block=50).filter("rank = 3").collect()}
        s = cosines(m)
        assert got == {i: pytest.approx(np.sort(s[i])[-3], abs=1e-14) for i in range(len(m))}
        assert set(sent) == {kind} and read.value <= 4 * len(m)


def test_cells_hold_zero_and_equal_vectors(spark):
    rng = np.random.default_rng(2)
    m = np.concatenate((np.zeros((5, 6)), np.ones((60, 6)), rng.normal(size=(60, 6))))
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(len(m))], "post_id bigint, vec array<double>")
    s = np.where(np.eye(len(m)) > 0, -9, (u := m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)) @ u.T)
    best = {r.post_id: r.similarity for r in vx.top_neighbours(df, 4, block=16).filter("rank = 4").collect()}
    assert best == {i: pytest.approx(np.sort(s[i])[-4]) for i in range(len(m))}


def test_copies_stay_bounded(spark):
    """A third of the vectors are identical: each still yields exactly k neighbours."""
    rows = [(i, [1.0, 0.0] if i % 3 == 0 else [math.cos(i), math.sin(i)]) for i in range(90)]
    df = spark.createDataFrame(rows, "post_id bigint, vec array<double>")
    n = vx.top_neighbours(df, 3, block=16).groupBy("post_id").count().collect()
    assert len(n) == 90 and all(r["count"] == 3 for r in n)


def test_query_partners_match_brute_force(spark):
    rng = np.random.default_rng(5)
    sets = {i: {int(q) for q in rng.zipf(1.4, 12) if q < 40} for i in range(40)}
    q = spark.createDataFrame([(i, f"q{x}") for i, s in sets.items() for x in s], "post_id bigint, query string")
    c = spark.createDataFrame([(i, 0) for i in sets], "post_id bigint, cluster_id int")
    got = {(r.post_a_id, r.post_b_id, r.n_shared) for r in pr.query_partners(q, c).collect()}
    want = {(i, j, len(sets[i] & sets[j])) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 3}
    assert got == want


def test_distributed_rank_with_a_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 10 < 8, "hot").otherwise("cold").alias("k"), (F.col("id") * 7919 % 3001).alias("v"))
    rows = scale.distributed_rank(df, ["k"], [F.asc("v")], "r", "n").collect()
    for key in ("hot", "cold"):
        part = sorted((r.r, r.v) for r in rows if r.k == key)
        assert [r for r, _ in part] == list(range(1, len(part) + 1)) and [v for _, v in part] == sorted(v for _, v in part)
        assert {r.n for r in rows if r.k == key} == {len(part)}


def test_calibration_uses_all_pairs_of_each_site(spark):
    few, _ = vectors(spark, n=4)
    sites = {1: few, 2: vectors(spark, n=60)[0], 3: 5 + vectors(spark, n=45, seed=8)[0]}
    rows = [(s, 100 * s + i, v.tolist()) for s, m in sites.items() for i, v in enumerate(m)] + [(4, 900, few[0].tolist())]
    got = {r.site_id: r for r in pr.calibrate(spark.createDataFrame(rows, "site_id bigint, post_id bigint, vec array<double>")).collect()}
    assert got[1][1:] == (6, 0.45, 0.55, 0.65) and got[4][1:] == (0, 0.45, 0.55, 0.65)
    for site in (2, 3):
        m = sites[site]
        pairs = np.round(cosines(m)[np.triu_indices(len(m), 1)], 6)
        want = [max(np.percentile(pairs, q), f) for q, f in ((85, 0.4), (92, 0.5), (97, 0.6))]
        assert got[site].n == len(pairs) and list(got[site][2:]) == pytest.approx(want, abs=1e-9)


def test_velocity_and_merge(spark):
    days = ["2023-09-20"] * 8 + ["2024-01-10"]
    posts = spark.createDataFrame([(i, "s", d) for i, d in enumerate(days)], "post_id int, site_id string, d string").withColumn("publish_date", F.col("d").cast("date"))
    assert pb.publishing_velocity(posts, "2024-01-31", 90).first().trend == "declining"
    assert pb.velocity_decline(posts, "2024-01-31", 90).first().post_id == 8
    rows = spark.createDataFrame([(1, "orphan"), (1, "seo_no_internal_links"), (2, "seo_no_internal_links"), (3, "thin_content"), (3, "thin_below_cluster_avg")], "post_id int, problem_type string")
    out = {(r.post_id, r.problem_type): r.related_to for r in pb.group_related(rows).collect()}
    assert (1, "seo_no_internal_links") not in out and (2, "seo_no_internal_links") in out and out[(3, "thin_below_cluster_avg")] == "thin_content"


def test_streaks(spark):
    days = [("a", f"2024-01-{d:02d}") for d in (1, 2, 3, 10, 11, 12, 13, 14, 15, 16)] + [("a", "2024-01-16")]
    r = tr.streaks(spark.createDataFrame(days, "user_id string, d string").withColumn("date", F.col("d").cast("date")), "2024-01-31").first()
    assert (r.current_streak, r.longest_streak, r.total_check_ins, r.milestone) == (7, 7, 10, "bronze")


def test_duplicates_do_not_multiply(spark):
    posts = spark.createDataFrame([(i, "s", "h" if i % 3 == 0 else str(i)) for i in range(300)], "post_id int, site_id string, content_hash string")
    rows = pr.exact_duplicates(posts).collect()
    assert len(rows) == 99 and {r.canonical_id for r in rows} == {0}


def test_rows_are_sent_once_a_tile(spark, monkeypatch):
    """Where no cell is out of reach of another, a wave sends a row once a tile and not once a cell that it meets; results over several tiles are exact."""
    rng = np.random.default_rng(8)
    m = rng.normal(size=(600, 24))
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(len(m))], "post_id bigint, vec array<double>")
    sent, rows = [], vx._pair_rows
    monkeypatch.setattr(vx, "TILE", 200, raising=False)

    def count(*args):
        out = rows(*args)
        sent.append(out.filter("side < 2").count())
        return out

    monkeypatch.setattr(vx, "_pair_rows", count)
    got = {}
    for r in vx.top_neighbours(df, 3, block=16).collect():
        got.setdefault(r.post_id, []).append((r["rank"], r.neighbour_id))
    s = cosines(m)
    assert all([x for _, x in sorted(got[i])] == np.argsort(-s[i], kind="stable")[:3].tolist() for i in range(len(m)))
    assert len(sent) == 2 and max(sent) <= 3 * len(m)


def test_candidates_count_queries_where_cosines_are(spark, monkeypatch):
    """Common and rare queries over several tiles, against brute force; no pair is joined with its queries."""
    monkeypatch.setattr(vx, "TILE", 30)
    monkeypatch.setattr(pr, "shared_queries", None)
    rng = np.random.default_rng(4)
    m, df = vectors(spark, n=120, groups=2)
    df = df.withColumn("cluster_id", F.when(F.col("post_id") >= 115, 9).otherwise(F.col("post_id") % 2).cast("int"))
    cluster = [9 if i >= 115 else i % 2 for i in range(120)]
    sets = {i: {int(x) for x in rng.integers(0, 6, 2)} | {100 + int(x) for x in rng.integers(0, 300, 6)} for i in range(0, 120, 2)} | {i: {1000 + i} for i in range(1, 120, 2)}
    q = spark.createDataFrame([(i, f"q{x}") for i, s in sets.items() for x in s], "post_id bigint, query string")
    s, flag, want = cosines(m), 0.6, {}
    for i in range(120):
        mine = [j for j in range(120) if j != i and cluster[j] == cluster[i]]
        best = sorted(mine, key=lambda j: (-s[i, j], j))[:10]
        for j in mine:
            n, a, b = len(sets[i] & sets[j]), min(i, j), max(i, j)
            if cluster[i] == 9 or n >= 3 or (s[i, j] >= flag and (n or j in best)):
                want[a, b] = n
    got = {(r.post_a_id, r.post_b_id): r.n_shared for r in pr.cluster_candidates(df, q, flag).collect()}
    assert got == want and {0, 1, 2, 3} <= set(want.values())


@pytest.mark.parametrize("flags", [False, True])
def test_gated_candidates_equal_gates_behind_them(spark, monkeypatch, flags):
    """Pairs gated in their task, in batches of seven, are those that pass the gate behind it, nulls and zero vectors included, with the columns of their pages."""
    monkeypatch.setattr(vx, "TILE", 200)
    monkeypatch.setattr(vx, "BATCH", 7)
    rng = np.random.default_rng(14)
    m, _ = vectors(spark, n=130, groups=2)
    m[5] = m[8] = m[126] = 0
    df = spark.createDataFrame([(i, m[i].tolist(), 9 if i >= 122 else i % 2, i % 3) for i in range(130)], "post_id bigint, vec array<double>, cluster_id int, site_id int")
    q = spark.createDataFrame([(i, f"q{x}") for i in range(130) if i % 3 for x in rng.integers(0, 9, 1 + i % 5)], "post_id bigint, query string").distinct()
    pick = lambda *x: x[int(rng.integers(0, len(x)))]
    rows = [(i, pick("h", "k", None, f"h{i}"), pick("en", "en", "de", None), pick("x", "y", None), None if i % 7 == 0 else ["w", f"w{i}"]) for i in range(130) if i != 40]
    pages = spark.createDataFrame(rows, "post_id bigint, hash string, lang string, intent string, words array<string>").withColumn("terms", F.col("words"))
    flag = spark.createDataFrame([(0, 0.5), (1, 0.7)], "site_id int, flag double") if flags else 0.55
    plain = pr.with_signals(pr.cluster_candidates(df, q, flag), pages)
    if flags:
        plain = pr.with_thresholds(plain, df, flag.selectExpr("*", "0.8D AS high", "0.9D AS critical"))
    want = {(r.post_a_id, r.post_b_id): r for r in pr.gate(plain, F.col("flag") if flags else flag).collect()}
    got = pr.cluster_candidates(df, q, flag, pages=pages, first=["cluster_id"], both=["words", "intent"], words=["terms"]).collect()
    assert len(got) == len(want) > 100 and len({r.n_shared for r in got}) > 3
    for r in got:
        w = want[r.post_a_id, r.post_b_id]
        assert (r.n_shared, r.words_a, r.words_b, r.intent_a, r.intent_b) == (w.n_shared, w.words_a, w.words_b, w.intent_a, w.intent_b)
        assert r.terms_shared == len(set(w.words_a or []) & set(w.words_b or []))
        assert r.cosine == pytest.approx(w.cosine, abs=1e-12) and r.cluster_id == (9 if r.post_a_id >= 122 else r.post_a_id % 2)


def test_pairs_are_not_shuffled(spark):
    """What grows with the square of a cluster leaves the task that finds it rated: no exchange stands above that task."""
    from fernwork.plans import catalog_pairs
    from fernwork.plans.tables import Tables

    plan = catalog_pairs.f19b(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(i for i, line in enumerate(plan) if "FlatMapGroupsInArrow" in line and "every" in line)
    above, level = [], depth(plan[at])
    for line in reversed(plan[:at]):
        if depth(line) < level:
            above, level = [*above, line], depth(line)
    assert above and not [x for x in above if "Exchange" in x or "Join" in x]


def test_chunks_of_a_pair_meet_in_its_task(spark):
    """Chunk pairs are never rows: the plan groups both sides by pair, and values equal brute force."""
    rng = np.random.default_rng(6)
    m = rng.normal(size=(40, 8))
    m[0] = 0
    chunks = spark.createDataFrame([(i % 4, m[i].tolist()) for i in range(40)] + [(7, [0.0] * 8)], "post_id bigint, vec array<double>")
    pairs = spark.createDataFrame([(0, 1, 0.9), (1, 3, 0.8), (0, 7, 0.9), (2, 3, 0.1), (1, 9, 0.9)], "post_a_id bigint, post_b_id bigint, cosine double")
    out = pr.confirm_chunks(pairs, chunks)
    got = {(r.post_a_id, r.post_b_id): r.chunk_similarity for r in out.collect()}
    s = cosines(m)
    want = {(a, b): max(s[i, j] for i in range(a, 40, 4) for j in range(b, 40, 4) if m[i].any()) for a, b in ((0, 1), (1, 3))}
    assert got == {**{k: pytest.approx(v) for k, v in want.items()}, (0, 7): None}
    assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().toString()


def test_tiles_of_a_group_do_not_grow_with_it(spark):
    """A group of 20,000 rows is sent as often as one of 2,000; tiles stay bounded beyond."""
    sizes = [2000, 20_000, 200_000, 600_000, 6_000_000]
    got = [r.t for r in spark.createDataFrame([(n,) for n in sizes], "n bigint").select(vx.tile_count(F.col("n")).alias("t")).collect()]
    assert got[0] == got[1] and got[2] <= 8 and all(n / t <= vx.WIDE for n, t in zip(sizes, got))


def test_search_in_single_precision_is_exact(spark, monkeypatch):
    """Near copies closer than single precision tells apart, exact copies and several tiles: ranks of brute force, ties by id."""
    monkeypatch.setattr(vx, "TILE", 300)
    rng = np.random.default_rng(12)
    seeds = rng.normal(size=(30, 12))
    m = seeds[np.arange(900) % 30] * (1 + 1e-9 * np.arange(900)[:, None]) + 1e-5 * rng.normal(size=(900, 12))
    m[700:] = m[400]
    df = spark.createDataFrame([(i, m[i].tolist(), i % 2) for i in range(len(m))], "post_id bigint, vec array<double>, half int")
    s = cosines(m)
    for found, ok in ((vx.top_neighbours(df, 4, block=300), s > -2), (vx.top_matches(df, df, 4, block=300, apart="half"), np.arange(900)[:, None] % 2 != np.arange(900)[None, :] % 2)):
        got = {}
        for r in found.collect():
            got.setdefault(r.post_id, []).append((r["rank"], r.neighbour_id, r.similarity))
        for i in range(len(m)):
            want = np.where(ok[i], s[i], -9)
            best = np.sort(want)[::-1][:4]
            mine = sorted(got[i])
            assert [x for *_, x in mine] == pytest.approx(best, abs=1e-14) and all(want[j] == pytest.approx(x, abs=1e-14) for _, j, x in mine)
            if i >= 700:
                equal = [j for j in [400, *range(700, 900)] if j != i and ok[i, j]][:4]
                assert [j for _, j, _ in mine] == equal


def test_pairs_of_cells_are_listed_by_cell(spark, monkeypatch):
    """Where all cells reach each other, a wave lists them in a row for each cell and tile, not for each pair; every pair is met once."""
    rng = np.random.default_rng(9)
    m = rng.normal(size=(500, 24))
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(len(m))], "post_id bigint, vec array<double>")
    waves, rows = [], vx._pair_rows
    monkeypatch.setattr(vx, "_pair_rows", lambda v, pairs, kth=None: waves.append(pairs) or rows(v, pairs, kth))
    found = vx.top_neighbours(df, 3, block=16).count()
    listed = [[(r._no, x) for r in p.collect() for x in r._others] for p in waves]
    cells = 1 + max(b for _, b in listed[1])
    pairs = sorted(listed[0] + listed[1])
    assert found == 1500 and pairs == [(a, b) for a in range(cells) for b in range(a, cells)]
    assert cells > 30 and waves[1].count() <= cells and vx._pair_rows is not rows
