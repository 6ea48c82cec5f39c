"""Line dedup, decontamination, SimHash, mixing: against plain versions, and on odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fernwork.llm import decontaminate, linededup, mixing, simhash
from fernwork.llm.components import components

SCHEMA = "doc_id long, text string, source string, n_words int, copy string"
ODD = [(None, "a b c", "x", 1, "k"), (7, None, None, None, None), (8, "", "x", 2, "k"), (9, "a b c", "y", 3, "k"), (9, "a b c", "y", 3, "k"), (10, "\n\n\n\n", "y", 4, "k"), (11, "w " * 30_000, "z", 5, "k")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "a B c"), (2, None), (3, ""), (1, "a B c"), (4, "w " * 40)], "item_id long, text string")


def corpus(seed, n=120, words=30):
    r = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(words)]
    texts = ["\n".join(" ".join(r.choices(vocabulary, k=r.randint(1, 9))) for _ in range(r.randint(1, 8))) for _ in range(n)]
    for _ in range(n // 3):  # copies with a word or a line changed
        parts = r.choice(texts).split("\n")
        parts[r.randrange(len(parts))] = r.choice(vocabulary)
        texts.append("\n".join(parts))
    return list(enumerate(texts))


def test_line_dedup_against_plain_version(spark):
    docs = corpus(1)
    seen, want = set(), {}
    for d, t in docs:
        parts = t.split("\n")
        gone = set()
        for i in range(len(parts) - 2):
            w = tuple(parts[i : i + 3])
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        want[d] = ("\n".join(p for i, p in enumerate(parts) if i not in gone), len(gone))
    out = linededup.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"), removed_col="n").collect()
    assert {r.doc_id: (r.text, r.n) for r in out} == want
    assert sum(n for _, n in want.values()) > 0


def test_line_dedup_overlaps_and_odd_rows(spark, odd, none):
    rows = [(1, "a\na\na\na"), (2, "x\na\na\na\ny"), (None, "p\nq\nr"), (None, "p\nq\nr\ns")]
    out = {(r.doc_id, r.text) for r in linededup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {(1, "a"), (2, "x\ny"), (None, "p\nq\nr"), (None, "s")} or out == {(1, "a"), (2, "x\ny"), (None, ""), (None, "p\nq\nr\ns")}
    assert sorted(map(str, linededup.without_repeats(odd).collect())) == sorted(map(str, odd.collect()))
    assert linededup.without_repeats(none).count() == 0


def test_line_dedup_of_short_texts(spark):
    rows = [(1, "a\nb"), (2, "a\nb"), (3, "a"), (4, "a"), (5, "a\nb\nc"), (6, " "), (7, " "), (8, None), (9, "a\nb\nc")]
    out = linededup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), removed_col="n", short=True).collect()
    assert {r.doc_id: (r.text, r.n) for r in out} == {d: (t, 0) for d, t in rows} | {2: ("", 2), 4: ("", 1), 9: ("", 3)}
    frame = spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string")
    assert {r.text for r in corpus_pipeline.lines(spark, frame, "").collect()} == {"a b", ""}


def test_decontamination_against_plain_version(spark):
    docs = corpus(2, words=6)
    bench = [(f"i{k}", " ".join(t.replace("\n", " ").upper().split()[:n])) for k, ((_, t), n) in enumerate(zip(docs[:14], [1, 2, 3, 9, 10, 11, 25] * 2))]
    want = decontaminate.brute_force(docs, bench)
    frame, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id string, text string")
    for block in (100_000, 7):  # one block of patterns, and several
        out = decontaminate.find(frame, items, block=block).withColumn("hits", decontaminate.hit_words(F.col("spans"))).collect()
        assert {r.doc_id: (r.n_words, r.hits, len(r["items"])) for r in out} == {d: w[:3] for d, w in want.items()}
    assert any(w[1] for w in want.values())


def test_decontamination_odd_rows(odd, none, items):
    out = {(r.doc_id, r.n_words, len(r.spans), tuple(r["items"])) for r in decontaminate.find(odd, items).collect()}
    assert out == {(None, 3, 1, ("1",)), (7, 0, 0, ()), (8, 0, 0, ()), (9, 3, 1, ("1",)), (10, 0, 0, ()), (11, 30_000, 1, ("4",))}
    kept = decontaminate.clean(odd, items)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {7, 8, 10} and {r.n_words for r in kept.collect()} == {None, 2, 4}
    assert decontaminate.find(none, items).count() == 0 and decontaminate.clean(odd, items.limit(0)).count() == odd.count()


def test_simhash_against_plain_version(spark):
    docs = corpus(3, n=150)
    want = simhash.brute_force(docs)
    out = simhash.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["id"]: (f"{int.from_bytes(r.fp, 'little'):016x}", r.component_id) for r in out} == want


def test_ring_keys_bring_every_near_pair_together():
    import numpy as np

    r = np.random.default_rng(0)
    a = r.integers(0, 2**63, 4000, dtype=np.uint64)
    flips = np.zeros_like(a)
    for _ in range(3):
        flips |= np.uint64(1) << r.integers(0, 64, len(a)).astype(np.uint64)
    b = a ^ flips
    assert (simhash.ring_keys(a[:, None]) == simhash.ring_keys(b[:, None])).any(axis=1).all()
    assert simhash.near((a ^ b)[:, None], 3, 4).all()
    assert not simhash.near((a ^ r.permutation(a))[:, None], 3, 4)[:100].any()


def test_large_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)
    docs = [(i, " ".join(["same"] * 200 + [f"w{i % 60}"])) for i in range(90)] + corpus(5, n=40)[:40]
    docs = [(i, t) for i, (_, t) in enumerate(docs)]
    out = simhash.groups(spark.createDataFrame(docs, "doc_id long, text string"), shingle=1).collect()
    want = simhash.brute_force(docs, shingle=1)
    assert {r["id"]: r.component_id for r in out} == {d: c for d, (_, c) in want.items()}


def test_wide_groups_find_pairs_of_similarity_four_fifths(spark):
    r = random.Random(4)
    docs, pairs = [], 150
    for k in range(pairs):
        words = [f"w{r.randrange(10**6)}" for _ in range(300)]
        other = list(words)
        for i in r.sample(range(300), 6):  # about 30 of 296 shingles change: similarity 0.82
            other[i] = f"v{r.randrange(10**6)}"
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    kept = {x.doc_id for x in simhash.one_of_each_group(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(2 * k in kept for k in range(pairs))
    assert sum(2 * k + 1 in kept for k in range(pairs)) <= 0.2 * pairs


def test_wide_groups_are_checked_exactly(spark):
    r = random.Random(14)
    pairs = []
    for _ in range(600):
        words = [f"w{r.randrange(10**6)}" for _ in range(304)]  # 300 shingles
        other, share = list(words), r.uniform(0.70, 0.86)
        places = r.sample(range(304), 60)
        while True:
            a, b = ({tuple(x[i : i + 5]) for i in range(300)} for x in (words, other))
            similarity = len(a & b) / len(a | b)
            if similarity <= share:
                break
            other[places.pop()] = f"v{r.randrange(10**6)}"
        pairs.append((similarity, " ".join(words), " ".join(other)))
    docs = [(2 * k + i, t) for k, x in enumerate(pairs) for i, t in enumerate(x[1:])]
    kept = {x.doc_id for x in simhash.one_of_each_group(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    gone = [(s, 2 * k + 1 not in kept) for k, (s, _, _) in enumerate(pairs)]
    near, below = [g for s, g in gone if 0.8 <= s < 0.83], [g for s, g in gone if 0.7 <= s < 0.8]
    print("found", sum(near), "of", len(near), "removed below", sum(below), "of", len(below))
    assert all(2 * k in kept for k in range(len(pairs))) and len(near) > 50 and len(below) > 100
    assert sum(near) >= 0.97 * len(near) and not any(below)


def test_wide_groups_join_what_the_first_member_does_not(spark, monkeypatch):
    words = [f"w{i}" for i in range(304)]
    def step(n):  # each step changes 25 shingles; neighbours are near copies, the ends are not
        return " ".join(f"v{i}" if i % 5 == 2 and i < 25 * n else w for i, w in enumerate(words))
    docs = [(i, step(i)) for i in range(6)] + [(9, "something else that has nothing to do with it")]
    for bucket, copies, hashes in ((2048, 96, 1 << 20), (2, 96, 1 << 20), (2, 1, 1 << 20), (2048, 96, 500)):
        for name, value in (("BUCKET", bucket), ("COPIES", copies), ("HASHES", hashes)):
            monkeypatch.setattr(simhash, name, value)
        assert {x.doc_id for x in simhash.one_of_each_group(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == {0, 9}


def test_blocks_give_forests_equal_to_all_pairs():
    """Many near copies of one text at similarities around the threshold: fewer links than nodes, the same groups as all pairs give."""
    r = np.random.default_rng(3)
    base = np.unique(r.integers(0, 1 << 63, 300).astype(np.uint64))
    sets = []
    for _ in range(400):
        keep = r.random(len(base)) < r.uniform(0.80, 0.97)
        extra = r.integers(0, 1 << 63, int((~keep).sum())).astype(np.uint64)
        sets.append(np.unique(np.concatenate((base[keep], extra))))
    fp = np.stack([simhash.majority(simhash.widen(s, 4)) for s in sets])
    links = simhash.verified(np.arange(400), np.arange(400), fp, sets, 256, 16, 0.8)
    of, want = np.arange(400), np.arange(400)
    for a in range(400):
        for b in range(a):
            if simhash.shared(sets[a], sets[b], 0.8) and want[a] != want[b]:
                want[want == want[a]] = want[b]
    for a, b in links:
        assert simhash.shared(sets[a], sets[b], 0.8) and of[a] != of[b]
        of[of == of[a]] = of[b]
    assert {tuple(np.flatnonzero(of == k)) for k in set(of)} == {tuple(np.flatnonzero(want == k)) for k in set(want)}
    assert 1 < len(set(want)) < 400


def test_rows_that_share_an_id_are_decided_one_by_one(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    out = simhash.one_of_each_group(spark.createDataFrame([(3, a), (5, a), (5, b), (9, b)], "doc_id long, text string")).collect()
    assert sorted(map(tuple, out)) == [(3, a), (5, b)]


def test_simhash_odd_rows(odd, none):
    out = {(r["id"], r.fp.hex(), r.component_id) for r in simhash.groups(odd).collect()}
    assert {c for i, f, c in out if i in (7, 8, 10)} == {7} and {f for i, f, c in out if i in (7, 8, 10)} == {"00" * 8}
    assert {c for i, f, c in out if i in (None, 9)} == {9}
    assert simhash.groups(none).count() == 0
    kept = simhash.one_of_each_group(odd)
    assert kept.columns == odd.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == ["11", "7", "9", "None"]


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, None)]
    of = {n: n for e in edges if None not in e for n in e}
    for _ in range(len(of)):
        new = dict(of)
        for a, b in edges:
            if b is not None:
                new[a] = new[b] = min(new[a], new[b], of[a], of[b])
        if new == of:
            break
        of = new
    out = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {n: c for n, c in of.items() if any(a != b and n in (a, b) for a, b in edges if b is not None)}


def plain_targets(sizes, weights, total, epochs):
    full, budget = set(), total * sum(sizes)
    while True:
        level = (budget - sum(epochs * sizes[i] for i in full)) / max(1e-300, sum(w for i, w in enumerate(weights) if i not in full))
        over = {i for i, w in enumerate(weights) if i not in full and w * level > epochs * sizes[i]}
        if not over:
            return [epochs * s if i in full else w * level for i, (s, w) in enumerate(zip(sizes, weights))]
        full |= over


def test_mixing_reaches_targets(spark):
    r = random.Random(8)
    docs = [(i, "w " * r.randint(0, 30), r.choice(["a", "b", "b", "b", "c", "d", None])) for i in range(900)]
    out = mixing.repetitions(spark.createDataFrame(docs, "doc_id long, text string, source string"), mixing.cycle(mixing.WEIGHTS)).collect()
    names = ["a", "b", "c", "d", None]
    sizes = [sum(len(t.split()) for _, t, s in docs if s == n) for n in names]
    want = dict(zip(names, plain_targets(sizes, [3, 1, 2, 3, 1], 1.5, 2.0)))
    for n in names:
        mine = [x for x in out if x.source == n]
        assert mine[0].target == pytest.approx(want[n])
        assert abs(sum(x["size"] * x.copies for x in mine) - want[n]) <= 30
    assert max(x.copies for x in out) <= 2 and len(out) == len(docs)
    again = mixing.repetitions(spark.createDataFrame(docs[::-1], "doc_id long, text string, source string").repartition(5), mixing.cycle(mixing.WEIGHTS)).collect()
    assert {(x["id"], x.copies) for x in out} == {(x["id"], x.copies) for x in again}


def test_mixing_odd_rows(odd, none):
    out = mixing.mix(odd, copy_col="copy_no")
    assert out.columns == [*odd.columns, "copy_no"]
    assert mixing.mix(none, copy_col="copy_no").count() == 0
    assert {(r["id"], r["size"]) for r in mixing.repetitions(odd, mixing.cycle((1.0,))).collect()} == {(None, 3), (7, 0), (8, 0), (9, 3), (10, 0), (11, 30_000)}


@pytest.mark.parametrize("epochs", [0.5, 1.5, 2.5])
def test_mixing_with_fractional_epochs(spark, epochs):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("one").alias("text"), F.lit("s").alias("source"))
    got = mixing.repetitions(docs, mixing.cycle((1.0,)), total=9.0, epochs=epochs).agg(F.sum("copies"), F.max("copies"), F.first("target")).first()
    assert got[2] == 400 * epochs and abs(got[0] - 400 * epochs) <= 1 and got[1] == int(epochs) + 1
