"""Line frequency, prefix trie and ranked search: against plain versions, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fernwork.llm import contraction, lexical, linefreq, trie

DOCS = "doc_id long, text string, source string, n_words int"


# --- line frequency -----------------------------------------------------------------------------------------------


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    hit = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def plain_lines(docs, most, share, least_words, least_share):
    normal = lambda x: re.sub(r"[\x20\x09\x0B-\x0D]+", " ", x).lower().strip(" ")
    held, hosts = defaultdict(set), defaultdict(set)
    for d, text, host in docs:
        hosts[host].add((d, text))
        for x in (text or "").split("\n"):
            if normal(x):
                held[host, normal(x)].add((d, text))
    gone = {k for k, v in held.items() if len(v) > most and len(v) > share * len(hosts[k[0]])}
    out = []
    for d, text, host in docs:
        lines = None if text is None else [x for x in text.split("\n") if (host, normal(x)) not in gone]
        n, left = (sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in t or []) for t in ((text or "").split("\n"), lines))
        out.append((d, None if text is None else "\n".join(lines), n, left, 0 if text is None else text.count("\n") + 1 - len(lines), left < least_words or left < least_share * n))
    return out


def test_line_frequency_against_plain_version(spark):
    r = random.Random(3)
    common = [f"Read  More {i} of this" for i in range(6)]
    docs = []
    for d in range(160):
        own = [" ".join(r.choices("abcdefghij", k=r.randint(0, 12))) for _ in range(r.randint(0, 5))]
        lines = own + [r.choice([x, x.lower(), f"\t{x} "]) for x in r.sample(common, r.randint(0, 4))]
        r.shuffle(lines)
        docs.append((d, "\n".join(lines), r.choice(["one", "one", "two", None])))
    docs += [(200, None, "one"), (201, "", "two"), (None, "read more 1 of this", "one"), (None, "\n \t\n", None), docs[5], docs[5], (5, "other text", "one"), (202, "é ü x\n" * 400, "two")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], DOCS)
    for most, share in ((20, 0.001), (3, 0.3)):
        out = linefreq.judge_lines(frame, most=most, share=share, least_words=4, least_share=0.5)
        assert out.columns == ["doc_id", "text", "source", "n_words", "words_left", "lines_removed", "depleted"]
        got = [(x.doc_id, x.text, x.n_words, x.words_left, x.lines_removed, x.depleted) for x in out.collect()]
        want = plain_lines(docs, most, share, 4, 0.5)
        assert sorted(got, key=repr) == sorted(want, key=repr)
        assert any(x[4] for x in want) and any(x[5] for x in want) and not all(x[5] for x in want)
    assert linefreq.judge_lines(frame.limit(0)).count() == 0


def test_base_counts_against_plain_version(spark):
    r = random.Random(5)
    texts = [None, "", " \n\t", "a", "a b c d e", "a b c d e " * 2, "x " * 40_000, "l\nl\nl \n\nl\n", "#*$%&|<>éé #", "\x0bq\x0cq\r\nq"]
    texts += [" ".join(r.choices("abc", k=r.randint(1, 60))) + "\n" + "a|b\n" * r.randint(0, 3) for _ in range(200)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("base", linefreq.base_counts(F.col("text")))
    assert {x.doc_id: tuple(x.base) for x in frame.select("doc_id", "base").collect()} == {i: plain_counts(t) for i, t in enumerate(texts)}


def test_line_frequency_runs_no_python(spark):
    frame = spark.createDataFrame([(1, "a", "x", 1)], DOCS)
    plan = linefreq.judge_lines(frame.withColumn("base", linefreq.base_counts(F.col("text"))))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- prefix trie --------------------------------------------------------------------------------------------------


def plain_trie(rows, most):
    said = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            said[c].append((turn is not None, turn or 0, role or "", len(text or ""), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in said.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % most if most else 0
        made[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
    members = defaultdict(set)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    out = []
    for node, held in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below) for x in below)
        ends = sorted(c for c in held if len(made[c]) == len(node))
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(held), len(node), min(members[node[:-1]]) if node else None, len(held), len(children), leaves, saved, digest))
    return out


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(seed):
    r = random.Random(seed)
    rows = []
    for c in [*range(0, 30), *range(100, 112), *range(205, 215), -150, -100]:
        for t in range(r.choice([0, 1, 2, 5, 9])):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["a", "bb", "ccc é"])))
    rows += [(300, None, "user", "first"), (300, 0, None, None), (300, 1, "user", "x"), (300, 1, "user", "x"), (None, 1, "user", "lost"), (301, 5, "user", "w " * 5000)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("most", [6, None])
def test_trie_against_plain_version(spark, most):
    rows = conversations(most or 1)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash"))
    got = [tuple(x[k] for k in NODE) for x in trie.prefix_trie(frame, most=most, block=3).collect()]
    assert sorted(got, key=repr) == sorted(plain_trie(rows, most), key=repr)


def test_trie_of_nothing(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(frame, most=6).count() == 0


def test_digest_of_many_ends(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 7)
    ends = spark.range(0, 1000).selectExpr("id % 3 * id % 2 AS conv_id", "2L AS depth", "id - 400 AS c")
    want = defaultdict(list)
    for x in ends.collect():
        want[x.conv_id, x.depth].append(x.c)
    got = {(x.conv_id, x.depth): x.ends_sha256 for x in trie.digests(ends).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in want.items()}


def tree(kind, n=60):
    r = random.Random(n)
    if kind == "chain":
        return [i - 1 if i else None for i in range(n)]
    if kind == "star":
        return [0 if i else None for i in range(n)]
    if kind == "comb":  # a spine with a leg of growing length at each node
        out, spine = [None], 0
        for k in range(8):
            last = spine
            for _ in range(9 - k):
                out.append(last)
                last = len(out) - 1
            out.append(spine)
            spine = len(out) - 1
        return out
    if kind == "forest":
        return [None if i % 13 == 0 else r.randrange(i - i % 13, i) for i in range(n)]
    return [r.randrange(max(0, i - 4), i) if i else None for i in range(n)]


@pytest.mark.parametrize("kind", ["chain", "star", "comb", "forest", "random"])
def test_contraction_against_plain_sums(spark, kind):
    parents = tree(kind)
    r = random.Random(1)
    values = [r.randint(-5, 9) for _ in parents]
    want = list(values)
    for i in reversed(range(len(parents))):
        if parents[i] is not None:
            want[parents[i]] += want[i]
    # the path is a poor hint on purpose
    frame = spark.createDataFrame([(i, p, i % 2, i, v) for i, (p, v) in enumerate(zip(parents, values))], "id long, parent long, path long, level long, v long")
    assert {x.id: x.v for x in contraction.subtree_totals(frame, ["v"], block=4).collect()} == dict(enumerate(want))


# --- ranked search ------------------------------------------------------------------------------------------------


def plain_ranks(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held = [(d, w) for d, t in docs if (w := terms(t))]
    n_docs, total = len(held), sum(len(w) for _, w in held)
    counts = [(d, len(w), Counter(w)) for d, w in held]
    df = Counter(t for _, _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, n, c in counts:
            m = 10 + 90 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, i, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.mark.parametrize("shard, most_items, owners", [(4096, 512, 4), (7, 3, 3), (16, 512, 1)])
def test_ranked_search_against_plain_version(spark, shard, most_items, owners):
    r = random.Random(shard)
    vocabulary = [f"w{i}" for i in range(60)] + ["Élan", "naïve", "Ä", "x9"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, r.choice([" ", "-", "\n"]).join(r.choices(vocabulary, weights, k=r.randint(1, 40)))) for i in range(150)]
    docs += [(None, docs[3][1]), docs[3], docs[3], (900, None), (901, ""), (902, "!?"), (903, "w1 " * 30_000)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(1, 15))).upper()) for i in range(9)] + [(50, None), (51, ""), (52, "unknown"), (None, "w1 w2"), (3, "w5")]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, score int").repartition(3)
    queries = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.ranked(frame, queries, shard=shard, most_items=most_items, owners=owners)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain_ranks(docs, items, 10), key=repr)
    assert lexical.ranked(frame.limit(0), queries).count() == 0 and lexical.ranked(frame, queries.limit(0)).count() == 0
