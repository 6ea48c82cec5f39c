"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns (role and text); its members are
the conversations that begin with it. A node is named by its smallest member
and its depth. The trie is built without holding a conversation in one task:
each turn becomes two 64-bit hashes of its place, role and text, and running
xors of them name the prefixes, taken in blocks of turns.

Turns are ordered by ``turn``, null first; equal ones by role, length and hash
of the text, and repeated rows are repeated turns. Null role and text are
empty. Rows with a null conversation id take no part. No conversations, no
nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernwork.plans.scale import distributed_rank

from .common import saved, table
from .contraction import subtree_totals

#: Turns whose running hashes one task takes together, and ids of one piece of a digest's text.
BLOCK, PIECE = 1024, 8192


def turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, pos, n, h1, h2, chars): each turn's place from 1, the number of turns and what it holds."""
    who, said = F.coalesce(F.col(f"`{role}`"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    cols = [F.xxhash64(F.lit(k), who, said).alias(f"h{k}") for k in (1, 2)]
    narrow = rows.filter(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("c"), F.col(f"`{turn}`").alias("turn"), who.alias("who"), F.length(said).cast("long").alias("chars"), *cols
    )
    order = [F.asc_nulls_first("turn"), F.col("who"), F.col("chars"), F.col("h1"), F.col("h2")]
    return distributed_rank(narrow, ["c"], order, "pos", "n").select("c", "pos", "n", "h1", "h2", "chars")


def rebuilt(own: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their hundred: (c, length) and their turns (c, depth, h1, h2, chars).

    Conversation c takes the first h turns of c - c % 100 and its own turns
    after its first h, with h = crc32(c) % ``most``.
    """
    h = lambda c: (F.crc32(F.col(c).cast("string")) % most).cast("long")
    sizes = own.filter("pos = 1").select("c", "n")
    heads = own.filter(f"pos < {most} AND c % 100 = 0")
    convs = saved(
        sizes.withColumns({"base": F.col("c") - F.col("c") % 100, "h": h("c")})
        .join(sizes.select(F.col("c").alias("base"), F.col("n").alias("first")), "base", "left")
        .select("c", "base", "h", F.least("h", F.coalesce("first", F.lit(0))).alias("taken"), "n")
        .withColumn("length", F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    )
    shared = convs.join(heads.select(F.col("c").alias("base"), "pos", "h1", "h2", "chars"), "base").filter("pos <= h").select("c", F.col("pos").alias("depth"), "h1", "h2", "chars")
    rest = own.filter(F.col("pos") > h("c")).join(convs.select("c", "h", "taken"), "c").select("c", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "h1", "h2", "chars")
    return convs.select("c", "length"), shared.unionByName(rest)


def prefixes(convs: DataFrame, said: DataFrame, block: int = BLOCK) -> DataFrame:
    """(c, length, depth, f1, f2, p1, p2, chars): each prefix's fingerprint and that of its parent; depth 0 for every conversation."""
    marks = said.select("c", "depth", "chars", *[F.xxhash64(F.lit(k), "depth", "h1", "h2").alias(f"x{k}") for k in (1, 2)], F.floor(F.col("depth") / block).alias("block"))
    marks = saved(marks)
    before = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = marks.groupBy("c", "block").agg(*[F.bit_xor(f"x{k}").alias(f"x{k}") for k in (1, 2)])
    start = whole.select("c", "block", *[F.bit_xor(f"x{k}").over(before).alias(f"b{k}") for k in (1, 2)]).filter("block > 0 AND b1 IS NOT NULL")
    run = Window.partitionBy("c", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    runs = marks.select("c", "block", "depth", "chars", "x1", "x2", *[F.bit_xor(f"x{k}").over(run).alias(f"r{k}") for k in (1, 2)]).join(start, ["c", "block"], "left")
    f = [F.col(f"r{k}").bitwiseXOR(F.coalesce(f"b{k}", F.lit(0))) for k in (1, 2)]
    named = runs.select("c", "depth", *[x.alias(f"f{k}") for k, x in enumerate(f, 1)], *[x.bitwiseXOR(F.col(f"x{k}")).alias(f"p{k}") for k, x in enumerate(f, 1)], "chars")
    zero = F.lit(0).cast("long")
    roots = convs.select("c", "length", *[zero.alias(x) for x in ("depth", "f1", "f2", "p1", "p2", "chars")])
    return named.join(convs, "c").select("c", "length", "depth", "f1", "f2", "p1", "p2", "chars").unionByName(roots)


def digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256): the SHA-256 of each node's ending conversations, in order and comma-joined.

    Ids are first joined to pieces where they lie sorted; then one task takes
    a node's pieces one after another, holding one piece and the state of the hash.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        rows: list[tuple] = []
        names = ["conv_id", "depth", "first", "ids"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        made = lambda: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)
        for batch in batches:
            for m, d, c in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "depth", "c"))):
                if (m, d) != node or len(ids) >= PIECE:
                    if ids:
                        rows.append((*node, ids[0], ",".join(map(str, ids))))
                    node, ids = (m, d), []
                ids.append(c)
            if len(rows) >= PIECE:
                yield made()
                rows.clear()
        if ids:
            rows.append((*node, ids[0], ",".join(map(str, ids))))
        if rows:
            yield made()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))], names=["conv_id", "depth", "ends_sha256"])
        for batch in batches:
            rows = []
            for m, d, ids in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "depth", "ids"))):
                if (m, d) != node:
                    if node:
                        rows.append((*node, state.hexdigest()))
                    node, state = (m, d), hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            if rows:
                yield made(rows)
        if node:
            yield made([(*node, state.hexdigest())])

    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = ends.repartitionByRange(n, "conv_id", "depth", "c").sortWithinPartitions("conv_id", "depth", "c").mapInArrow(pack, "conv_id long, depth long, first long, ids string")
    return pieces.repartition(n, "conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(digest, "conv_id long, depth long, ends_sha256 string")


def trie(convs: DataFrame, said: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    ``convs`` has c (unique) and length, ``said`` the turns: c, depth from 1 without gaps, h1, h2 and chars.
    """
    rows = saved(prefixes(convs, said, block))
    longest = F.max(F.struct("length", (-F.col("c")).alias("back")))  # a path along which chains lie
    nodes = saved(
        rows.groupBy("depth", "f1", "f2")
        .agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), longest.alias("path"))
        .select("depth", "f1", "f2", "p1", "p2", "conv_id", "n_convs", "chars", F.col("path.back").alias("path"))
    )
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    tree = saved(nodes.filter("depth > 0").join(above, ["depth", "p1", "p2"]).unionByName(nodes.filter("depth = 0"), allowMissingColumns=True))
    kids = tree.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    tree = saved(tree.join(kids, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    totals = subtree_totals(
        tree.select(
            F.struct("conv_id", "depth").alias("id"), F.when(F.col("depth") > 0, F.struct(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))).alias("parent"), "path",
            F.col("depth").alias("level"), (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
        ),
        ["n_leaves", "saved_tokens"], block,
    ).select("id.conv_id", "id.depth", "n_leaves", "saved_tokens")
    ends = rows.filter("depth = length").select("c", "depth", "f1", "f2").join(nodes.select("depth", "f1", "f2", "conv_id"), ["depth", "f1", "f2"]).select("conv_id", "depth", "c")
    out = tree.join(totals, ["conv_id", "depth"]).join(digests(ends), ["conv_id", "depth"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )


def prefix_trie(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most: int | None = None, block: int = BLOCK) -> DataFrame:
    """The trie of conversations given as rows of turns; with ``most``, of those that ``rebuilt`` makes of them."""
    own = saved(turns(rows, conv, turn, role, text))
    if most:
        return trie(*rebuilt(own, most), block)
    return trie(own.filter("pos = 1").select("c", F.col("n").alias("length")), own.select("c", F.col("pos").alias("depth"), "h1", "h2", "chars"), block)


def op12(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"), most=6)


ORACLE = r"""
WITH o AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), length(coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
),
s AS (SELECT c, count(*) AS n FROM o GROUP BY 1),
k AS (
  SELECT c, n, c - c % 100 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: xor(p >> 1, (p & 1) * 3988292384))), 4294967295::BIGINT) % 6 AS h
  FROM s
),
b AS (SELECT k.*, least(h, coalesce(t.n, 0)) AS taken FROM k LEFT JOIN s t ON t.c = k.base),
r AS (
  SELECT b.c, o.pos AS d, role, text FROM b JOIN o ON o.c = b.base AND o.pos <= b.h
  UNION ALL
  SELECT b.c, taken + o.pos - h, role, text FROM b JOIN o ON o.c = b.c AND o.pos > b.h
),
p AS (
  SELECT c, d, length(text) AS chars, sha256(string_agg(length(role) || ':' || role || ':' || length(text) || ':' || text, '|') OVER (PARTITION BY c ORDER BY d)) AS prefix FROM r
  UNION ALL SELECT c, 0, 0, '' FROM k
),
n AS (SELECT d, prefix, min(c) AS conv_id, count(*) AS n_convs, min(chars) AS chars FROM p GROUP BY 1, 2),
m AS (SELECT p.c, p.d, n.conv_id FROM p JOIN n ON n.d = p.d AND n.prefix = p.prefix),
q AS (SELECT n.conv_id, n.d, n_convs, chars, m.conv_id AS up FROM n LEFT JOIN m ON m.c = n.conv_id AND m.d = n.d - 1),
w AS (SELECT up AS conv_id, d - 1 AS d, count(*) AS n FROM q WHERE d > 0 GROUP BY 1, 2),
v AS (SELECT q.*, coalesce(w.n, 0) AS kids FROM q LEFT JOIN w ON w.conv_id = q.conv_id AND w.d = q.d),
t AS (
  SELECT m.conv_id, m.d, sum((kids = 0)::INT) AS leaves, sum((n_convs - 1) * chars) AS saved
  FROM v JOIN m ON m.c = v.conv_id AND m.d <= v.d GROUP BY 1, 2
),
e AS (SELECT m.conv_id, m.d, sha256(string_agg(m.c::VARCHAR, ',' ORDER BY m.c)) AS sha FROM m JOIN (SELECT c, max(d) AS d FROM p GROUP BY 1) z ON z.c = m.c AND z.d = m.d GROUP BY 1, 2)
SELECT v.conv_id, v.d::BIGINT AS depth, up AS parent_conv_id, n_convs, kids AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM v JOIN t ON t.conv_id = v.conv_id AND t.d = v.d LEFT JOIN e ON e.conv_id = v.conv_id AND e.d = v.d
"""
