"""Exact top-k by inner product with a KD-tree per shard.

Vectors become integers floor(256 * x). Candidates are dealt to shards and each
shard builds a KD-tree: median splits of the widest dimension, with the tight
box and the least id of every node. A query walks a tree best first: no inner
product in a box exceeds the sum over dimensions of max(q * low, q * high), so
nodes are taken in order of that bound and the walk ends when it falls below
the kth score found so far.

The kth score is propagated: a first pass searches one pilot shard per block of
queries; all other shards start from the kth score it found and send back only
what can still matter.

Queries and candidates meet as blocks: every block of queries with every shard,
both of bounded size. A vector that is null or has a null or non-finite
component takes no part, as query or candidate. Vectors are compared with
vectors of their own dimension. A candidate with the query's own id is left
out; equal scores go to the smaller id; repeated rows are repeated candidates.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernwork.plans.scale import top_per_group

from .common import saved, table

SHARD, QUERIES, LEAF = 16_384, 2_048, 256
SCALE = 256


class KDTree:
    """Rows in leaf order; node i has children 2 i + 1 and 2 i + 2, unless it is a leaf."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(points))
        self.low, self.high, self.span, self.first, self.leaf = [], [], [], [], []
        self.kids: list[tuple[int, int]] = []
        stack = [(0, len(points), -1, 0)]
        while stack:
            start, end, parent, side = stack.pop()
            rows = order[start:end]
            box = points[rows]
            low, high = box.min(axis=0), box.max(axis=0)
            node = len(self.low)
            self.low.append(low)
            self.high.append(high)
            self.span.append((start, end))
            self.first.append(ids[rows].min())
            self.kids.append((-1, -1))
            if parent >= 0:
                a, b = self.kids[parent]
                self.kids[parent] = (node, b) if side == 0 else (a, node)
            if end - start > leaf:
                wide = int(np.argmax(high - low))
                half = (end - start) // 2
                order[start:end] = rows[np.argpartition(box[:, wide], half)]
                stack.append((start + half, end, node, 1))
                stack.append((start, start + half, node, 0))
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.points, self.ids = points[order], ids[order]

    def search(self, queries: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query's place, id, score) of at most k rows for each query, all with a score of kth or more."""
        bounds = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        out = []
        for at in range(len(queries)):
            q, bound, floor = queries[at], bounds[at], kth[at]
            best: list[tuple[float, int]] = []  # (score, -id), the worst first
            heap = [(-bound[0], 0)]
            while heap:
                over, node = heapq.heappop(heap)
                least = best[0][0] if len(best) == k else floor
                if -over < least:
                    break
                if len(best) == k and -over == least and self.first[node] > -best[0][1]:
                    continue
                a, b = self.kids[node]
                if a >= 0:
                    heapq.heappush(heap, (-bound[a], a))
                    heapq.heappush(heap, (-bound[b], b))
                    continue
                start, end = self.span[node]
                scores = self.points[start:end] @ q
                ids = self.ids[start:end]
                good = np.flatnonzero((scores >= least) & (ids != own[at]))
                if len(good) > k:  # only the best k of a leaf can enter
                    good = good[np.lexsort((ids[good], -scores[good]))[:k]]
                for j in good.tolist():
                    entry = (scores[j], -int(ids[j]))
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
            out += [(at, -i, int(s)) for s, i in best]
        return out


def matrix(values: pd.Series) -> np.ndarray:
    """Rows as doubles where all sums of products are exact, else as Python integers."""
    m = np.array(values.tolist(), dtype=np.float64).reshape(len(values), -1)
    most = np.abs(m).max(initial=0.0)
    return m if most * most * max(1, m.shape[1]) < 2**53 else m.astype(np.int64).astype(object)


def integers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, dim) of the rows that take part."""
    x = F.col(f"`{vector_col}`")
    fine = x.isNotNull() & F.forall(x, lambda c: F.coalesce((F.abs(c.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    return vectors.filter(fine & F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * SCALE)).alias("v"), F.size(x).alias("dim")
    )


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query row (``is_query`` on the id) with all other rows."""
    rows = saved(integers(vectors, id_col, vector_col))
    sizes = rows.agg(F.count("*"), F.count(F.when(is_query(F.col("id")), 1))).first()
    shards, blocks = max(1, -(-sizes[0] // shard)), max(1, -(-sizes[1] // block))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    asked = rows.filter(is_query(F.col("id"))).distinct().withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"))
    schema = "query_id bigint, vec_id bigint, score bigint"

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        tree = KDTree(matrix(right["v"]), right["id"].to_numpy())
        own = left["id"].to_numpy()
        kth = left["kth"].to_numpy(dtype=float, na_value=-np.inf)
        found = tree.search(matrix(left["v"]), own, kth, k)
        return pd.DataFrame([(int(own[a]), i, s) for a, i, s in found], columns=["query_id", "vec_id", "score"]).astype("int64")

    def meet(queries: DataFrame, candidates: DataFrame) -> DataFrame:
        keys = ["dim", "block", "shard"]
        asked, there = (x.toDF(*x.columns) for x in (queries, candidates))  # columns of their own
        return asked.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInPandas(search, schema)

    pilot = F.pmod(F.col("block"), F.lit(shards)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    copies = dealt.withColumn("block", every)
    first = saved(meet(asked.withColumn("shard", pilot).withColumn("kth", F.lit(None).cast("double")), copies.filter(F.col("shard") == pilot)))
    kth = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("kth")).filter(F.col("n") >= k).select(F.col("query_id").alias("q"), "kth")
    known = asked.join(kth, F.col("id") == F.col("q"), "left").drop("q").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter(F.col("shard") != pilot)
    rest = meet(known, copies.filter(F.col("shard") != pilot))
    both = first.unionByName(rest)
    return top_per_group(both, ["query_id"], [F.desc("score"), F.asc("vec_id")], k, "rank").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda i: i % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
