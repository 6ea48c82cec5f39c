"""Ranked lexical search by pipelined term partitioning.

The terms of a bundle of items are dealt to ``owners`` term owners, the rarest
terms to the first. The bundle goes through the owners one after another: each
stage cogroups the bundle's sparse accumulators (item, document, score) with
the postings of its owner and adds integer contributions; the last one selects.
Documents are cut into shards of bounded size, so the postings of a term that
stands in a third of all documents are spread, and a bundle has one set of
accumulators for each shard.

A stage drops an accumulator only if it can't matter: its score and the most
that later owners can add lie below the shard's k-th score so far, so k better
documents stand in its own shard. Results are exact.

The score of a document for an item is, over the item's distinct terms, the sum
of w * ((1000000000 * tf) div (1000 * tf + 8 * m)) with w = floor(1000 *
ln((2 * N + 2) / (2 * df + 1))) and m = 10 + (90 * n * N) div L: N counts the
documents with a term, L all terms, n those of the document.

Each row of the documents ranks by itself, also a repeated one; a null id comes
last among equal scores. Null and empty texts have no term, count nowhere and
rank nowhere. Each row of the items is an item by itself, so a repeated one has
repeated results; one without terms has none. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernwork.plans.scale import top_per_group

from .common import ITEM_BYTES, binary_texts, fresh, ordinal, saved, slices, table

K = 10
#: Documents of a shard and items of a bundle: a task holds a score of eight bytes for each pair of them, 16 MB.
SHARD, ITEMS = 4096, 512
#: A bundle is closed at so many terms, and a shard at so many postings.
TERMS, POSTINGS = 100_000, 2_000_000
OWNERS = 4
BUNDLE = pa.schema([("shard", pa.string()), ("item", pa.binary()), ("doc", pa.binary()), ("score", pa.binary())])


class Bundle:
    """Terms of some items: numbers of the terms and, once the corpus is counted, weights and owners."""

    def __init__(self, ids: list, terms: list[list[bytes]]):
        self.ids = ids
        self.number: dict[bytes, int] = {}
        holders: list[list[int]] = []
        for i, found in enumerate(terms):
            for t in found:
                if self.number.setdefault(t, len(holders)) == len(holders):
                    holders.append([])
                holders[self.number[t]].append(i)
        self.holders = [np.array(h) for h in holders]

    def weigh(self, df: np.ndarray, docs: int, total: int, owners: int) -> None:
        self.docs, self.total = docs, total
        self.weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(n) + 1))) for n in df], np.int64)
        # rarest terms first; each owner has about the same number of postings
        order = np.argsort(df, kind="stable")
        self.owner = np.zeros(len(df), np.int32)
        run = np.cumsum(df[order])
        self.owner[order] = np.minimum(owners - 1, (run - 1) * owners // max(1, int(run[-1]))) if len(df) else 0
        self.rest = np.zeros((owners, len(self.ids)), np.int64)  # most that the owners behind a stage can add, by item, for a part of one
        for t, held in enumerate(self.holders):
            self.rest[: self.owner[t], held] += max(0, self.weight[t])


def bundles(items: DataFrame, id_col: str, text_col: str, most_items: int, most_terms: int) -> Iterator[Bundle]:
    """The items in bundles of bounded size, read one after another."""
    rows = ordinal(items.select(F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").alias("text")), [F.col("item_id"), F.col("text")], "at")
    ids, terms, n = [], [], 0
    for row in rows.select("item_id", "text").orderBy("at").toLocalIterator():
        found = sorted(set((row.text or "").encode().translate(ITEM_BYTES).split()))
        if ids and (len(ids) >= most_items or n + len(found) > most_terms):
            yield Bundle(ids, terms)
            ids, terms, n = [], [], 0
        ids, terms, n = [*ids, row.item_id], [*terms, found], n + len(found)
    if n:
        yield Bundle(ids, terms)


def postings(docs: DataFrame, number: dict[bytes, int], shard: int) -> DataFrame:
    """A row for each shard: ids, lengths and (doc, term, tf) of its documents; ``docs`` and ``terms`` count all documents read, also those without an item's term."""
    shared = docs.sparkSession.sparkContext.broadcast(number)
    arrow = pa.schema([("shard", pa.string()), *((c, pa.binary()) for c in ("ids", "missing", "n", "doc", "term", "tf")), ("docs", pa.int64()), ("terms", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, task = shared.value.get, TaskContext.get().partitionId()
        ids, lengths, doc, term, tf = [], [], [], [], []
        k = held = seen = total = 0

        def row() -> pa.RecordBatch:
            part = lambda x, kind: np.concatenate(x).astype(kind).tobytes() if x else b""
            known = np.array([0 if i is None else i for i in ids], np.int64).tobytes()
            values = [f"{task}-{k}", known, np.array([i is None for i in ids], bool).tobytes(), np.array(lengths, np.int64).tobytes(), part(doc, np.int32), part(term, np.int32), part(tf, np.int64), seen, total]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow)], schema=arrow)

        for batch in slices(batches, "text"):
            for i, text in zip(batch.column("id").to_pylist(), binary_texts(batch, "text")):
                words = text.translate(ITEM_BYTES).split() if text else []
                if not words:
                    continue
                seen, total = seen + 1, total + len(words)
                at = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
                at = at[at >= 0]
                if len(at):
                    t, c = np.unique(at, return_counts=True)
                    doc.append(np.full(len(t), len(ids)))
                    term.append(t)
                    tf.append(c)
                    ids.append(i)
                    lengths.append(len(words))
                    held += len(t)
                if len(ids) >= shard or held >= POSTINGS:
                    yield row()
                    k, held, seen, total = k + 1, 0, 0, 0
                    ids, lengths, doc, term, tf = [], [], [], [], []
        if seen:
            yield row()

    return docs.mapInArrow(cut, "shard string, ids binary, missing binary, n binary, doc binary, term binary, tf binary, docs bigint, terms bigint")


def document_frequencies(rows: DataFrame, n_terms: int) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                df += np.bincount(np.frombuffer(blob, np.int32), minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at])], names=["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for row in rows.select("term").mapInArrow(count, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[row.term] = row.df
    return out


def dealt(rows: DataFrame, bundle, owners: int) -> DataFrame:
    """The postings by owner: columns doc<s>, term<s>, part<s>; and ``most``, the largest part of each document."""
    names = ["shard", "ids", "missing", "most", *[f"{c}{s}" for s in range(owners) for c in ("doc", "term", "part")]]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bundle.value
        for batch in batches:
            for r in batch.to_pylist():
                doc, term, tf = np.frombuffer(r["doc"], np.int32), np.frombuffer(r["term"], np.int32), np.frombuffer(r["tf"], np.int64)
                # Python's numbers: 90 * n * N may pass 64 bits
                m = np.array([10 + 90 * int(n) * b.docs // b.total for n in np.frombuffer(r["n"], np.int64)], np.int64)
                part = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
                most = np.zeros(len(m), np.int64)
                np.maximum.at(most, doc, part)
                order = np.lexsort((doc, term, b.owner[term]))
                edges = np.searchsorted(b.owner[term[order]], np.arange(owners + 1))
                cut = [order[i:j] for i, j in zip(edges[:-1], edges[1:])]
                values = [r["shard"], r["ids"], r["missing"], most.tobytes(), *[x[o].tobytes() for o in cut for x in (doc, term, part)]]
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=names)

    return rows.select("shard", "ids", "missing", "n", "doc", "term", "tf").mapInArrow(deal, ", ".join(f"{n} {'string' if n == 'shard' else 'binary'}" for n in names))


def added(held: pa.Table, owned: dict, b: Bundle) -> np.ndarray:
    """Scores (item, document) of a bundle after the contributions of one owner."""
    scores = np.zeros((len(b.ids), len(owned["ids"]) // 8), np.int64)
    for r in held.to_pylist():
        scores[np.frombuffer(r["item"], np.int32), np.frombuffer(r["doc"], np.int32)] = np.frombuffer(r["score"], np.int64)
    doc, term, part = np.frombuffer(owned["doc"], np.int32), np.frombuffer(owned["term"], np.int32), np.frombuffer(owned["part"], np.int64)
    edges = np.flatnonzero(np.diff(term, prepend=-1, append=-1)) if len(term) else []
    for i, j in zip(edges[:-1], edges[1:]):
        t = term[i]
        scores[np.ix_(b.holders[t], doc[i:j])] += b.weight[t] * part[i:j]
    return scores


def stage(bundle, s: int, k: int):
    """Cogroup function of owner ``s`` but the last: accumulators in, accumulators out."""

    def run(held: pa.Table, owned: pa.Table) -> pa.Table:
        b = bundle.value
        rows = []
        for r in owned.to_pylist():
            scores = added(held, r, b)
            most = np.frombuffer(r["most"], np.int64)
            keep = scores > 0
            if scores.shape[1] > k:
                kth = np.partition(scores, -k, axis=1)[:, -k]
                keep &= scores + b.rest[s][:, None] * most[None, :] >= kth[:, None]
            item, doc = np.nonzero(keep)
            rows.append({"shard": r["shard"], "item": item.astype(np.int32).tobytes(), "doc": doc.astype(np.int32).tobytes(), "score": scores[keep].tobytes()})
        return pa.Table.from_pylist(rows, schema=BUNDLE)

    return run


def selection(bundle, k: int, arrow: pa.Schema):
    """Cogroup function of the last owner: the shard's k best documents of each item."""

    def run(held: pa.Table, owned: pa.Table) -> pa.Table:
        out = {"item": [], "doc_id": [], "score": []}
        for r in owned.to_pylist():
            scores = added(held, r, bundle.value)
            ids, missing = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["missing"], bool)
            for i, row in enumerate(scores):
                at = np.flatnonzero(row > 0)
                if len(at) > k:
                    at = at[row[at] >= np.partition(row[at], -k)[-k]]
                at = at[np.lexsort((ids[at], missing[at], -row[at]))[:k]]
                out["item"] += [i] * len(at)
                out["doc_id"] += [None if missing[d] else int(ids[d]) for d in at]
                out["score"] += row[at].tolist()
        return pa.Table.from_pydict(out, schema=arrow)

    return run


def ranked(
    docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    owners: int = OWNERS, shard: int = SHARD, most_items: int = ITEMS, most_terms: int = TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, columns named after the inputs. ``id_col`` is of an integer type.

    The documents are read once for each bundle of items.
    """
    spark = docs.sparkSession
    kind = items.schema[item_id].dataType.simpleString()
    out_item = item_id if item_id.lower() not in (id_col.lower(), "rank", "score") else fresh(docs, f"{item_id}_of_item")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    arrow = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])
    found = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for b in bundles(items, item_id, item_text, most_items, most_terms):
        rows = saved(postings(texts, b.number, shard))
        size = rows.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
        if not size.docs:
            continue
        b.weigh(document_frequencies(rows, len(b.number)), size.docs, size.terms, owners)
        bundle = spark.sparkContext.broadcast(b)
        owned = saved(dealt(rows, bundle, owners))
        none = F.lit(b"")
        held = owned.select("shard", none.alias("item"), none.alias("doc"), none.alias("score"))
        for s in range(owners):
            mine = owned.select("shard", "ids", "missing", "most", *[F.col(f"{c}{s}").alias(c) for c in ("doc", "term", "part")]).groupBy("shard")
            meeting = held.groupBy("shard").cogroup(mine)
            held = meeting.applyInArrow(stage(bundle, s, k), "shard string, item binary, doc binary, score binary") if s < owners - 1 else meeting.applyInArrow(selection(bundle, k, arrow), "item int, doc_id bigint, score bigint")
        best = top_per_group(held, ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], k, rank="rank")
        names = spark.createDataFrame(list(enumerate(b.ids)), f"item int, item_id {kind}")
        found = found.unionByName(best.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return found.select(F.col("item_id").alias(out_item), "rank", F.col("doc_id").alias(id_col), "score")


def op13(spark, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*) AS big_n, sum(len(w))::BIGINT AS big_l FROM d WHERE len(w) > 0),
t AS (SELECT doc_id, term, any_value(n) AS n, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY 1, 2),
f AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
g AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM f, s),
c AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score
  FROM i JOIN g USING (term) JOIN t USING (term), s GROUP BY 1, 2
),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
