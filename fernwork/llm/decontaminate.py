"""Benchmark decontamination: Wu-Manber search for benchmark passages, over words.

Texts and items are lower-cased (A-Z only) and cut into words of digits,
letters and non-ASCII characters. A pattern is a window of ``window``
consecutive words of an item; a shorter item is one pattern. Patterns of one
length are searched together: a shift table over blocks of two words says how
far the search may jump, patterns with the same last block share a bucket, and
the words of each pattern in the bucket are compared directly.

The patterns are taken in blocks of ``block`` patterns. Each block is one
broadcast of bounded size and one pass over the documents, so a benchmark of
any size is searched whole with bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ITEM_BYTES, binary_texts, fresh, ordinal, saved, slices, table

WINDOW = 10
#: Patterns of one broadcast block; at ten words of about seven bytes, some 30 MB in a Python worker.
BLOCK = 100_000


class WuManber:
    """Search tables for patterns (tuples of words), one set for each pattern length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]]):
        self.items = patterns
        self.groups = []
        by_length: dict[int, list[tuple[bytes, ...]]] = {}
        for p in patterns:
            by_length.setdefault(len(p), []).append(p)
        for m, found in sorted(by_length.items()):
            width = min(2, m)
            shift: dict = {}
            buckets: dict = {}
            for p in found:
                for end in range(width, m + 1):
                    block = p[end - 1] if width == 1 else (p[end - 2], p[end - 1])
                    shift[block] = min(shift.get(block, m), m - end)
                buckets.setdefault(p[-1] if width == 1 else p[-2:], set()).add(p)
            self.groups.append((m, width, m - width + 1, shift, buckets))

    def spans(self, words: list[bytes]) -> list[tuple[int, int, tuple[bytes, ...]]]:
        """Every occurrence as (first word, end, pattern)."""
        out = []
        n = len(words)
        for m, width, far, shift, buckets in self.groups:
            i = m - 1
            get = shift.get
            while i < n:
                block = words[i] if width == 1 else (words[i - 1], words[i])
                jump = get(block, far)
                if jump:
                    i += jump
                    continue
                candidate = tuple(words[i - m + 1 : i + 1])
                if candidate in buckets[block]:
                    out.append((i - m + 1, i + 1, candidate))
                i += 1
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def patterns(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct (words, item) windows of the items; the words space-joined."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, out = batch.column("item").to_pylist(), set()
            for item, text in zip(ids, binary_texts(batch, "text")):
                words = text.translate(ITEM_BYTES).split() if text else []
                for i in range(max(1, len(words) - window + 1) if words else 0):
                    out.add((b" ".join(words[i : i + window]).decode(), item))
            yield pa.RecordBatch.from_pylist([{"words": w, "item": i} for w, i in out], schema=pa.schema([("words", pa.string()), ("item", pa.string())]))

    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    return items.mapInArrow(cut, "words string, item string").distinct()


def search(docs: DataFrame, found: dict[tuple[bytes, ...], set[str]], text_col: str, n_col: str, span_col: str, item_col: str, keep_text: bool) -> DataFrame:
    """Adds the word count, the merged spans of hit words and the items found, by one block of patterns."""
    tables = docs.sparkSession.sparkContext.broadcast(WuManber(found))
    schema = f"{n_col} bigint, {span_col} array<struct<start:int,end:int>>, {item_col} array<string>"
    carried = [c for c in docs.columns if keep_text or c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wm = tables.value
        arrow = pa.schema([(n_col, pa.int64()), (span_col, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), (item_col, pa.list_(pa.string()))])
        for batch in slices(batches, text_col):
            rows = []
            for text in binary_texts(batch, text_col):
                words = text.translate(ITEM_BYTES).split() if text else []
                hits = wm.spans(words) if words else []
                rows.append({
                    n_col: len(words),
                    span_col: [{"start": s, "end": e} for s, e in merged([h[:2] for h in hits])],
                    item_col: sorted(set().union(*(wm.items[h[2]] for h in hits))) if hits else [],
                })
            made = pa.RecordBatch.from_pylist(rows, schema=arrow)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carried] + list(made.columns), names=carried + arrow.names)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in carried]).schema)
    return docs.mapInArrow(run, f"{kept}, {schema}" if kept else schema)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK, keep_text: bool = False) -> DataFrame:
    """For each row of ``docs``: its other columns (the text too with ``keep_text``), ``n_words``, ``spans`` (start, end in words) and ``items``.

    Null and empty texts have no words, an empty benchmark finds nothing,
    repeated rows give repeated rows, item ids are compared as strings (null
    as the empty string) and an item id given twice counts once. Columns named
    like a result column come out under the result's values.
    """
    spark = docs.sparkSession
    results = ("n_words", "spans", "items")
    docs = docs.select(text_col, *[f"`{c}`" for c in docs.columns if c != text_col and c.lower() not in results])
    numbered = ordinal(patterns(benchmark, window, item_id, item_text), [F.col("words"), F.col("item")], "at")
    blocks = [r[0] for r in numbered.select((F.col("at") / block).cast("int").alias("b")).distinct().orderBy("b").collect()] or [0]

    def load(b: int) -> dict[tuple[bytes, ...], set[str]]:
        out: dict[tuple[bytes, ...], set[str]] = {}
        for w, item in numbered.filter((F.col("at") >= b * block) & (F.col("at") < (b + 1) * block)).select("words", "item").toLocalIterator():
            out.setdefault(tuple(w.encode().split(b" ")), set()).add(item)
        return out

    if len(blocks) == 1:
        return search(docs, load(blocks[0]), text_col, *results, keep_text)
    # several blocks: each row's parts are brought together by a number that is fixed by writing the rows
    row = fresh(docs, "_row")
    fixed = saved(docs.withColumn(row, F.monotonically_increasing_id()))
    parts = None
    for b in blocks:
        one = saved(search(fixed.select(row, text_col), load(b), text_col, *results, False))
        parts = one if parts is None else parts.unionByName(one)
    joined = parts.groupBy(row).agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    last = F.col("spans")
    step = lambda acc, s: F.when(
        (F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["end"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(s["end"], F.element_at(acc, -1)["end"]).alias("end")))),
    ).otherwise(F.concat(acc, F.array(s)))
    joined = joined.withColumn("spans", F.aggregate(F.array_sort(last), F.array().cast("array<struct<start:int,end:int>>"), step))
    return (fixed if keep_text else fixed.drop(text_col)).join(joined, row).drop(row)


def hit_words(spans) -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, in their own columns."""
    clash = {c: f"_kept{i}" for i, c in enumerate(docs.columns) if c.lower() in ("n_words", "spans", "items")}
    kept = find(docs.withColumnsRenamed(clash), benchmark, keep_text=True, **options).filter(F.size("spans") == 0)
    return kept.select(*[F.col(f"`{clash.get(c, c)}`").alias(c) for c in docs.columns])


def op2(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = hit_words(F.col("spans"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> dict:
    """Plain check for tests: every window compared at every position."""
    cut = lambda t: (t or "").encode().translate(ITEM_BYTES).split()
    windows = [(str(i), w[k : k + window]) for i, t in items for w in [cut(t)] if w for k in range(max(1, len(w) - window + 1))]
    out = {}
    for d, t in docs:
        words, hit, found = cut(t), set(), set()
        for item, w in windows:
            for k in range(len(words) - len(w) + 1):
                if words[k : k + len(w)] == w:
                    hit |= set(range(k, k + len(w)))
                    found.add(item)
        out[d] = (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, w[i + 1:i + 10] AS win FROM (SELECT item, w, unnest(range(greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
l AS (SELECT DISTINCT len(win) AS n FROM p),
x AS (SELECT doc_id, n, i, w[i + 1:i + n] AS win FROM (SELECT doc_id, w, n, unnest(range(greatest(0, len(w) - n + 1))) AS i FROM d, l)),
h AS (SELECT doc_id, i, n, item FROM x JOIN p ON p.win = x.win),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM h) GROUP BY 1),
t AS (SELECT doc_id, list(item ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
