"""Line dedup: repeated windows of consecutive lines are removed after their first occurrence.

Windows of ``window`` consecutive lines overlap. Each is hashed; a window that
occurs more than once anywhere keeps its occurrence with the least (id,
position), and the lines that its later occurrences cover are removed, covered
positions being merged within a document. Every removed line therefore stands
once more earlier, in a document or at a place that keeps it.

A text is cut at each line feed, lines are compared exactly, and windows of
blank lines only don't count. A null text stays null; a text of fewer lines
than a window is kept whole, unless ``short`` makes it a window of its own that
repeats among texts of just these lines (the pipeline does). Rows with equal id and equal text count as one
document: equal places of theirs are one occurrence. Rows with one id and other
texts are ordered by a hash of the text. A null id sorts before all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, fresh, saved, table

WINDOW = 3


def line_windows(text: Column, window: int, short: bool = False) -> Column:
    """(pos, h1, h2) of each window; two 64-bit hashes make chance meetings of different windows negligible."""

    def of(lines: Column) -> Column:
        places = F.when(F.size(lines) >= window, F.sequence(F.lit(0), F.size(lines) - window))
        at = lambda i, seed: F.xxhash64(F.lit(seed), *[F.get(lines, i + k) for k in range(window)])
        some = lambda i: F.exists(F.slice(lines, i + 1, F.lit(window)), lambda x: F.length(F.trim(x)) > 0)
        found = F.transform(F.filter(places, some), lambda i: F.struct(i.alias("pos"), at(i, 1).alias("h1"), at(i, 2).alias("h2")))
        if not short:
            return found
        own = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(F.lit(3), lines).alias("h1"), F.xxhash64(F.lit(4), lines).alias("h2")))
        return F.when(F.size(lines) >= window, found).when(F.exists(lines, lambda x: F.length(F.trim(x)) > 0), own)

    return bound(F.split(text, "\n", -1), of)


def covered(rows: DataFrame, window: int, short: bool = False) -> DataFrame:
    """(id, same, starts): where in each document later occurrences of repeated windows begin. ``rows`` has id, same and text."""
    spread = rows.select("id", "same", F.explode(line_windows(F.col("text"), window, short)).alias("w")).select("id", "same", "w.pos", "w.h1", "w.h2")
    # one row per window, combined before the shuffle; a written table, so that hot windows split in the join
    again = spread.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("id", "same", "pos")).alias("first")).filter("n > 1").select("h1", "h2", "first")
    later = spread.join(saved(again), ["h1", "h2"]).filter(~F.struct("id", "same", "pos").eqNullSafe(F.col("first")))
    return later.groupBy("id", "same").agg(F.array_sort(F.collect_set("pos")).alias("starts"))


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None, short: bool = False) -> DataFrame:
    """``docs`` with the repeated lines taken out of their texts; other columns pass unchanged.

    A text that loses all its lines becomes empty. ``removed_col`` names a
    further column for the number of removed lines. ``short``: a text of fewer
    lines than a window is one window of its own.
    """
    starts, key, twin = fresh(docs, "_starts"), fresh(docs, "_key"), fresh(docs, "_twin")
    doc, same = F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`"))
    hits = covered(docs.select(doc.alias("id"), same.alias("same"), F.col(f"`{text_col}`").alias("text")), window, short)
    hits = hits.select(F.col("id").alias(key), F.col("same").alias(twin), F.col("starts").alias(starts))
    joined = docs.join(hits.hint("merge"), doc.eqNullSafe(F.col(key)) & (same == F.col(twin)), "left")
    gone = F.array_distinct(F.flatten(F.transform(F.col(starts), lambda p: F.sequence(p, p + window - 1))))
    kept = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i))
    shorter = F.array_join(bound(F.split(F.col(f"`{text_col}`"), "\n", -1), kept), "\n")
    text = F.when(F.col(starts).isNull(), F.col(f"`{text_col}`")).otherwise(shorter)
    out = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if removed_col:
        out.append(F.when(F.col(starts).isNull(), F.lit(0)).otherwise(F.least(F.size(gone), F.size(F.split(F.col(f"`{text_col}`"), "\n", -1)))).cast("long").alias(removed_col))
    return joined.select(*out)


def with_length(docs: DataFrame, text_col: str, n_col: str) -> DataFrame:
    """``n_col`` set anew to the number of characters of the text, in its own type and place."""
    n = F.length(F.col(f"`{text_col}`")).cast(docs.schema[n_col].dataType)
    return docs.select(*[n.alias(c) if c == n_col else F.col(f"`{c}`") for c in docs.columns])


def op1(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs, removed_col="n_removed")


ORACLE = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (
  SELECT doc_id, p, lines[p + 1] AS a, lines[p + 2] AS b, lines[p + 3] AS c
  FROM (SELECT doc_id, lines, unnest(range(0, greatest(0, len(lines) - 2))) AS p FROM l)
),
v AS (SELECT * FROM w WHERE trim(a, ' ') <> '' OR trim(b, ' ') <> '' OR trim(c, ' ') <> ''),
f AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS k FROM v),
g AS (SELECT DISTINCT doc_id, p + d AS pos FROM f, (SELECT unnest([0, 1, 2]) AS d) WHERE k > 1),
x AS (SELECT doc_id, list(pos) AS gone FROM g GROUP BY doc_id)
SELECT l.doc_id,
  CASE WHEN x.gone IS NULL THEN l.text
       ELSE array_to_string(list_transform(list_filter(range(0, len(lines)), lambda i: NOT list_contains(x.gone, i)), lambda i: lines[i + 1]), chr(10)) END AS text,
  coalesce(len(x.gone), 0)::BIGINT AS n_removed
FROM l LEFT JOIN x ON l.doc_id = x.doc_id
"""
