"""Quality rules: lines that many documents of a host share go, and documents with too little left are rejected.

Lines are compared lower-cased, with white space trimmed and collapsed, by a
64-bit hash of host and line. A line counts once for each document of its host
that holds it; it is removed everywhere on that host if more than ``most``
documents and more than ``share`` of the host's documents hold it. A document
is depleted if fewer than ``least_words`` words or less than ``least_share`` of
its words are left. Everything is a column expression or a shuffle; no Python
worker runs.

Rows of equal id and equal text are one document, also rows with a null id. A
null host is a host of its own. A null text has no words and stays null; blank
lines never count and are never removed for their frequency. A text that loses
all its lines becomes empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, fresh, saved, table

MOST, SHARE = 20, 0.001
LEAST_WORDS, LEAST_SHARE = 10, 0.3
BLANKS = " \t\n\x0b\f\r"
RUN = 5


def words_of(text: Column) -> Column:
    """Runs of characters other than space and \\t \\n \\v \\f \\r; none for null."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(inner) > 0, F.split(inner, r"[\x20\x09-\x0D]+", -1)).otherwise(F.array().cast("array<string>"))


def covered_words(words: Column, run: int = RUN) -> Column:
    """How many words stand in windows of ``run`` words that are found at least twice in the text, the first one included."""

    def places(hashes: Column) -> Column:
        def repeated(s: Column) -> Column:
            same = lambda j, k: F.get(s, j)["h"].eqNullSafe(F.get(s, k)["h"])
            at = F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.when(same(j, j - 1) | same(j, j + 1), F.get(s, j)["i"]))
            return F.sort_array(F.filter(at, lambda i: i.isNotNull()))

        return bound(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), repeated)

    def union(p: Column) -> Column:
        gaps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(run), F.coalesce(b - a, F.lit(run))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def counted(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) < F.size(h), bound(places(h), union)).otherwise(F.lit(0).cast("long"))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - run), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(run)]))
    return F.when(F.size(words) > run, bound(windows, counted)).otherwise(F.lit(0).cast("long"))


def base_counts(text: Column) -> Column:
    """Struct of the text's own figures: words, their characters, symbols, repeated lines, words in repeated windows."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    count = lambda pattern: F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")
    repeats = bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return bound(
        words_of(text),
        lambda words: F.struct(
            F.size(words).cast("long").alias("n_words"),
            (F.coalesce(F.length(text), F.lit(0)) - count(r"[\x20\x09-\x0D]")).cast("long").alias("word_chars"),
            count(r"[#*$%&|<>]").alias("n_symbols"),
            F.when(text.isNull(), 0).otherwise(repeats).cast("long").alias("n_dup_lines"),
            covered_words(words).alias("n_repeat_words"),
        ),
    )


def line_keys(text: Column, host: Column) -> Column:
    """A hash of host and normalised line for each line of the text, null for a blank one."""
    plain = F.lower(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " "))
    return F.transform(F.split(plain, "\n", -1), lambda x: F.when(F.length(F.btrim(x)) > 0, F.xxhash64(host, F.btrim(x))))


def frequent_lines(rows: DataFrame, most: int, share: float) -> DataFrame:
    """``key`` of each line above both limits. ``rows`` has doc, host and text.

    Counting distinct documents shuffles (line, document) pairs first and counts
    of them after, so a line that a third of all documents hold is spread.
    """
    host = F.xxhash64("host")
    pairs = rows.select("doc", host.alias("site"), F.explode(F.array_distinct(line_keys(F.col("text"), F.col("host")))).alias("key")).filter("key IS NOT NULL")
    counts = pairs.groupBy("site", "key").agg(F.count_distinct("doc").alias("n")).filter(F.col("n") > most)
    sizes = rows.groupBy(host.alias("site")).agg(F.count_distinct("doc").alias("docs"))
    return counts.join(sizes, "site").filter(F.col("n") > F.lit(share) * F.col("docs")).select("key")


def judge_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most: int = MOST, share: float = SHARE, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE
) -> DataFrame:
    """``docs`` with frequent lines taken out of their texts, and ``n_words`` (before), ``words_left``, ``lines_removed`` and ``depleted``.

    A column of one of these names comes out under the result's values.
    """
    results = ("n_words", "words_left", "lines_removed", "depleted")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in results or c in (text_col, id_col, host_col)])
    doc, gone, key, n = fresh(docs, "_doc"), fresh(docs, "_gone"), fresh(docs, "_key"), fresh(docs, "_n")
    text, name = F.col(f"`{text_col}`"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    rows = docs.select(name.alias("doc"), F.col(f"`{host_col}`").alias("host"), text.alias("text"))
    frequent = saved(frequent_lines(rows, most, share))
    # one row a line; the words are counted only where a line is frequent
    spread = rows.select("doc", F.posexplode(F.zip_with(line_keys(F.col("text"), F.col("host")), F.split("text", "\n", -1), lambda k, x: F.struct(k.alias("key"), x.alias("line")))).alias("pos", "l"))
    lines = spread.select("doc", "pos", "l.key", F.size(words_of(F.col("l.line"))).alias("words")).filter("key IS NOT NULL")
    hits = lines.join(frequent, "key").groupBy("doc").agg(F.collect_set(F.struct("pos", "words")).alias("gone"))
    hits = hits.select(F.col("doc").alias(key), F.col("gone").alias(gone))
    base = docs.withColumns({doc: name, n: F.size(words_of(text)).cast("long")})
    joined = base.join(hits.hint("merge"), F.col(doc) == F.col(key), "left")
    removed = F.coalesce(F.aggregate(F.col(gone), F.lit(0).cast("long"), lambda a, g: a + g["words"]), F.lit(0))
    kept = lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(f"{gone}.pos")), lambda i: F.get(x, i))
    shorter = F.when(F.col(gone).isNull(), text).otherwise(F.array_join(bound(F.split(text, "\n", -1), kept), "\n"))
    left = F.col(n) - removed
    return joined.select(
        *[shorter.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        F.col(n).alias("n_words"), left.alias("words_left"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("lines_removed"),
        ((left < least_words) | (left < F.lit(least_share) * F.col(n))).alias("depleted"),
    )


def op11(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    counted = docs.withColumn("base", base_counts(F.col("text")))
    c = lambda k: F.col(f"base.{k}")
    failed = (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words"))
    return judge_lines(counted).select(
        "doc_id", "n_words", *[c(k).alias(k) for k in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"), (~failed & ~F.col("depleted")).alias("kept"), "words_left", "lines_removed",
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
r AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, win) AS k
  FROM (SELECT doc_id, p, w[p + 1:p + 5] AS win FROM (SELECT doc_id, w, unnest(range(greatest(0, len(w) - 4))) AS p FROM d))
),
c AS (SELECT doc_id, count(DISTINCT p + q) AS n FROM r, (SELECT unnest(range(5)) AS q) WHERE k > 1 GROUP BY 1),
x AS (SELECT doc_id, source, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM d),
y AS (
  SELECT *, trim(lower(regexp_replace(line, '[\x20\x09\x0B-\x0D]+', ' ', 'g')), ' ') AS plain,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM x WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM y GROUP BY 1),
h AS (SELECT source, count(*) AS docs FROM documents GROUP BY 1),
f AS (SELECT source, plain, count(DISTINCT doc_id) AS n FROM y GROUP BY 1, 2 HAVING n > 20),
g AS (SELECT f.source, f.plain FROM f JOIN h ON h.source IS NOT DISTINCT FROM f.source WHERE n > 0.001 * docs),
v AS (SELECT doc_id, sum(words) AS words, count(*) AS lines FROM y JOIN g ON g.source IS NOT DISTINCT FROM y.source AND g.plain = y.plain GROUP BY 1),
o AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(u.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(w)::BIGINT - coalesce(v.words, 0)::BIGINT AS words_left, coalesce(v.lines, 0)::BIGINT AS lines_removed
  FROM d LEFT JOIN u ON u.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN v ON v.doc_id = d.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words_left, lines_removed,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR words_left < 10 OR words_left < 0.3 * n_words) AS kept
FROM o
"""
