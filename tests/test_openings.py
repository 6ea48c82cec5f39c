"""Scores read the beginning of a page where that is all they need, and count words once."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fernwork.functions import html as hx
from fernwork.functions import text as tx
from fernwork.operators import extract as ex
from fernwork.operators import scoring as sc
from fernwork.plans.scale import upper_median


def test_site_median_counts_words_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def read(x):
        seen.add(1)
        return x

    rows = spark.createDataFrame([("a", i) for i in range(9)], "site_id string, w long")
    rows = rows.withColumn("w", F.udf(read, "long").asNondeterministic()("w"))
    assert upper_median(rows, ["site_id"], "w", "m").first()["m"] == 4
    assert seen.value == 9


def test_trust_metadata_takes_named_fields_only(spark):
    df = spark.createDataFrame([('<meta property="og:title" content="x">',)], "h string")
    assert df.select(ex.trust_metadata(F.col("h"), "has_og_tags").alias("t")).first()["t"].asDict() == {"has_og_tags": True}


PAGES = [
    None, "", "plain", "a <b", "<p>" + "w &amp; x " * 40, "<p>word</p>" * 60, "<p>&nbsp;&amp;lt; x</p>" * 60,
    "<p>a</p>" * 30 + "<script>" + "x<p>y</p>" * 90 + "</script>tail" + "<i>z</i>" * 90,
    "<scr<script></script>ipt>" + "<p>in</p>" * 90 + "</script>" + "<p>out</p>" * 90,
    "<p>a</p><style><script></style>" + "<p>b</p>" * 80 + "</script>c</style>" + "<p>d</p>" * 80,
    "<!-- " + "<p>hidden</p>" * 80 + " --><p>shown</p>" + "<p>more</p>" * 80,
    "<p>a</p> x<sty<script>1</script>" + "<p>b</p>" * 60 + "le>c</style>" + "<p>d</p>" * 80, "  \n\t " * 90 + "<p>late</p>" * 90, "<>" * 200 + "<p>e</p>" * 90,
]


@pytest.mark.parametrize("n", [1, 10, 25, 60])
def test_opening_text_is_that_of_the_whole_page(spark, n):
    df = spark.createDataFrame([(p,) for p in PAGES], "h string")
    rows = df.select(hx.opening_text(F.col("h"), n).alias("a"), F.left(hx.visible_text(F.col("h")), F.lit(n)).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]


def test_first_tokens(spark):
    texts = ["", " ", "a", " a b", "a b c", "  a  b c d ", "a\nb\tc d e", None]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    for n in (1, 2, 3, 10):
        rows = df.select(tx.first_tokens(F.col("t"), n).alias("a"), F.slice(tx.tokens(F.col("t")), 1, n).alias("b")).collect()
        assert [r.a for r in rows] == [r.b for r in rows]


def test_look_ahead_leaves_counts(spark):
    text = "In our testing WE FOUND 45% of 1200 users, 3 out of 4. According to our data: $5, 12.5 or 3 million. Proprietary data, our team; When I, based on our, by 7 in 9"
    df = spark.createDataFrame([(text,), ("Our study, IN PRACTICE i've been, we analyzed 20,000 brands",)], "t string")
    for chars, p in (("wiob", sc.FIRST_PERSON), (r"\daiowp", sc.STATS), (r"\d$", sc.DATA_POINT)):
        for r in df.select(tx.count_matches(F.col("t"), p).alias("a"), tx.count_matches(F.col("t"), sc._beginning(chars, p)).alias("b")).collect():
            assert r.a == r.b and (r.a > 0)


def test_entities_of_any_length(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["A", "Ab", "Abc", "b", "B9", " ", " ", "  ", "\n", "é", "."]) for _ in range(n)) for n in [*range(40), 400, 4000]]
    texts += ["Ab Cd Ef9", "Ab Cd  Ef Gh", "Ab Cd", "Ab Cd ", "aAb CdE f", "", None]
    long = ["Abcd " * 200_000, "Abcd " * 200_000 + "efg", "x. " + "Ab\n" * 5_000 + "9 Cd Ef"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts + long)], "i int, t string")
    got = [r.n for r in rows.select("i", sc._entities(F.col("t")).alias("n")).sort("i").collect()]
    assert got == [len(re.findall(sc.ENTITY, x or "", re.A)) for x in texts] + [1, 1, 2] and max(got) > 20


def test_citability_of_a_text_in_capitals(spark):
    text = "Abcd Efgh " * 10_000
    df = spark.createDataFrame([(1, text, f"<p>{text}</p>")], "post_id int, body_text string, body_html string")
    assert sc.citability(df).first()["cite_score"] == 0


def test_dates_and_sources_behind_a_look_ahead(spark):
    months = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
    texts = [f"x {m.lower() if i % 2 else m}. {i + 1}, 2023" for i, m in enumerate(months)]
    texts += [f"{w} : 2023-01-0{i}" for i, w in enumerate("Published posted UPDATED modified".split(), 1)] + ["Last updated 1/2/2023", "updated on: May 4 2022", "x 5/5/2022"]
    texts += [f"{w} x" for w in ("According to", "as reported by", "cited by", "published by", "per ", "SOURCE:", "from a study by", "data from", "a.gov", "b.EDU", "Journal", "research", "university", "institute", "none")]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    for chars, p in (("jfmasondpul", sc.SHOWN_DATE), ("lum", sc.UPDATED_DATE), ("jfmasondpu", ex.VISIBLE_DATE), ("acpsfdjrui.", sc.CITATION)):
        rows = df.select(tx.count_matches(F.col("t"), p).alias("a"), tx.count_matches(F.col("t"), tx.beginning(chars, p)).alias("b")).collect()
        assert [r.a for r in rows] == [r.b for r in rows] and sum(r.a for r in rows) > 2


def test_signals_take_the_opening_that_is_at_hand(spark):
    trust = "named_struct('author_name', '', 'has_visible_date', false, 'has_contact_link', false)"
    df = spark.createDataFrame([("<p>updated on May 4, 2022 by Ann Lee</p>",), ("<p>x</p>",), (None,)], "body_html string")
    df = df.selectExpr("*", f"{trust} AS trust", "array(named_struct('level', 'h2', 'text', 'x')) AS headings")
    plain = sc.trust_signals(df)
    given = sc.trust_signals(df.withColumn("opening", hx.opening_text(F.col("body_html"), 3000)))
    assert given.columns == plain.columns and given.collect() == plain.collect() and plain.filter("has_updated_date").count() == 1
    assert sc.trust_signals(df.withColumn("opening", F.lit("modified 2022-05-04"))).filter("has_updated_date").count() == 3
