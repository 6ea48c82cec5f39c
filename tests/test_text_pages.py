"""Formulas and extraction on small inline inputs."""

import pytest
from pyspark.sql import functions as F

from fernwork.functions import html as hx
from fernwork.functions import text as tx
from fernwork.functions import urls as ux
from fernwork.operators import extract as ex
from fernwork.operators import ingest as ig
from fernwork.operators import labels as lb
from fernwork.operators import pairs as pr
from fernwork.operators import scoring as sc
from fernwork.sources import files

PAGE = """<html lang="en-US"><head><title>Guide | Acme</title>
<meta name="description" content="It's a <b>short</b>  text"><meta property="og:title" content="x">
<meta property="article:published_time" content="2024-01-05T10:00:00+02:00">
<link rel="canonical" href="https://www.acme.com/guide/"><script type="application/ld+json">
[{"@type":"Article","headline":"h","author":{"name":"A"},"image":"i","datePublished":"2024","dateModified":"2024"},{"@type":["FAQPage","Thing"]}]
</script></head><body><nav><a href="/x">x</a></nav><main><h1>Guide</h1><h4>Brian Clark</h4><h4>How to Build Links</h4>
<h2>What is it?</h2><p>It is a thing you can use every day to start and the best way to learn all about it here now.</p>
<a href="../b">B</a><a href="https://acme.com/c">C</a><a href="https://other.org/">O</a>
<time class="updated" datetime="2024-02-01">Feb</time></main></body></html>"""


def one(spark, **cols):
    return spark.createDataFrame([(PAGE, "https://www.acme.com/a/page")], "html string, url string").select(
        *[c.alias(n) for n, c in cols.items()]
    ).first()


def test_page_extraction(spark):
    h, u = F.col("html"), F.col("url")
    r = one(
        spark, meta=hx.meta_description(h), heads=hx.headings(h), links=ex.internal_links(h, u, ux.netloc(u)), canon=ex.canonical_url(h, u, ux.netloc(u)),
        lang=ex.language(h), pub=ex.publish_date(h), mod=ex.modified_date(h), trust=ex.trust_metadata(h), types=hx.jsonld_types(h),
    )
    assert r.meta == "It's a short text"
    assert [(x.level, x.text) for x in r.heads] == [("h1", "Guide"), ("h4", "How to Build Links"), ("h2", "What is it?")]
    assert [x.target_url for x in r.links] == ["https://www.acme.com/x", "https://www.acme.com/a/../b", "https://acme.com/c"]
    assert r.canon == "https://www.acme.com/guide/" and r.lang == "en"
    assert str(r.pub) == "2024-01-05 10:00:00" and str(r.mod) == "2024-02-01 00:00:00"
    assert r.trust.has_og_tags and r.trust.has_canonical and r.trust.has_author_schema and r.types == ["Article", "FAQPage", "Thing"]


@pytest.mark.parametrize(
    "raw,want",
    [
        ("https://www.example.com/blog/post/", "https://example.com/blog/post"),
        ("http://Example.COM/Blog/Post?utm_source=twitter", "https://example.com/Blog/Post"),
        ("https://example.com/post#comments", "https://example.com/post"),
        ("https://example.com", "https://example.com/"),
        ("http://example.com:80/a?b=2&a=1&empty=&ref=x", "https://example.com/a?a=1&b=2"),
        ("https://example.com/s?q=a%20b", "https://example.com/s?q=a+b"),
    ],
)
def test_normalize_url(spark, raw, want):
    assert spark.range(1).select(ux.normalize_url(F.lit(raw))).first()[0] == want


def test_schema_and_extraction_scores(spark):
    df = spark.createDataFrame([(1, PAGE, "It is a thing. 42 things.")], "post_id int, body_html string, body_text string")
    r = sc.extraction(sc.schema_markup(df)).first()
    assert r.schema_types == ["Article", "FAQPage", "Thing"] and r.schema_score == 100.0
    assert r.total_h2 == 1 and r.h2_with_answer == 1 and r.direct_opening


def test_readability(spark):
    rows = [(1, "The cat sat on the mat. The dog ran."), (2, ""), (3, "Institutional considerations notwithstanding, organizational complexity necessitates comprehensive reconsideration.")]
    r = {x.post_id: x for x in sc.readability(spark.createDataFrame(rows, "post_id int, body_text string")).collect()}
    assert (r[1].sentences, r[1].words, r[1].syllables) == (2, 9, 9)
    assert r[1].reading_ease == 100.0 and r[2].reading_ease == 0.0 and r[3].reading_ease == 0.0 and r[3].grade > 15


@pytest.mark.parametrize(
    "title,url,want",
    [
        ("Our plans", "/pricing", "transactional"), ("Best SEO Tools for 2026", "/x", "commercial"), ("Why I Won’t Buy This Product", "/x", "informational"),
        ("Buy now", "/x", "transactional"), ("Makes People Buy", "/x", "informational"), ("Aristotle's Top 3 Tips", "/x", "informational"),
        ("Log in to your account", "/x", "navigational"), ("A vs B", "/x", "commercial"), ("How to write", "/about-us", "navigational"),
    ],
)
def test_content_intent(spark, title, url, want):
    assert spark.range(1).select(sc.content_intent(F.lit(title), F.lit(url))).first()[0] == want


@pytest.mark.parametrize("query,want", [("how to cook", "informational"), ("buy best shoes", "transactional"), ("best shoes", "commercial"), ("acme login", "navigational"), ("shoes", "informational")])
def test_query_intent(spark, query, want):
    assert spark.range(1).select(sc.query_intent(F.lit(query))).first()[0] == want


@pytest.mark.parametrize(
    "title,want",
    [
        ("Serpstat Review: Is This SEO Tool Worth It?", "serpstat"), ("SEO Copywriting: The Definitive Guide", "seo copywriting"), ("Link Building: A Complete Guide", "link building"),
        ("9 Best Ecommerce Websites", "ecommerce websites"), ("Once", None),
    ],
)
def test_title_entity(spark, title, want):
    assert spark.range(1).select(pr.title_entity(F.lit(title))).first()[0] == want


def test_format_stripping_and_descriptions(spark):
    f = lambda c: spark.range(1).select(c).first()[0]
    assert f(lb.strip_format(F.lit("How to Build Links in 2024: the complete guide"))) == "build links"
    assert f(lb.connect(F.lit("Link"), F.lit("Building"))) == "Link Building" and f(lb.connect(F.lit("SEO"), F.lit("Copy"))) == "SEO & Copy"
    words = F.array(F.lit("Copy"), F.lit("Traffic"), F.lit("Links"))
    assert f(lb.description(F.lit("Link Building"), words)) == "Posts covering copy, traffic, and links."


def test_cms_posts_and_terms(spark):
    raw = '{"link":"https://a.com/x","slug":"x","title":{"rendered":"T"},"content":{"rendered":"<p>Hello <b>you</b></p>"},"excerpt":{"rendered":"<p>Ex</p>"},"date":"2024-01-02T03:04:05","categories":[2,9,1],"yoast_head_json":{"description":" ","og_description":"og"}}'
    p = ig.cms_posts(spark.createDataFrame([(1, raw)], "post_id int, json string"))
    r = ig.resolve_terms(p, spark.createDataFrame([(1, "one"), (2, "two")], "term_id int, name string"), "category_ids", "categories").first()
    assert (r.title, r.body_text, r.word_count, r.meta_description) == ("T", "Hello you", 2, "og") and r.categories == ["two", "one"]


def test_file_sources(spark, tmp_path):
    (tmp_path / "s.xml").write_text('<urlset><url><loc> https://a.com/1 </loc></url><url><loc>https://a.com/2</loc><lastmod>2024</lastmod></url></urlset>')
    (tmp_path / "r.xml").write_text("<rss><channel><item><title>x</title><link>https://a.com/3</link></item></channel></rss>")
    (tmp_path / "a.xml").write_text('<feed><entry><title>t</title><link rel="self" href="https://a.com/s"/><link rel="alternate" href="https://a.com/4"/></entry></feed>')
    assert {r.url for r in files.read_sitemap(spark, str(tmp_path / "s.xml")).collect()} == {"https://a.com/1", "https://a.com/2"}
    assert files.read_rss(spark, str(tmp_path / "r.xml")).first().url == "https://a.com/3"
    assert files.read_atom(spark, str(tmp_path / "a.xml")).first().url == "https://a.com/4"


def test_redirect_files(spark, tmp_path):
    m = spark.createDataFrame([("https://a.com/old", "https://a.com/new")], "old_url string, new_url string")
    ig.write_redirects(m, "htaccess", str(tmp_path / "h"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "h")).collect()]
    assert "Redirect 301 /old https://a.com/new" in lines and lines[0].startswith("#")


def test_nav_and_sitewide_filters_need_three_posts(spark):
    links = spark.createDataFrame([(1, "s", "/n"), (2, "s", "/n"), (3, "s", "/N/"), (3, "s", "/own"), (9, "t", "/n")], "post_id int, site string, target_url string")
    posts = spark.createDataFrame([(1, "s"), (2, "s"), (3, "s"), (9, "t")], "post_id int, site string")
    kept = {(r.post_id, r.target_url) for r in ex.filter_nav_links(links, posts).collect()}
    assert kept == {(3, "/own"), (9, "/n")}


def test_grade_level_rounds_ties_like_the_scaled_double(spark):
    """A sum that prints as 7.050000000000001 is a tie after scaling, as in DuckDB's round_even."""
    values = [7.05, 7.050000000000001, 7.15, 7.16, -0.25, 78.85, None]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(tx.round_even(F.col("v"), 1).alias("r"))
    assert [r.r for r in df.collect()] == [7.0, 7.0, 7.2, 7.2, -0.2, 78.8, None]


def test_overlap_chunks_of_long_titles(spark):
    body = "".join(f"word-{i},{i};" for i in range(450))
    texts = [("t" * n, body) for n in (0, 1, 50, 1500, 1790, 1796, 1797, 1798, 1799, 1998, 2500)]
    texts += [("", None), (None, None), ("", ""), ("a", "b" * 1997), ("a", "b" * 1998), ("a", "b" * 2000 + " " * 3000 + "c" * 500), ("", "b" * 2300)]

    def plain(title, body):
        pre = f"{title}\n\n" if title else ""
        if body is None:
            return []
        text, width = pre + body, 2000 - len(pre)
        chunks, at = [text[:2000].strip()], 1800
        while len(text) > 2000 and width > 200 and at < len(text) and len(text[at : at + width].strip()) >= 200:
            chunks.append((pre + text[at : at + width]).strip())
            at += width - 200
        return chunks

    df = spark.createDataFrame([(i, *x) for i, x in enumerate(texts)], "post_id int, title string, body_text string")
    got = {(r.post_id, r.i): r.chunk for r in ex.overlap_chunks(df, "post_id", 2000, 200).collect()}
    assert got == {(n, i): c for n, x in enumerate(texts) for i, c in enumerate(plain(*x))}
    assert len([k for k in got if k[0] == 5]) > 100 and [k for k in got if k[0] == 7] == [(7, 0)]
