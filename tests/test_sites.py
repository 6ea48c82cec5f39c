"""Rules that single-site checks can't see: several sites in one table, order of merges, later check-ins."""

import gzip
from datetime import date

import pytest
from pyspark.sql import functions as F

from fernwork.operators import graph
from fernwork.operators import ingest as ig
from fernwork.operators import problems as pb
from fernwork.operators import recommend as rc
from fernwork.operators import tracking as tr
from fernwork.sources import files


def test_monthly_delta_counts_each_site(spark):
    h = spark.createDataFrame([(s, date(2024, 1, d), 50.0 + d) for s in (1, 2) for d in (1, 30)], "site_id long, date date, score double")
    recs = spark.createDataFrame([(1, "pending", None)], "site_id long, status string, completed_at date")
    problems = spark.createDataFrame([(2, date(2024, 1, 30), None)], "site_id long, detected_at date, resolved_at date")
    got = {r.site_id: (r.score_delta, r.completed, r.pending, r.new_issues) for r in tr.monthly_delta(h, recs, problems, "2024-01-31").collect()}
    assert got == {1: (29.0, 0, 1, 0), 2: (29.0, 0, 0, 1)}


def test_streaks_ignore_later_check_ins(spark):
    days = [date(2024, 1, d) for d in (1, 2, 3, 9, 10)]
    got = tr.streaks(spark.createDataFrame([(7, d) for d in days], "user_id long, date date"), "2024-01-05").first()
    assert (got.current_streak, got.longest_streak, got.last_check_in, got.total_check_ins) == (3, 3, date(2024, 1, 3), 3)


def test_top_lists_are_per_site(spark):
    rows = [(s, p, "q", date(2024, 1, d), 10.0 * (d > 20), 1) for s in (1, 2) for p in range(3) for d in (20, 30)]
    gsc = spark.createDataFrame(rows, "site_id long, post_id long, query string, date date, avg_position double, clicks long")
    got = tr.position_changes(gsc, "2024-01-31", limit=2).collect()
    assert sorted((r.site_id, r.post_id) for r in got) == [(1, 0), (1, 1), (2, 0), (2, 1)]


def test_merges_settle_in_order_of_similarity(spark):
    posts = spark.createDataFrame([(i, 1000 - i) for i in range(1, 8)], "post_id long, word_count int")
    pairs = spark.createDataFrame([("s", 1, 2, 0.97), ("s", 2, 3, 0.95), ("s", 3, 4, 0.94), ("s", 4, 5, 0.93), ("s", 6, 7, 0.5)], "site_id string, post_a_id long, post_b_id long, cosine double")
    recs = spark.createDataFrame([], "post_id long, rec_type string")
    # 2 goes into 1, so (2, 3) is out; 4 goes into 3; then (4, 5) is out
    got = {(r.post_id, r.primary_id) for r in rc.high_similarity_merges(pairs, posts, recs).collect()}
    assert got == {(2, 1), (4, 3)}
    busy = spark.createDataFrame([(1, "merge")], "post_id long, rec_type string")
    assert {(r.post_id, r.primary_id) for r in rc.high_similarity_merges(pairs, posts, busy).collect()} == {(3, 2), (5, 4)}


def test_link_checks_leave_out_sites_of_unresolved_links(spark):
    posts = [(s, 10 * s + i, 500, "blog", "A title of a usual length", "A description of the page", "<p>x</p>") for s in (1, 2, 3) for i in range(5)]
    posts = spark.createDataFrame(posts, "site_id long, post_id long, word_count int, page_type string, title string, meta_description string, body_html string")
    posts = posts.selectExpr("*", "array(named_struct('level', 'h2', 'text', 'x')) AS headings")
    # a tenth of the links of site 1 has a known target, half of those of site 2; site 3 has none
    links = [(10, f"u{i}", 11 if i == 0 else None) for i in range(10)] + [(20, f"u{i}", 21 if i % 2 else None) for i in range(10)]
    links = spark.createDataFrame(links, "source_post_id long, target_url string, target_post_id long")
    gated = pb.unreliable_sites(posts, links)
    assert {r.site_id for r in gated.collect()} == {1}
    assert {r.post_id for r in pb.orphans(posts, links, gated).collect()} == {20, 22, 23, 24, *range(30, 35)}
    lone = pb.seo_issues(posts, links, gated).filter("problem_type = 'seo_no_internal_links'")
    assert {r.post_id for r in lone.collect()} == {22, 23, 24, *range(30, 35)}


def test_families_count_each_site_and_know_duplicates(spark):
    rows = [(1, "duplicate_content"), (2, "duplicate_content"), (1, "weak_eeat"), (1, "something_new"), (2, "thin_content"), (2, "thin_high_bounce")]
    posts = spark.createDataFrame([(1, "a"), (2, "b")], "post_id long, site_id string")
    got = {(r.site_id, r.family): r.n for r in pb.family_counts(spark.createDataFrame(rows, "post_id long, problem_type string"), posts).collect()}
    assert got == {("a", "duplicate"): 1, ("b", "duplicate"): 1, ("a", "ai_readiness"): 1, ("a", "other"): 1, ("b", "thin"): 2}


def test_sites_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "site_id string, n long")
    site = lambda *s: spark.createDataFrame([(x,) for x in s], "site_id string")
    now = lambda: sorted(((r.site_id, r.n) for r in ig.site_rows(spark, path).collect()), key=repr)
    assert ig.replace_sites(rows(("a", 1), ("a", 1), ("b", 2), (None, 3)), site("a", "b", None), path) == 0
    assert ig.replace_sites(rows(("b", 4)), site("a", "b"), path) == 1  # site a turned empty
    assert now() == [("b", 4), (None, 3)]
    # a writer that fails after its rows leaves the old ones in force, and the next run writes over it
    rows(("b", 9), ("b", 10)).write.parquet(f"{path}/rows/run=2")
    assert now() == [("b", 4), (None, 3)]
    assert ig.replace_sites(rows((None, 5)), site(None), path) == 2
    assert now() == [("b", 4), (None, 5)]
    ig.compact_sites(spark, path, path + "-small")
    path += "-small"
    assert now() == [("b", 4), (None, 5)] and ig.replace_sites(rows(), site("b"), path) == 1 and now() == [(None, 5)]
    with pytest.raises(ValueError):
        ig.replace_sites(rows(("c", 1)), site("a"), path)


def test_links_of_each_site_have_its_domain(spark):
    links = spark.createDataFrame([("a", 1, "https://a.com/x"), ("a", 1, "https://b.com/x"), ("b", 2, "https://a.com/x"), ("b", 2, "https://b.com/x")], "site_id string, source_post_id long, target_url string")
    posts = spark.createDataFrame([("a", "https://a.com/x"), ("a", "https://b.com/x")], "site_id string, url string")
    own = F.concat("site_id", F.lit(".com"))
    assert [(r.site_id, r.target_url) for r in graph.broken_links(links, posts, own, ["site_id"]).collect()] == [("b", "https://b.com/x")]
    assert sorted((r.post_id, r.external_links) for r in graph.outbound_counts(links, own).collect()) == [(1, 1), (2, 1)]


def test_prices_by_longest_prefix(spark):
    log = spark.createDataFrame([("s", "large-1", 10, 0), ("s", "large", 10, 0), ("t", "la", 10, 0), ("t", "none", 5, 5)], "service string, model string, input_tokens long, output_tokens long")
    rates = spark.createDataFrame([("large-", 1e6, 0.0), ("la", 2e6, 0.0), ("large-12", 9e6, 0.0)], "prefix string, input_rate double, output_rate double")
    out = tr.token_costs(log, rates)
    assert {r.service: (r.cost, r.tokens) for r in out.collect()} == {"s": (30.0, 20), "t": (20.0, 20)}
    assert "NestedLoop" not in out._jdf.queryExecution().toString()


def test_nested_sitemaps(spark, tmp_path):
    """Two levels of indexes that name each other, a compressed sitemap, a broken one, one missing and one that nothing names."""
    (tmp_path / "in").mkdir()
    index = lambda *names: "<sitemapindex>" + "".join(f"<sitemap><loc> https://a.com/{n} </loc></sitemap>" for n in names) + "</sitemapindex>"
    urls = lambda *names: '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' + "".join(f"<url><loc>https://a.com/{n}</loc></url>" for n in names) + "</urlset>"
    texts = {
        "top.xml": index("mid.xml", "one.xml", "gone.xml"), "mid.xml": index("top.xml", "deep.xml", "two.xml.gz", "bad.xml"), "deep.xml": index("three.xml"), "one.xml": urls("p1", "p2"),
        "two.xml.gz": urls("p3"), "three.xml": urls("p4"), "bad.xml": "<urlset><url><loc>no end", "alone.xml": urls("p5"),
    }
    for name, text in texts.items():
        (tmp_path / "in" / name).write_bytes(gzip.compress(text.encode()) if name.endswith("gz") else text.encode())
    fetched = spark.createDataFrame([(f"https://a.com/{n}", f"file://{tmp_path}/in/{n}") for n in texts], "url string, file string")
    found = lambda depth: sorted((r.url[-2:], r.sitemap[14:]) for r in files.read_sitemap_tree(spark, str(tmp_path / "in"), fetched, ["https://a.com/top.xml"], depth).collect())
    assert found(None) == [("p1", "one.xml"), ("p2", "one.xml"), ("p3", "two.xml.gz"), ("p4", "three.xml")]
    assert found(1) == [("p1", "one.xml"), ("p2", "one.xml")]
