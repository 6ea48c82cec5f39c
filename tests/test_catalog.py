"""Registered queries against DuckDB on the smallest data set.

By default one query of each group runs; FERNWORK_ALL=1 runs every one.
"""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
SAMPLE = [
    "a9_search_page_days", "a13_recrawl_diff", "b4_internal_links", "b20_section_chunks", "c4_hard_paragraphs", "c19_ai_problems", "d8_cluster_flows",
    "e8_silhouette", "e24_primary_bigram", "f14_blended_score", "f19_cluster_pairs", "g24_health_job", "h15_merge_problems", "i3_site_wide", "j11_analysis_diff",
    "k9_worst_posts", "p1_daily_metric_stream",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("FERNWORK_ALL") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_duckdb(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    order = sorted(cols)
    want = sorted([tuple(plain(r[cols.index(c)]) for c in order) for r in cur.fetchall()], key=repr)
    got = sorted([tuple(plain(r[c]) for c in order) for r in df.collect()], key=repr)
    assert got == want


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
