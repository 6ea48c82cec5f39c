"""Streaming jobs over arriving files."""

import itertools

from pyspark.sql import functions as F

from fernwork.operators.tracking import suppress_repeats
from fernwork.streaming import jobs


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string").withColumn(
        "ts", F.col("ts").cast("timestamp")
    )


def test_daily_metrics_keep_old_files(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for n, day in enumerate([20, 19, 5, 4, 20]):  # a backfill in reverse order, one file a batch
        events(spark, [(n, f"2024-01-{day:02d} 10:00:00", 1, "view", 2.0, '{"k": 5}')]).coalesce(1).write.mode("append").parquet(src)
    jobs.run_daily_metrics(spark, src, out, ck, 1)
    events(spark, [(9, "2024-01-04 12:00:00", 2, "click", 3.0, '{"k": 5}')]).write.mode("append").parquet(src)
    jobs.run_daily_metrics(spark, src, out, ck, 1)
    got = {str(r.date): (r.pageviews, r.clicks, r.value) for r in jobs.daily_totals(spark, out).collect()}
    assert got == {"2024-01-20": (2, 0, 4.0), "2024-01-19": (1, 0, 2.0), "2024-01-05": (1, 0, 2.0), "2024-01-04": (1, 1, 5.0)}


def test_changed_pages_append_to_the_state(spark, tmp_path):
    src, state, out, ck = (str(tmp_path / x) for x in ("src", "state", "out", "ck"))
    page = lambda rows: spark.createDataFrame(rows, "page_id bigint, url string, html string")
    spark.createDataFrame([("u0", "old")], "url string, content_hash string").write.parquet(f"{state}/batch=-1")
    page([(1, "u1", "a b"), (2, "u2", "x"), (3, "u2", "z")]).coalesce(1).write.mode("append").parquet(src)
    jobs.run_changed_pages(spark, src, state, out, ck)
    page([(4, "u1", "a  b"), (5, "u2", "y")]).coalesce(1).write.mode("append").parquet(src)
    jobs.run_changed_pages(spark, src, state, out, ck)
    assert sorted(r.page_id for r in spark.read.parquet(out).collect()) == [1, 3, 5]
    jobs.compact_state(spark, state, state + "-small")
    assert spark.read.parquet(state + "-small").count() == 3


def test_alert_suppression_stream_and_batch(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for n, (user, day) in enumerate([(1, 20), (1, 15), (1, 13), (1, 6), (2, 20), (1, 27), (1, 28)]):
        events(spark, [(n, f"2024-01-{day:02d} 00:00:00", user, "error", 0.0, '{"k": 1}')]).coalesce(1).write.mode("append").parquet(src)
    jobs.run_suppressed_alerts(spark, src, out, ck, 1)
    got = sorted((r.post_id, r.detected_at.day) for r in jobs.alerts_of(spark, out).collect())
    assert got == [(1, 6), (1, 13), (1, 20), (1, 27), (2, 20)]
    schema = "post_id int, keyword string, alert_type string, d string"
    day = lambda rows: spark.createDataFrame(rows, schema).withColumn("detected_at", F.col("d").cast("date")).drop("d")
    new = day([(1, "k", "t", "2024-01-10"), (2, "k", "t", "2024-01-10")])
    assert [r.post_id for r in suppress_repeats(new, day([(1, "k", "t", "2024-01-04"), (2, "k", "t", "2024-01-03")])).collect()] == [2]


def test_alerts_do_not_depend_on_the_order_of_files(spark, tmp_path):
    """Six posts, each with the days 1, 6 and 11 in another order of arrival; then a replay of a file."""
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    orders = list(itertools.permutations([1, 6, 11]))
    for n in range(3):
        events(spark, [(10 * n + i, f"2024-01-{o[n]:02d} 09:00:00", i, "error", 0.0, '{"k": 1}') for i, o in enumerate(orders)]).coalesce(1).write.mode("append").parquet(src)
    jobs.run_suppressed_alerts(spark, src, out, ck, 1)
    got = sorted((r.post_id, r.detected_at.day) for r in jobs.alerts_of(spark, out).collect())
    assert got == [(i, d) for i in range(6) for d in (1, 11)]
    events(spark, [(99, "2024-01-06 10:00:00", 0, "error", 0.0, '{"k": 1}'), (98, None, 0, "error", 0.0, None)]).coalesce(1).write.mode("append").parquet(src)
    jobs.run_suppressed_alerts(spark, src, out, ck, 1)  # a known day and a row without one change nothing
    assert jobs.alerts_of(spark, out).count() == 12


def test_state_knows_pages_of_the_time_before(spark, tmp_path):
    src, state, out, ck = (str(tmp_path / x) for x in ("src", "state", "out", "ck"))
    page = lambda rows: spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.mode("append").parquet(src)
    page([(1, "u1", "a b"), (2, "u2", "x"), (3, None, None)])
    jobs.run_changed_pages(spark, src, state, out, ck)
    start = str(tmp_path / "start")
    jobs.compact_state(spark, state, start)
    src = str(tmp_path / "src2")
    page([(4, "u1", "a b"), (5, "u2", "y"), (6, None, None), (7, "u3", "")])
    jobs.run_changed_pages(spark, src, start, out + "2", ck + "2")
    assert sorted(r.page_id for r in spark.read.parquet(out + "2").collect()) == [5, 7]


def test_pages_of_one_url_keep_their_own_hashes(spark, tmp_path):
    """With (url, page_id) as key, pages under one URL don't hide or take back each other's changes."""
    src, state, out, ck = (str(tmp_path / x) for x in ("src", "state", "out", "ck"))
    schema = "page_id bigint, url string, html string"
    known = spark.createDataFrame([(2, "u", "b"), (4, "u", "d")], schema)
    known.select("url", "page_id", F.sha2("html", 256).alias("content_hash")).write.parquet(f"{state}/batch=-1")
    for rows in ([(1, "u", "a"), (3, "u", "c")], [(2, "u", "b"), (4, "u", "d"), (1, "u", "a")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    jobs.run_changed_pages(spark, src, state, out, ck, 1, ["url", "page_id"])
    assert sorted(r.page_id for r in spark.read.parquet(out).collect()) == [1, 3]
