"""Incremental jobs on Structured Streaming: daily metrics, alert suppression, changed pages.

Every micro-batch writes a folder of its own (``batch=N``), so a batch replayed
after a failure overwrites what the failed attempt left. What a job must
remember lies in Spark's state store, keyed, so a batch reads the state of its
own keys and no earlier folder. Nothing is dropped for being late: a backfill
may deliver its files in any order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import text as tx
from ..plans.scale import durable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
PAGE_SCHEMA = "page_id bigint, url string, html string"
TOTALS = ["pageviews", "clicks", "events", "value"]
DAILY_SCHEMA = "post_id bigint, date date, pageviews bigint, clicks bigint, events bigint, value double, batch bigint"
ALERT_SCHEMA = "post_id bigint, keyword string, alert_type string, detected_at date, raised boolean"
CHANGE_SCHEMA = "page_id bigint, url string, content_hash string"
STATE_SCHEMA = "url string, content_hash string, batch bigint"


def read_files(spark: SparkSession, path: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of batch folders, empty before the first batch."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def run_batches(rows: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands everything that has arrived to ``step``, batch by batch, then stops."""
    q = rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def with_state(rows: DataFrame, keys: Sequence[str], processor: StatefulProcessor, schema: str, known: DataFrame | None = None) -> DataFrame:
    """Keyed state on disk next to each task, with its changes kept in the checkpoint of the query."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return rows.groupBy(*keys).transformWithState(processor, schema, "update", "none", known.groupBy(*keys) if known is not None else None)


# ---- daily metrics -------------------------------------------------------


def daily_metrics(events: DataFrame) -> DataFrame:
    """Daily counts per post."""
    e = events.withColumn("post_id", F.get_json_object("props", "$.k").cast("long"))
    return e.groupBy("post_id", F.to_date("ts").alias("date")).agg(
        F.count_if(F.col("event_type") == "view").alias("pageviews"), F.count_if(F.col("event_type") == "click").alias("clicks"),
        F.count("*").alias("events"), F.sum("value").alias("value"),
    )


def daily_totals(spark: SparkSession, target: str) -> DataFrame:
    """The loaded days: the parts that the batches wrote, added up."""
    return stored(spark, target, DAILY_SCHEMA).groupBy("post_id", "date").agg(*[F.sum(c).alias(c) for c in TOTALS])


def run_daily_metrics(spark: SparkSession, source: str, target: str, checkpoint: str, per_trigger: int = 1000) -> StreamingQuery:
    """Load everything that has arrived; a row counts on its day whenever it comes."""

    def step(batch: DataFrame, number: int) -> None:
        daily_metrics(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return run_batches(read_files(spark, source, EVENT_SCHEMA, per_trigger), step, checkpoint)


# ---- alerts --------------------------------------------------------------


def let_through(days: Iterable[date], gap: int) -> set[date]:
    """In order of the days: a day counts if the one let through before it is at least ``gap`` days back."""
    out: list[date] = []
    for d in sorted(days):
        if not out or (d - out[-1]).days >= gap:
            out.append(d)
    return set(out)


class AlertDays(StatefulProcessor):
    """Keeps the distinct days of one alert and tells which of them are raised or taken back by new ones."""

    def __init__(self, keys: list[str], gap: int) -> None:
        self.keys, self.gap = keys, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.days = handle.getValueState("days", "seen array<date>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803 - names of the interface
        seen = set(self.days.get()[0]) if self.days.exists() else set()
        both = seen | {r["detected_at"] for r in rows}
        if both == seen:
            return
        self.days.update((sorted(both),))
        before, after = let_through(seen, self.gap), let_through(both, self.gap)
        names = [*self.keys, "detected_at", "raised"]
        for d in sorted(before ^ after):
            yield Row(**dict(zip(names, [*key, d, d in after])))

    def close(self) -> None:
        pass


def run_suppressed_alerts(spark: SparkSession, source: str, target: str, checkpoint: str, per_trigger: int = 1000, days: int = 7) -> StreamingQuery:
    """Write which alerts each batch raises or takes back; ``alerts_of`` reads the outcome.

    An alert is held back if the same one was raised less than ``days`` days
    before. Files may come in any order: an earlier day that comes late takes
    back what it rules out, so the outcome is that of all files at once. The
    days of an alert lie in the state store, where a batch reads its own keys.
    Alerts without a day are left out; null keys are keys like others.
    """
    keys = ["post_id", "keyword", "alert_type"]
    alerts = read_files(spark, source, EVENT_SCHEMA, per_trigger).filter(F.col("event_type").isin("error", "signup")).select(
        F.to_date("ts").alias("detected_at"), F.col("user_id").alias("post_id"), F.get_json_object("props", "$.k").alias("keyword"), F.col("event_type").alias("alert_type")
    )
    changes = with_state(alerts.filter("detected_at IS NOT NULL"), keys, AlertDays(keys, days), ALERT_SCHEMA)

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return run_batches(changes, step, checkpoint)


def alerts_of(spark: SparkSession, target: str) -> DataFrame:
    """The alerts that stand after all batches: the last word on each day of an alert."""
    days = stored(spark, target, ALERT_SCHEMA + ", batch bigint").groupBy("post_id", "keyword", "alert_type", "detected_at")
    return days.agg(F.max_by("raised", "batch").alias("raised")).filter("raised").drop("raised")


# ---- changed pages -------------------------------------------------------


class PageHash(StatefulProcessor):
    """Keeps the content hash of one page, known by ``keys``, and lets a page through that changes it; of one batch the last row of a page counts."""

    def __init__(self, keys: Sequence[str]) -> None:
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hash = handle.getValueState("hash", "content_hash string")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803 - names of the interface
        self.hash.update((initialState["content_hash"],))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        last = max(rows, key=lambda r: (r["page_id"] is not None, r["page_id"] or 0, r["content_hash"] or ""))
        if not self.hash.exists() or self.hash.get()[0] != last["content_hash"]:
            self.hash.update((last["content_hash"],))
            own = dict(zip(self.keys, key))
            yield Row(page_id=own.get("page_id", last["page_id"]), url=own["url"], content_hash=last["content_hash"])

    def close(self) -> None:
        pass


def state_schema(keys: Sequence[str]) -> str:
    return STATE_SCHEMA + "".join(f", {k} bigint" for k in keys if k != "url")


def latest_state(rows: DataFrame, keys: Sequence[str] = ("url",)) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by("content_hash", "batch").alias("content_hash"))


def compact_state(spark: SparkSession, state: str, target: str, keys: Sequence[str] = ("url",)) -> None:
    """One row per page of a state, as the state of a later run."""
    latest_state(stored(spark, state, state_schema(keys)), keys).write.mode("overwrite").parquet(f"{target}/batch=-1")


def run_changed_pages(spark: SparkSession, source: str, state: str, target: str, checkpoint: str, per_trigger: int = 1000, keys: Sequence[str] = ("url",)) -> StreamingQuery:
    """Write the changed pages of each batch and append their hashes to ``state``.

    ``keys`` say what a page is: its URL, or (url, page_id) where a table holds
    several pages under one URL, each with a content of its own.

    What was known before the first batch lies in the folder ``batch=-1`` of
    ``state`` and is loaded into the state store once; from then on a batch
    reads the hashes of its own pages there. The folders ``batch=N`` of
    ``state`` are only written, for ``compact_state`` and other jobs. Pages
    are hashed before they are grouped, so no markup is shuffled.
    """
    pages = read_files(spark, source, PAGE_SCHEMA, per_trigger).select("url", "page_id", tx.content_hash(F.col("html")).alias("content_hash"))
    known = latest_state(stored(spark, state, state_schema(keys)).filter("batch = -1"), keys)
    changed = with_state(pages, keys, PageHash(keys), CHANGE_SCHEMA, known)

    def step(batch: DataFrame, number: int) -> None:
        hit = durable(batch)
        hit.write.mode("overwrite").parquet(f"{target}/batch={number}")
        hit.select(*keys, "content_hash").write.mode("overwrite").parquet(f"{state}/batch={number}")

    return run_batches(changed, step, checkpoint)
