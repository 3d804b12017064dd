"""Continuous intake of entries.

The refresh of a feed reader becomes a micro-batch: a trigger interval for the periodic one,
`availableNow` for a manual one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from newsloom.operators.normalize import normalize_entries
from newsloom.operators.select import dedup_url, with_url
from newsloom.streaming import store

REFRESH_MINUTES = 30  # fixed value: the reader's refresh period


def stream_table(
    spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int | None = None
) -> DataFrame:
    """New Parquet files below `path` (a folder or a glob)."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def dedup_stream(articles: DataFrame, delay: str = "30 days") -> DataFrame:
    """One article per URL while its watermark lasts.

    Event time is the time of arrival, so no article is late, whenever it was published and
    however files are spread over batches; state is bounded by `delay`, after which a URL may
    come again. Which of several copies in one batch survives is open. Use `ingest_batch` where
    neither is acceptable.
    """
    return (
        with_url(articles)
        .withColumn("arrived", F.current_timestamp())
        .withWatermark("arrived", delay)
        .dropDuplicatesWithinWatermark(["url"])
        .drop("arrived")
    )


FIRST_STATE = "feed_ord int, entry_ord long"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstOfUrl(StatefulProcessor):
    """Per URL the least (feed, entry) so far; a row is passed on only when it lowers that.

    With `keep_ms` a timer drops the state of a URL that has not come again for so long.
    """

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.least = handle.getValueState("least", FIRST_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, best, row = self.least.get(), None, None
        if known is not None:
            best = (known[0], known[1])
        for batch in rows:
            batch = batch.sort_values(["feed_ord", "entry_ord"], kind="stable")
            place = (int(batch["feed_ord"].iloc[0]), int(batch["entry_ord"].iloc[0]))
            if best is None or place < best:
                best, row = place, batch.iloc[:1]
        if row is not None:
            self.least.update(best)
        if self.keep_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, (tuple, list)) else timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_ms)
        if row is not None:
            yield row

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.least.clear()
        return iter([])

    def close(self) -> None:
        pass


def first_of_url_stream(articles: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """Articles that are, when they arrive, the first of their URL in (feed, entry) order.

    A log to be appended to and read by `current_firsts`, which then has the rows of `dedup_url`
    whatever batches the files came in and however often the query was restarted. State is one
    small row per URL; `keep_ms` bounds it, after which a URL may pass again, and `current_firsts`
    still keeps one row of it. Start it with `append_stream(..., state_store=ROCKS_DB)`.
    """
    rows = with_url(articles)
    mode = "none" if keep_ms is None else "processingTime"
    return rows.groupBy("url").transformWithStateInPandas(
        FirstOfUrl(keep_ms), outputStructType=rows.schema, outputMode="Append", timeMode=mode
    )


def current_firsts(log: DataFrame) -> DataFrame:
    """The rows that the log of `first_of_url_stream` ends in, one per URL."""
    return dedup_url(log)


def refresh_trigger(minutes: int | None = REFRESH_MINUTES) -> dict:
    """Arguments for `DataStreamWriter.trigger`; None processes what is there and stops."""
    return {"availableNow": True} if minutes is None else {"processingTime": f"{minutes} minutes"}


@contextmanager
def _setting(spark: SparkSession, key: str, value: str | None) -> Iterator[None]:
    """A setting while a query starts, which takes its own copy of the session; then as before."""
    if value is None:
        yield
        return
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def append_stream(
    rows: DataFrame, target: str, checkpoint: str, minutes: int | None = None, state_store: str | None = None
) -> StreamingQuery:
    writer = (
        rows.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**refresh_trigger(minutes))
    )
    spark = rows.sparkSession
    # Timers make batches without data, of which a query that is to stop would never run out.
    empty = "false" if minutes is None and state_store else None
    with _setting(spark, STATE_STORE, state_store), _setting(spark, EMPTY_BATCHES, empty):
        return writer.start()


def ingest_batch(
    target: str, as_of: datetime | None, enrich: Callable[[DataFrame], DataFrame]
) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function that enriches and stores URLs not seen before.

    Exact over the whole history: the stored table is the state, read through the filters of
    `store`. Each batch owns the folder `batch=<id>`, which a replay overwrites, so a restarted batch
    is never stored twice. Without `as_of` a missing publish time is that of the batch.
    """

    def process(entries: DataFrame, batch_id: int) -> None:
        now = as_of or datetime.now(timezone.utc)
        # The batch is looked up and then written; kept, it is read and deduplicated once.
        fresh = dedup_url(with_url(normalize_entries(entries, now))).persist()
        try:
            known = store.known_urls(fresh, target, batch_id)
            store.write_batch(enrich(fresh.join(known, "url", "left_anti")), target, batch_id)
        finally:
            fresh.unpersist()

    return process


def enrich_stream(
    entries: DataFrame,
    target: str,
    checkpoint: str,
    as_of: datetime | None,
    enrich: Callable[[DataFrame], DataFrame],
    minutes: int | None = None,
) -> StreamingQuery:
    return (
        entries.writeStream.foreachBatch(ingest_batch(target, as_of, enrich))
        .option("checkpointLocation", checkpoint)
        .trigger(**refresh_trigger(minutes))
        .start()
    )
