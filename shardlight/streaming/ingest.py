"""Streams into and out of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shardlight.operators import changefeed
from shardlight.sources.store import Engine


def ingest_stream(documents: DataFrame, engine: Engine, checkpoint: str, order: str | None = None, updates: bool = False) -> StreamingQuery:
    """Feeds a stream of documents into the store, a transaction a micro-batch.

    Of rows with one id within a batch the one with the greatest ``order`` (a column, say the time of arrival) counts, ties and no such column
    by text and metadata. A document that exists is rejected, so a batch that is run again after a failure stores each document once;
    with ``updates`` it is replaced, and a batch that is run again leaves the same content.
    """

    def write(batch: DataFrame, _: int) -> None:
        first = [F.col(order).alias("_order")] if order else []
        latest = batch.groupBy("doc_id").agg(F.max(F.struct(*first, "text", "metadata")).alias("r")).select("doc_id", "r.text", "r.metadata")
        if not latest.isEmpty():
            if updates:
                engine.upsert(latest)
            else:
                engine.ingest(latest, limit_batch=False)

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_changes(feed: DataFrame, store: changefeed.RunStore, checkpoint: str, compact_every: int = 8) -> StreamingQuery:
    """Appends a stream of log entries to a run store, a sorted run a micro-batch, compacting now and then.

    States merge idempotently, so a batch applied twice changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.append(batch)
            if number % compact_every == compact_every - 1:
                store.compact()

    return feed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_counts(log: DataFrame, watermark: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Log entries by status and window of their time; entries later than the watermark are dropped by design of the window."""
    timed = log.withColumn("logged_at", F.col("logged_at").cast("timestamp"))
    return timed.withWatermark("logged_at", watermark).groupBy(F.window("logged_at", window).alias("w"), "status").agg(F.count(F.lit(1)).alias("entries"))
