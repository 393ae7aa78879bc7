"""The transaction log: entries, recovery report, counts, checksums.

Entries are tidied as the change feed does: one row an ``entry_id``, trimmed, operation and status in lower case, a missing
status committed, a missing operation unknown, a missing transaction one of its own (records of the old format).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardlight.functions.scalars import checksum
from shardlight.operators.changefeed import normalise_entries

FIELDS = ("entry_id", "tx_id", "operation", "doc_id", "status", "details")


def once(log: DataFrame) -> DataFrame:
    tidy = normalise_entries(log)
    return tidy.fillna({"operation": "unknown", "doc_id": ""})


def pending(entries: DataFrame) -> DataFrame:
    """Transactions with a pending entry and no committed or failed one; operation and document of the last entry."""
    ended = F.max(F.col("status").isin("committed", "failed").cast("int"))
    last = F.max(F.when(F.col("status") == "pending", F.struct("entry_id", "operation", "doc_id")))
    tx = entries.groupBy("tx_id").agg(ended.alias("ended"), last.alias("last"))
    return tx.where("ended = 0 AND last IS NOT NULL").select("tx_id", "last.operation", "last.doc_id", "last.entry_id")


def counts(entries: DataFrame) -> DataFrame:
    """Entries by operation and by status, in one pass over the log."""
    pairs = F.array(
        F.struct(F.lit("operation").alias("field"), F.col("operation").alias("value")), F.struct(F.lit("status").alias("field"), F.col("status").alias("value"))
    )
    return entries.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("entries"))


def recovery_report(entries: DataFrame) -> DataFrame:
    """Unresolved transactions, failed entries, all entries and the greatest entry number."""
    totals = entries.agg(F.count_if(F.col("status") == "failed").alias("failed"), F.count(F.lit(1)).alias("total_entries"), F.max("entry_id").alias("entry_counter"))
    open_ = pending(entries).agg(F.count(F.lit(1)).alias("pending"))
    return open_.join(F.broadcast(totals), F.lit(True)).select("pending", F.lit(0).alias("recovered"), "failed", "total_entries", "entry_counter")


def with_checksum(entries: DataFrame) -> DataFrame:
    return entries.withColumn("checksum", checksum(*[c for c in FIELDS if c in entries.columns]))


def _flagged(entries: DataFrame) -> DataFrame:
    right = F.coalesce(checksum(*[c for c in FIELDS if c in entries.columns]) == F.col("checksum"), F.lit(False))
    return entries.select("entry_id", right.alias("ok"))


def verify(entries: DataFrame) -> DataFrame:
    """(total_entries, valid, invalid) by recomputing the stored checksums."""
    return _flagged(entries).agg(F.count(F.lit(1)).alias("total_entries"), F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("invalid"))


def invalid_entries(entries: DataFrame) -> DataFrame:
    """(entry_id) of every entry whose checksum doesn't hold; a missing one doesn't."""
    return _flagged(entries).where(~F.col("ok")).select("entry_id")
