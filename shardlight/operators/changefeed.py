"""Applying a change feed: a log-structured merge table over sorted runs.

The feed holds log entries of transactions, delivered late, repeated and out of order. Every batch is reduced to one record
an entry and appended as a sorted *run*; nothing already written is touched. Reading merges all runs by entry, then
by transaction, then by document, newest sequence first, and drops documents whose newest record is a tombstone. ``compact``
replaces the runs by their merge.

Each level keeps a winner that merges associatively, commutatively and idempotently, so neither the order of arrival, nor how the
feed is cut into batches, nor a repeated batch changes the result:

* per entry: the copy that arrived first (ties, and copies without arrival time: the least by their columns);
* per transaction: the committed entry with the smallest ``entry_id`` and, as stand-ins for an unknown
  operation or an empty document id, the entries with the smallest ``entry_id`` that name one;
* per document: the effect with the greatest sequence (the ``entry_id`` of the commit).

Defined results for untidy input: rows without ``entry_id`` are ignored; a missing or blank status
means committed; a null or blank operation is unknown; an entry without ``tx_id`` is a transaction of
its own; an empty feed gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardlight.folder import Folder
from shardlight.runtime import WHITESPACE, shared_dir, stored

RECORD = "entry_id long, arrived_at timestamp_ntz, tx_id string, operation string, doc_id string, status string"


def _trim(c):
    return F.btrim(c, F.lit(WHITESPACE))


def _filled(c):
    """The trimmed value, null where blank."""
    t = _trim(c)
    return F.when(F.length(t) > 0, t)


def records(feed: DataFrame) -> DataFrame:
    """Rows of the feed with tidy columns."""
    arrival = F.col("arrived_at") if "arrived_at" in feed.columns else F.lit(None)
    tidy = feed.where(F.col("entry_id").isNotNull()).select(
        F.col("entry_id").cast("long").alias("entry_id"), arrival.cast("timestamp_ntz").alias("arrived_at"),
        F.coalesce(_filled(F.col("tx_id")), F.concat(F.lit("legacy-"), F.col("entry_id").cast("string"))).alias("tx_id"),
        F.lower(_filled(F.col("operation"))).alias("operation"),
        _filled(F.col("doc_id")).alias("doc_id"),
        F.coalesce(F.lower(_filled(F.col("status"))), F.lit("committed")).alias("status"),
    )
    return tidy.withColumn("operation", F.when(F.col("operation") != "unknown", F.col("operation")))


def winners(rows: DataFrame, *within: str) -> DataFrame:
    """One record an entry: the copy that arrived first."""
    order = F.struct("arrived_at", "tx_id", "operation", "doc_id", "status")
    return rows.groupBy(*within, "entry_id").agg(F.min(order).alias("r")).select(*within, "entry_id", "r.*")


def normalise_entries(feed: DataFrame) -> DataFrame:
    """Entries with tidy columns, one row an ``entry_id``."""
    return winners(records(feed)).drop("arrived_at")


def _least(condition, *fields):
    return F.min(F.when(condition, F.struct("entry_id", *fields)))


def transaction_states(entries: DataFrame) -> DataFrame:
    """One mergeable state a transaction."""
    return entries.groupBy("tx_id").agg(
        _least(F.col("status") == "committed", "operation", "doc_id").alias("done"),
        _least(F.col("operation").isNotNull(), "operation").alias("named_op"),
        _least(F.col("doc_id").isNotNull(), "doc_id").alias("named_doc"),
    )


def effects(states: DataFrame) -> DataFrame:
    """The effect of each committed transaction: (doc_id, seq, operation)."""
    return states.where(F.col("done").isNotNull()).select(
        F.coalesce("done.doc_id", "named_doc.doc_id").alias("doc_id"),
        F.col("done.entry_id").alias("seq"),
        F.coalesce("done.operation", "named_op.operation").alias("operation"),
    ).where(F.col("doc_id").isNotNull() & F.col("operation").isNotNull())


def newest(changes: DataFrame) -> DataFrame:
    """Merge of change runs: the record with the greatest sequence of each document, tombstones kept."""
    return (
        changes.groupBy("doc_id")
        .agg(F.max(F.struct("seq", "operation")).alias("r"))
        .select("doc_id", "r.seq", "r.operation")
    )


def alive(changes: DataFrame) -> DataFrame:
    """Documents whose newest change is no tombstone."""
    return newest(changes).where(F.col("operation") != "delete")


class RunStore:
    """Append-only sorted runs of entry records under one folder, and below them a level of settled documents.

    A run is visible once a numbered manifest lists it. Manifests are only ever added, each by the one writer that makes its
    number first; a writer that comes second reads again and tries the next. A lost executor or a retried batch leaves at most an unlisted
    folder behind. Runs that a compaction replaced are deleted by the compaction after it, so that readers can finish.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
        self.folder = Folder(spark, self.path)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    # -- manifest -----------------------------------------------------------------------------
    def manifest(self) -> dict:
        return json.loads(self.folder.latest("manifest")[1] or '{"runs": [], "base": null, "dead": []}')

    def runs(self) -> list[str]:
        return self.manifest()["runs"]

    def _publish(self, change) -> None:
        """Makes the next manifest by ``change(manifest)``, again if another writer was first."""
        while True:
            number, text = self.folder.latest("manifest")
            known = json.loads(text) if text else self.manifest()
            if self.folder.publish("manifest", number + 1, json.dumps(change(known))):
                return

    # -- writes -------------------------------------------------------------------------------
    def _write(self, entries: DataFrame, name: str) -> str:
        entries.repartition(self.buckets, "entry_id").sortWithinPartitions("entry_id").write.parquet(f"{self.path}/{name}")
        return name

    def append(self, feed: DataFrame) -> str:
        """Reduce one batch of the feed to a sorted run and publish it."""
        name = self._write(winners(records(feed)), f"run-{uuid.uuid4().hex}")
        self._publish(lambda m: {**m, "runs": [*m["runs"], name]})
        return name

    def append_slices(self, feed: DataFrame, number, count: int) -> list[str]:
        """Batches of one feed (``number``: a column from 0 to ``count`` - 1) as a run each, written in one pass."""
        group = f"slices-{uuid.uuid4().hex}"
        rows = records(feed).withColumn("slice", number)
        (
            winners(rows, "slice").repartition(self.buckets, "entry_id").sortWithinPartitions("slice", "entry_id")
            .write.partitionBy("slice").parquet(f"{self.path}/{group}")
        )
        have = set(self.folder.names(group))
        names = [f"{group}/slice={i}" for i in range(count) if f"slice={i}" in have]
        self._publish(lambda m: {**m, "runs": [*m["runs"], *names]})
        return names

    def compact(self, settled_before: int | None = None) -> str | None:
        """Replace all runs by their merge.

        With ``settled_before`` the caller promises that no entry below this number, and no further entry of a transaction
        committed below it, will arrive. Those transactions leave the runs for a level of documents,
        in which only the newest effect is kept and no tombstone.
        """
        seen = self.manifest()
        if settled_before is None and len(seen["runs"]) < 2:
            return seen["runs"][0] if seen["runs"] else None
        entries, base = self.merged(), None
        if settled_before is not None:
            entries = stored(entries, "merged")
            states = transaction_states(entries)
            early = lambda c: F.col(f"{c}.entry_id") < settled_before
            known = (F.col("done.operation").isNotNull() | F.coalesce(early("named_op"), F.lit(False))) & (
                F.col("done.doc_id").isNotNull() | F.coalesce(early("named_doc"), F.lit(False))
            )
            final = states.where(F.coalesce(early("done"), F.lit(False)) & known)
            base = f"base-{uuid.uuid4().hex}"
            # a tombstone stays as long as a committed transaction of unknown effect could still put an older record behind it
            unknown = states.where(early("done") & ~known).agg(F.min("done.entry_id")).first()[0]
            standing = F.lit(False) if unknown is None else F.col("seq") > unknown
            level = newest(self._with_base(effects(final), seen)).where((F.col("operation") != "delete") | standing)
            level.repartition(self.buckets, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{self.path}/{base}")
            entries = entries.join(final.select("tx_id"), "tx_id", "left_anti").select("entry_id", "arrived_at", "tx_id", "operation", "doc_id", "status")
        name = self._write(entries, f"run-{uuid.uuid4().hex}")
        replaced = set(seen["runs"])
        gone = [*seen["runs"], *([seen["base"]] if base and seen["base"] else [])]
        self._publish(lambda m: {"runs": [name, *[r for r in m["runs"] if r not in replaced]], "base": base or m["base"], "dead": gone})
        for run in seen["dead"]:
            self.folder.delete(run)
        return name

    # -- reads --------------------------------------------------------------------------------
    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in paths])

    def merged(self) -> DataFrame:
        """Merge of all runs by entry."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], RECORD)
        rows = self._read(runs, RECORD)
        return rows if len(runs) == 1 else winners(rows)

    def _with_base(self, changes: DataFrame, manifest: dict) -> DataFrame:
        if not manifest["base"]:
            return changes
        return changes.unionByName(self._read([manifest["base"]], "doc_id string, seq long, operation string"))

    def changes(self) -> DataFrame:
        """All effects: (doc_id, seq, operation)."""
        return self._with_base(effects(transaction_states(self.merged())), self.manifest())

    def current(self) -> DataFrame:
        """Documents alive now, with the sequence that made each current."""
        return alive(self.changes())


def arrival_slice(feed: DataFrame, batches: int):
    """A column that numbers ``batches`` consecutive slices of the arrival time; rows without one are in the first."""
    bounds = feed.agg(F.min("arrived_at").alias("a"), F.max("arrived_at").alias("b")).first()
    if bounds["a"] is None or batches < 2 or bounds["a"] == bounds["b"]:
        return F.lit(0), 1
    start, length = (F.unix_micros(F.lit(t).cast("timestamp_ntz").cast("timestamp")) for t in (bounds["a"], bounds["b"]))
    at = F.unix_micros(F.col("arrived_at").cast("timestamp"))
    part = F.floor((at - start) * batches / (length - start + 1)).cast("int")
    return F.coalesce(part, F.lit(0)), batches


def replay(feed: DataFrame, batches: int = 4) -> RunStore:
    """Append the feed as runs in order of arrival, then compact them."""
    store = RunStore(feed.sparkSession)
    store.append_slices(feed, *arrival_slice(feed, batches))
    store.compact()
    return store
