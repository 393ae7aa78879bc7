"""The vector store: tables under one root, transactions without a table format, and the engine's API.

Tables are append-only Parquet folders of the current *generation*; every row carries the transaction that wrote it::

    root/CURRENT-<number>              name of the generation, the greatest number counts
    root/gen-<id>/chunks/              chunk rows with their vectors, partitioned by shard_id
    root/gen-<id>/tombstones/          deleted chunks
    root/gen-<id>/txlog/               transaction log
    root/gen-<id>/INDEX-<number>       name of the stored index
    root/gen-<id>/index-<id>/          centroids, vectors by bucket, and the transactions they come from

A row is visible if its transaction is committed in the log, so an interrupted write is invisible whatever files it left;
an update is one transaction that writes tombstones and new chunks together. Vacuum and clear write a new generation and then
publish its name. One writer holds the lock file, refreshes it while it works and looks once more before it commits.

A search reads the vectors of the probed buckets, and those of transactions that the index doesn't hold, so a document is found as soon as it is
committed, whether or not the index was rebuilt; a write adds its own chunks to the index under the stored centroids.
"""

from __future__ import annotations

import json
import logging
import threading
import time
import uuid
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardlight.config import Conflict, EngineOptions, NotFound, TooLarge, check_top_k
from shardlight.folder import Folder
from shardlight.functions import embedding
from shardlight.functions.metadata import metadata_filter
from shardlight.functions.scalars import half_precision, memory_string, preview, shard_of, strip
from shardlight.operators import chunker, index, search, stats, txlog
from shardlight.runtime import ship, stored

log = logging.getLogger("shardlight")

_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "timestamp_ntz": T.TimestampNTZType(),
    "array<float>": T.ArrayType(T.FloatType()),
}


def _now():
    return F.to_timestamp_ntz(F.current_timestamp().cast("string"))


def _schema(ddl: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in ddl.split(", "))])


CHUNKS = _schema(
    "chunk_id string, doc_id string, text string, text_length int, start_idx int, end_idx int, vector_idx long, metadata string, "
    "created_at timestamp_ntz, vector array<float>, write_tx string, shard_id int"
)
TOMBSTONES = _schema("chunk_id string, document_id string, deleted_at timestamp_ntz, reason string, restored boolean, write_tx string")
INDEXED = _schema("chunk_id string, vector_idx long, vector array<float>, bucket_id int")
EVENTS = "at timestamp_ntz, event string, fields string"
TXLOG = _schema("entry_id long, tx_id string, operation string, doc_id string, logged_at timestamp_ntz, status string, details string, checksum string")


class WriterLock:
    """An exclusive lock file with its owner's token, refreshed by a thread while it is held; a lock that nobody has refreshed for
    ``timeout`` seconds is stale and may be taken."""

    def __init__(self, folder: Folder, timeout: float, name: str = "LOCK"):
        self.folder, self.timeout, self.name, self.token = folder, timeout, name, uuid.uuid4().hex
        self._stop = threading.Event()

    def __enter__(self) -> WriterLock:
        limit = time.monotonic() + self.timeout
        while not self.folder.create(self.name, self.token):
            try:
                stale = self.folder.age(self.name) > self.timeout
            except Exception:  # gone meanwhile, or not readable: look again
                stale = False
            if stale:
                self.folder.delete(self.name)
            elif time.monotonic() > limit:
                raise TimeoutError(f"another writer holds {self.folder.root}/{self.name}") from None
            else:
                time.sleep(0.05)
        threading.Thread(target=self._beat, daemon=True).start()
        return self

    @property
    def released(self) -> bool:
        return self._stop.is_set()

    def _beat(self) -> None:
        while not self._stop.wait(self.timeout / 4):
            try:
                self.refresh()
            except Exception:
                log.warning("the lock could not be refreshed", exc_info=True)

    def refresh(self) -> None:
        if self.owned():
            self.folder.touch(self.name)

    def owned(self) -> bool:
        try:
            return self.folder.exists(self.name) and self.folder.read(self.name) == self.token
        except FileNotFoundError:
            return False

    def check(self) -> None:
        if not self.owned():
            raise TimeoutError("the lock was lost to another writer; nothing is committed")

    def __exit__(self, *_: Any) -> None:
        self._stop.set()
        if self.owned():
            self.folder.delete(self.name)


class Engine:
    """Documents in, similar chunks out. ``root`` is a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, options: EngineOptions | None = None, provider: Callable | None = None):
        ship(spark)
        started = time.perf_counter()
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = Folder(spark, self.root)
        self.options = options or EngineOptions()
        self.provider = provider or embedding.provider(self.options.provider, self.options.dimension)
        self._held: WriterLock | None = None
        self.startup: dict = {}
        if not self.folder.latest("CURRENT")[1]:
            self._switch(self._new_generation())
        report = self.recover().first().asDict()
        self.startup = {**report, "startup_ms": round((time.perf_counter() - started) * 1000, 3), "memory": memory_string(*stats.memory_bytes())}
        log.info(json.dumps({"event": "startup", **self.startup}))

    # -- generations --------------------------------------------------------------------------------------------------------
    def _new_generation(self) -> str:
        name = f"gen-{uuid.uuid4().hex}"
        for t in ("chunks", "tombstones", "txlog", "events"):
            self.folder.mkdirs(f"{name}/{t}")
        return name

    def _switch(self, name: str) -> None:
        number = self.folder.latest("CURRENT")[0] + 1
        if not self.folder.publish("CURRENT", number, name) and number > 1:  # the first may have come from another process
            raise OSError("another writer published a generation")

    @property
    def generation(self) -> str:
        return f"{self.root}/{self.folder.latest('CURRENT')[1]}"

    def _lock(self) -> WriterLock:
        self._held = WriterLock(self.folder, self.options.lock_timeout_seconds)
        return self._held

    def locks(self) -> DataFrame:
        """(resource, age_seconds, stale): the locks held on this store, by whichever process."""
        rows = []
        for name in self.folder.names():
            if name == "LOCK":
                age = self.folder.age(name)
                rows.append((name, float(age), age > self.options.lock_timeout_seconds))
        return self.spark.createDataFrame(rows, "resource string, age_seconds double, stale boolean")

    def _read(self, path: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path)

    # -- transaction log ------------------------------------------------------------------------------------------------------
    def log(self) -> DataFrame:
        return self._read(f"{self.generation}/txlog", TXLOG)

    def _append_log(self, tx: str, operation: str, doc_id: str, status: str, details: dict, generation: str | None = None) -> None:
        last = self.log().agg(F.max("entry_id")).first()[0] or 0
        row = [(last + 1, tx, operation, doc_id, status, json.dumps(details, sort_keys=True))]
        df = self.spark.createDataFrame(row, "entry_id long, tx_id string, operation string, doc_id string, status string, details string")
        df = txlog.with_checksum(df.withColumn("logged_at", _now()))
        df.select(*TXLOG.names).coalesce(1).write.mode("append").parquet(f"{generation or self.generation}/txlog")

    def _transaction(self, operation: str, doc_id: str, write: Callable[[str], dict]) -> dict:
        tx = f"{time.time_ns() // 1000}-{uuid.uuid4().hex[:8]}"
        self._append_log(tx, operation, doc_id, "pending", {})
        try:
            details = write(tx)
            if self._held is not None and not self._held.released:
                self._held.check()
        except Exception as e:
            self._append_log(tx, operation, doc_id, "failed", {"error": str(e)[:500]})
            raise
        self._append_log(tx, operation, doc_id, "committed", details)
        return details

    def _committed(self) -> DataFrame:
        return self.log().where("status = 'committed'").select(F.col("tx_id").alias("write_tx")).distinct()

    def recover(self) -> DataFrame:
        """Report of unfinished transactions; what they wrote stays invisible."""
        return txlog.recovery_report(self.log())

    def verify_log(self) -> DataFrame:
        return txlog.verify(self.log())

    def invalid_log_entries(self) -> DataFrame:
        return txlog.invalid_entries(self.log())

    def log_stats(self) -> DataFrame:
        return txlog.counts(self.log())

    def clear_log(self) -> None:
        """Forgets the history: committed data is rewritten as one transaction, whose entry is all the new log has."""
        self.vacuum(days=None)

    # -- events ---------------------------------------------------------------------------------------------------------------
    def _event(self, event: str, **fields: Any) -> None:
        """A structured line to the log; with the option ``record_events`` also a row of :meth:`events`."""
        line = json.dumps(fields, sort_keys=True, default=str)
        log.info('{"event": "%s", "fields": %s}', event, line)
        if self.options.record_events:
            row = self.spark.createDataFrame([(event, line)], "event string, fields string").withColumn("at", _now())
            row.select("at", "event", "fields").coalesce(1).write.mode("append").parquet(f"{self.generation}/events")

    def events(self) -> DataFrame:
        """(at, event, fields JSON): searches with latency, index hit rate and candidates; ingestions with time and chunks."""
        return self.spark.read.schema(EVENTS).parquet(f"{self.generation}/events")

    # -- visible state ----------------------------------------------------------------------------------------------------------
    def all_chunks(self) -> DataFrame:
        """Chunks of committed transactions, deleted ones too."""
        return self._read(f"{self.generation}/chunks", CHUNKS).join(self._committed(), "write_tx", "left_semi")

    def tombstones(self) -> DataFrame:
        """The first standing tombstone of each chunk: committed, and not followed by a restore."""
        rows = self._read(f"{self.generation}/tombstones", TOMBSTONES).join(self._committed(), "write_tx", "left_semi")
        last = rows.groupBy("chunk_id").agg(F.max(F.when(F.col("restored"), F.col("deleted_at"))).alias("_r"))
        standing = rows.where(~F.col("restored")).join(last, "chunk_id").where("_r IS NULL OR deleted_at > _r")
        first = standing.groupBy("chunk_id").agg(F.min(F.struct("deleted_at", "document_id", "reason", "write_tx")).alias("r"))
        return first.select("chunk_id", "r.document_id", "r.deleted_at", "r.reason", "r.write_tx")

    def chunks(self) -> DataFrame:
        """Active chunks."""
        return self.all_chunks().join(self.tombstones().select("chunk_id"), "chunk_id", "left_anti")

    def document_exists(self, doc_id: str) -> bool:
        return not self.chunks().where(F.col("doc_id") == doc_id).limit(1).isEmpty()

    # -- writing ----------------------------------------------------------------------------------------------------------------
    def _prepare(self, documents: DataFrame, replace: bool = False) -> tuple[DataFrame, DataFrame]:
        """(accepted documents, status of all): each document is judged on its own. With ``replace`` one that exists is no error."""
        docs = documents.select(
            strip(F.col("doc_id")).alias("doc_id"), "text", (F.col("metadata") if "metadata" in documents.columns else F.lit("{}")).alias("metadata")
        )
        taken = self.chunks().select("doc_id").distinct().withColumn("_taken", F.lit(True))
        judged = docs.join(taken, "doc_id", "left").withColumn(
            "error",
            F.when(F.col("doc_id").isNull() | (F.col("doc_id") == ""), "blank document id")
            .when(F.length("text") > self.options.max_text_size, "MAX_TEXT_SIZE exceeded")
            .when(F.col("_taken") & F.lit(not replace), "document exists")
            .when(F.coalesce(F.length(strip(F.col("text"))), F.lit(0)) == 0, "no chunks"),
        )
        accepted = judged.where("error IS NULL").select("doc_id", "text", "metadata")
        status = judged.select("doc_id", F.when(F.col("error").isNull(), "success").otherwise("failed").alias("status"), "error")
        return accepted, status

    def _chunk_rows(self, documents: DataFrame, tx: str) -> DataFrame:
        """Chunk, embed, quantise and place documents.

        A chunk id is document, version and number of the chunk; the version counts the times the document was written before.
        """
        o = self.options
        part = F.try_element_at(F.split("chunk_id", "#"), F.lit(-2)).try_cast("int")
        before = self.all_chunks().join(documents.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max(part).alias("_v"))
        about = documents.join(before, "doc_id", "left").select("doc_id", "metadata", (F.coalesce("_v", F.lit(0)) + 1).alias("_version"))
        pieces = chunker.chunk(documents, "doc_id", "text", o.chunk_size, o.overlap)
        vectors = embedding.embed(pieces, "text", self.provider)
        vector = half_precision(F.col("vector")) if o.half_precision else F.col("vector")
        rows = vectors.join(about, "doc_id").select(
            F.concat_ws("#", "doc_id", "_version", "chunk_no").alias("chunk_id"), "doc_id", "text", F.length("text").alias("text_length"),
            "start_idx", "end_idx", "metadata", _now().alias("created_at"), vector.alias("vector"), F.lit(tx).alias("write_tx"),
            shard_of(F.col("doc_id"), o.shard_count).alias("shard_id"),
        )
        return rows.withColumn("vector_idx", F.lit(self.next_vector_index()) + F.monotonically_increasing_id()).select(*CHUNKS.names)

    def next_vector_index(self) -> int:
        """One more than the greatest index ever used. Indices rise but leave gaps, so no global numbering is needed."""
        last = self._read(f"{self.generation}/chunks", CHUNKS).agg(F.max("vector_idx")).first()[0]
        return 0 if last is None else last + 1

    def _write_chunks(self, rows: DataFrame) -> None:
        rows.repartition("shard_id").write.mode("append").partitionBy("shard_id").parquet(f"{self.generation}/chunks")

    def ingest(self, documents: DataFrame, limit_batch: bool = True, operation: str = "batch_insert") -> DataFrame:
        """Adds documents (doc_id, text, metadata JSON): (doc_id, status, error) of each; failures leave the others alone.

        ``limit_batch`` applies the request limit; bulk loads switch it off.
        """
        if limit_batch:
            size = documents.limit(self.options.max_batch_size + 1).count()
            if size > self.options.max_batch_size:
                raise TooLarge(f"more than {self.options.max_batch_size} documents in a batch")
        started = time.perf_counter()
        again = documents.groupBy(strip(F.col("doc_id")).alias("d")).count().where("count > 1")
        if not again.isEmpty():
            raise Conflict("a document id is repeated in the batch")
        with self._lock():
            accepted, status = self._prepare(documents)
            result = self.spark.createDataFrame(status.collect(), status.schema) if limit_batch else None  # at most a batch

            def write(tx: str) -> dict:
                self._write_chunks(self._chunk_rows(accepted, tx))
                written = self._read(f"{self.generation}/chunks", CHUNKS).where(F.col("write_tx") == tx)
                n = written.agg(F.countDistinct("doc_id").alias("d"), F.count(F.lit(1)).alias("c")).first()
                return {"documents": n["d"], "chunks": n["c"], "tx": tx}

            details = self._transaction(operation, "", write)
            self._index_new(details["tx"])
        self.last_batch = {
            "documents": details["documents"], "total_chunks": details["chunks"], "total_time_ms": round((time.perf_counter() - started) * 1000, 3)
        }
        self._event("ingestion", operation=operation, **self.last_batch)
        if result is not None:
            return result
        done = self.all_chunks().where(F.col("write_tx") == details["tx"]).select("doc_id").distinct().withColumn("_ok", F.lit(True))
        return documents.select(strip(F.col("doc_id")).alias("doc_id")).join(done, "doc_id", "left").select(
            "doc_id", F.when(F.col("_ok"), "success").otherwise("failed").alias("status"), F.when(F.col("_ok").isNull(), "rejected").alias("error")
        )

    def ingest_one(self, doc_id: str, text: str, metadata: dict | None = None) -> int:
        """Adds one document; its number of chunks."""
        df = self.spark.createDataFrame([(doc_id, text, json.dumps(metadata or {}))], "doc_id string, text string, metadata string")
        row = self.ingest(df, operation="insert").first()
        if row["status"] == "failed":
            raise (TooLarge if "SIZE" in row["error"] else Conflict)(row["error"])
        return self.chunks().where(F.col("doc_id") == doc_id.strip()).count()

    def batch_summary(self, status: DataFrame) -> DataFrame:
        """One row for the statuses that :meth:`ingest` returned: documents processed, succeeded and failed, chunks they have, time."""
        own = self.chunks().join(status.where("status = 'success'").select(strip(F.col("doc_id")).alias("doc_id")), "doc_id", "left_semi")
        counted = status.agg(
            F.count(F.lit(1)).alias("documents_processed"), F.count_if(F.col("status") == "success").alias("succeeded"),
            F.count_if(F.col("status") == "failed").alias("failed"),
        )
        return counted.join(F.broadcast(own.agg(F.count(F.lit(1)).alias("total_chunks"))), F.lit(True)).withColumn(
            "total_time_ms", F.lit(self.last_batch["total_time_ms"])
        )

    def _stones(self, doc_id: str, tx: str, reason: str) -> DataFrame:
        return self.chunks().where(F.col("doc_id") == doc_id).select(
            "chunk_id", F.col("doc_id").alias("document_id"), _now().alias("deleted_at"),
            F.lit(reason).alias("reason"), F.lit(False).alias("restored"), F.lit(tx).alias("write_tx"),
        )

    def _delete_in(self, doc_id: str, tx: str, reason: str) -> None:
        self._stones(doc_id, tx, reason).coalesce(1).write.mode("append").parquet(f"{self.generation}/tombstones")

    def delete(self, doc_id: str, reason: str = "user_delete") -> int:
        """Tombstones every active chunk of a document; how many."""
        with self._lock():
            n = self.chunks().where(F.col("doc_id") == doc_id).count()
            if not n:
                raise NotFound(doc_id)

            def write(tx: str) -> dict:
                self._delete_in(doc_id, tx, reason)
                return {"chunks": n}

            self._transaction("delete", doc_id, write)
            return n

    def update(self, doc_id: str, text: str, metadata: dict | None = None) -> int:
        """Replaces a document in one transaction; validated before anything is written."""
        if len(text) > self.options.max_text_size:
            raise TooLarge("MAX_TEXT_SIZE exceeded")
        if not text.strip():
            raise Conflict("no chunks")
        with self._lock():
            if not self.document_exists(doc_id):
                raise NotFound(doc_id)
            df = self.spark.createDataFrame([(doc_id, text, json.dumps(metadata or {}))], "doc_id string, text string, metadata string")

            def write(tx: str) -> dict:
                self._delete_in(doc_id, tx, "update")
                self._write_chunks(self._chunk_rows(df, tx))
                return {"tx": tx}

            done = self._transaction("update", doc_id, write)
            self._index_new(done["tx"])
        return self.chunks().where(F.col("doc_id") == doc_id).count()

    def upsert(self, documents: DataFrame) -> DataFrame:
        """Adds documents, and replaces those that exist, in one transaction: (doc_id, status, error) of each. Rejected ones change nothing.
        The same documents again make a new version of each, with the same content."""
        docs = documents.withColumn("doc_id", strip(F.col("doc_id")))
        if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
            raise Conflict("a document id is repeated in the batch")
        with self._lock():
            accepted, status = self._prepare(docs, replace=True)
            status = stored(status, "status")

            def write(tx: str) -> dict:
                gone = self.chunks().join(accepted.select("doc_id"), "doc_id", "left_semi").select(
                    "chunk_id", F.col("doc_id").alias("document_id"), _now().alias("deleted_at"), F.lit("update").alias("reason"),
                    F.lit(False).alias("restored"), F.lit(tx).alias("write_tx"),
                )
                gone.write.mode("append").parquet(f"{self.generation}/tombstones")
                self._write_chunks(self._chunk_rows(accepted, tx))
                return {"tx": tx}

            self._index_new(self._transaction("upsert", "", write)["tx"])
        return status

    def restore(self, doc_id: str) -> int:
        """Takes the standing tombstones of a document back; how many chunks came back."""
        with self._lock():
            stones = self.tombstones().where(F.col("document_id") == doc_id)
            n = stones.count()
            if not n:
                raise NotFound(doc_id)

            def write(tx: str) -> dict:
                rows = stones.select(
                    "chunk_id", "document_id", _now().alias("deleted_at"), F.lit("restore").alias("reason"),
                    F.lit(True).alias("restored"), F.lit(tx).alias("write_tx"),
                )
                rows.coalesce(1).write.mode("append").parquet(f"{self.generation}/tombstones")
                return {"chunks": n}

            self._transaction("restore", doc_id, write)
            return n

    def vacuum(self, days: int | None = 30, shard=None) -> int:
        """Drops chunks deleted more than ``days`` ago with their tombstones (all if 0; none if null) and all invisible rows.

        Writes a new generation with a log of one entry, the index and the manifest, then switches. ``shard`` is another placement of the
        chunks. Returns the number of purged tombstones.
        """
        with self._lock():
            old, stones = self.generation, self.tombstones()
            gone = stones.where(F.lit(False) if days is None else F.col("deleted_at") <= _now() - F.make_interval(days=F.lit(days)))
            n = gone.count()
            name = self._new_generation()
            tx = f"vacuum-{uuid.uuid4().hex}"
            kept = self.all_chunks().join(gone.select("chunk_id"), "chunk_id", "left_anti").withColumn("write_tx", F.lit(tx))
            kept = (kept if shard is None else kept.withColumn("shard_id", shard)).select(*CHUNKS.names)
            kept.repartition("shard_id").write.mode("append").partitionBy("shard_id").parquet(f"{self.root}/{name}/chunks")
            left = stones.join(gone.select("chunk_id"), "chunk_id", "left_anti").withColumn("restored", F.lit(False)).withColumn("write_tx", F.lit(tx))
            left.select(*TOMBSTONES.names).write.mode("append").parquet(f"{self.root}/{name}/tombstones")
            self._append_log(tx, "vacuum", "", "committed", {"purged": n}, f"{self.root}/{name}")
            self._copy_index(name, tx)
            if self.folder.exists(f"{old[len(self.root) + 1:]}/manifest"):
                self._files_of(f"{self.root}/{name}").write.mode("overwrite").parquet(f"{self.root}/{name}/manifest")
            self._held.check()
            self._switch(name)
            self.folder.delete(old[len(self.root) + 1 :])
            return n

    def clear(self, confirm: bool = False) -> None:
        """Removes everything."""
        if not confirm:
            raise ValueError("clear needs confirm=True")
        with self._lock():
            old = self.generation
            self._switch(self._new_generation())
            self.folder.delete(old[len(self.root) + 1 :])

    # -- index ------------------------------------------------------------------------------------------------------------------
    def _index_folder(self, generation: str | None = None) -> str | None:
        generation = generation or self.generation
        name = Folder(self.spark, generation).latest("INDEX")[1]
        return f"{generation}/{name}" if name else None

    def _publish_index(self, generation: str, name: str) -> None:
        at = Folder(self.spark, generation)
        if not at.publish("INDEX", at.latest("INDEX")[0] + 1, name):
            raise OSError("another writer published an index")

    def _write_index(self, placed: DataFrame, txs: DataFrame, folder: str) -> None:
        """Vectors by bucket, so that a search reads the files of its buckets only; a large bucket makes several files."""
        spread_ = F.pmod(F.xxhash64("chunk_id"), F.lit(8))
        rows = placed.select(*INDEXED.names).repartition("bucket_id", spread_)
        rows.write.mode("append").partitionBy("bucket_id").parquet(f"{folder}/vectors")
        txs.select("write_tx").coalesce(1).write.mode("append").parquet(f"{folder}/covered")

    def _centroids(self, folder: str) -> np.ndarray | None:
        if not Folder(self.spark, folder).exists("centroids"):
            return None
        rows = self.spark.read.parquet(f"{folder}/centroids").orderBy("bucket_id").collect()  # at most num_buckets
        return np.array([r["centroid"] for r in rows])

    def _placed(self, rows: DataFrame, folder: str) -> DataFrame:
        """``rows`` (chunk_id, vector_idx, vector) with the bucket the stored index gives them."""
        centroids = self._centroids(folder)
        if centroids is None:
            return rows.withColumn("bucket_id", index.hash_bucket(F.col("vector"), self.options.num_buckets))
        return rows.join(index.assign(rows, "chunk_id", "vector", centroids), "chunk_id")

    def rebuild_index(self) -> DataFrame:
        """Builds the index over the active chunks and stores it: one row of statistics."""
        rows = self.chunks().select("vector_idx", "chunk_id", "vector")
        txs = self.all_chunks().select("write_tx").distinct()
        name = f"index-{uuid.uuid4().hex}"
        folder = f"{self.generation}/{name}"
        if self.options.index_type == "centroid" and rows.limit(2).count() >= 2:
            built = index.build_centroid_index(rows, "chunk_id", "vector", self.options.num_buckets, self.options.kmeans_rounds)
            built.centroid_rows().coalesce(1).write.mode("overwrite").parquet(f"{folder}/centroids")
            self._write_index(rows.join(built.assignments, "chunk_id"), txs, folder)
            result = built.stats()
        else:
            placed = rows.withColumn("bucket_id", index.hash_bucket(F.col("vector"), self.options.num_buckets))
            self._write_index(placed, txs, folder)
            result = placed.agg(
                F.lit("bucket").alias("index_type"), F.lit(self.options.num_buckets).cast("long").alias("num_buckets"), F.count(F.lit(1)).alias("indexed"),
                F.countDistinct("bucket_id").alias("non_empty_buckets"),
            )
        old = self._index_folder()
        self._publish_index(self.generation, name)
        if old:
            self.folder.delete(old[len(self.root) + 1 :])
        return result

    def clear_index(self) -> None:
        """Forgets the stored index; searches read all chunks until it is built again."""
        old = self._index_folder()
        self._publish_index(self.generation, "")
        if old:
            self.folder.delete(old[len(self.root) + 1 :])

    def _index_new(self, tx: str) -> None:
        """Adds the chunks of a committed transaction to the stored index, under its centroids. Until then a search reads them apart."""
        folder = self._index_folder()
        if folder:
            rows = self._read(f"{self.generation}/chunks", CHUNKS).where(F.col("write_tx") == tx).select("chunk_id", "vector_idx", "vector")
            self._write_index(self._placed(rows, folder), self.spark.createDataFrame([(tx,)], "write_tx string"), folder)

    def _copy_index(self, generation: str, tx: str) -> None:
        """The stored index for the rows of a new generation: known chunks keep their bucket, others get one."""
        old = self._index_folder()
        if not old:
            return
        name = f"index-{uuid.uuid4().hex}"
        folder = f"{self.root}/{generation}/{name}"
        if Folder(self.spark, old).exists("centroids"):
            self.spark.read.parquet(f"{old}/centroids").coalesce(1).write.parquet(f"{folder}/centroids")
        rows = self._read(f"{self.root}/{generation}/chunks", CHUNKS).select("chunk_id", "vector_idx", "vector")
        have = self._read(f"{old}/vectors", INDEXED).select("chunk_id", "bucket_id").distinct()
        known = rows.join(have, "chunk_id")
        rest = self._placed(rows.join(have, "chunk_id", "left_anti"), folder)
        self._write_index(known.unionByName(rest), self.spark.createDataFrame([(tx,)], "write_tx string"), folder)
        self._publish_index(f"{self.root}/{generation}", name)

    def _candidates(self, query: list[float]) -> DataFrame | None:
        """(chunk_id, vector) of the active chunks in the probed buckets and of those the index doesn't hold, or None without an index."""
        folder = self._index_folder()
        if folder is None:
            return None
        centroids = self._centroids(folder)
        if centroids is not None:
            probes = index.CentroidIndex(centroids, None, "chunk_id").probes(query, self.options.probe_count)
        else:
            q = self.spark.range(1).select(index.hash_bucket(F.array(*[F.lit(float(x)) for x in query]), self.options.num_buckets).alias("b"))
            probes = q.select(index.hash_probes(F.col("b"), self.options.num_buckets).alias("p")).first()["p"]
        inside = self._read(f"{folder}/vectors", INDEXED).where(F.col("bucket_id").isin([int(p) for p in probes])).select("chunk_id", "vector")
        covered = self.spark.read.schema("write_tx string").parquet(f"{folder}/covered").distinct()
        outside = self.all_chunks().join(covered, "write_tx", "left_anti").select("chunk_id", "vector")
        # a write that was interrupted after its commit can be in both
        return inside.unionByName(outside).dropDuplicates(["chunk_id"]).join(self.tombstones().select("chunk_id"), "chunk_id", "left_anti")

    # -- reading ------------------------------------------------------------------------------------------------------------------
    def embed_query(self, query: str) -> list[float]:
        return [float(x) for x in self.provider([query])[0]]

    def search(self, query: str, top_k: int = 5, metadata: dict | None = None) -> DataFrame:
        """(chunk_id, doc_id, text, score, metadata): exact with a filter, else through the index (falling back to all chunks)."""
        check_top_k(top_k)
        if not query:
            raise ValueError("the query is empty")
        started = time.perf_counter()
        q = self.embed_query(query)
        found, met = None, None
        if not metadata:
            candidates = self._candidates(q)
            if candidates is not None:
                found = search.best_keys(candidates, "chunk_id", "vector", q, top_k).collect()  # at most top_k, 100
                met = candidates
        if not found:  # no index, nothing in its buckets, or a filter
            where = metadata_filter(F.col("metadata"), metadata) if metadata else None
            met = self.chunks() if where is None else self.chunks().where(where)
            found = search.best_keys(met, "chunk_id", "vector", q, top_k).collect()
        scores = self.spark.createDataFrame([(r["chunk_id"], r["score"]) for r in found], "chunk_id string, score double")
        rows = self.all_chunks().where(F.col("chunk_id").isin([r["chunk_id"] for r in found])) if found else self.all_chunks().limit(0)
        result = rows.join(F.broadcast(scores), "chunk_id").orderBy(F.desc(F.round("score", 12)), "chunk_id")
        event = {"query": query[:50], "top_k": top_k, "results": len(found), "search_latency_ms": round((time.perf_counter() - started) * 1000, 3)}
        if self.options.record_events:  # counting the candidates is a job of its own
            n, stored_chunks = met.count(), self.all_chunks().count()
            event |= {"candidate_count": n, "index_hit_rate": n / max(1, stored_chunks)}
        self._event("search", **event)
        return result.select("chunk_id", "doc_id", "text", "score", "metadata")

    def search_batch(self, queries: DataFrame, top_k: int = 5) -> DataFrame:
        """Exact search for many texts (query_id, text): (query_id, chunk_id, score, rank)."""
        embedded = embedding.embed(queries.select("query_id", "text"), "text", self.provider)
        return search.top_k_batch(self.chunks(), embedded.select("query_id", "vector"), "chunk_id", "vector", check_top_k(top_k))

    # -- administration -------------------------------------------------------------------------------------------------------------
    def stats(self) -> DataFrame:
        stored = self.all_chunks().agg(F.count(F.lit(1)).alias("stored_chunks"), F.countDistinct("shard_id").alias("shards"))
        live = self.chunks().agg(F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("chunks"))
        dead = self.tombstones().agg(F.count(F.lit(1)).alias("deleted"))
        return live.join(F.broadcast(stored), F.lit(True)).join(F.broadcast(dead), F.lit(True)).withColumn("dimension", F.lit(self.options.dimension))

    def health(self) -> DataFrame:
        return self.stats().select(F.lit("healthy").alias("status"), "documents", "chunks")

    def system_stats(self) -> DataFrame:
        """One row: memory of the driver process, and of its machine, and the cores Spark has."""
        return stats.system_stats(self.spark)

    def detailed_health(self) -> DataFrame:
        """One row: state, startup summary, store, index, log and lock figures."""
        index_row = F.lit(None).cast("string")
        folder = self._index_folder()
        if folder:
            placed = self._read(f"{folder}/vectors", INDEXED)
            sizes = placed.agg(F.count_distinct("chunk_id").alias("indexed"), F.count_distinct("bucket_id").alias("non_empty_buckets")).first().asDict()
            index_row = F.lit(json.dumps(sizes))
        counted = {f"{r['field']}={r['value']}": r["entries"] for r in self.log_stats().collect()}  # a row an operation and status
        return self.stats().select(
            F.lit("healthy").alias("status"), F.lit(json.dumps(self.startup)).alias("startup"), F.to_json(F.struct("*")).alias("stats"), index_row.alias("index"),
            F.lit(json.dumps(counted, sort_keys=True)).alias("log"), F.lit(self.locks().count()).cast("int").alias("locks"),
        )

    def shard_details(self) -> DataFrame:
        """Chunks, documents and characters of each shard with the bytes of its files; empty shards too."""
        every = self.spark.range(self.options.shard_count).select(F.col("id").cast("int").alias("shard_id"))
        sizes = self._listed(self.generation).groupBy("shard_id").agg(F.sum("bytes").alias("file_size"), F.count(F.lit(1)).alias("files"))
        counted = stats.shard_details(self.all_chunks())
        zero = {c: 0 for c in ("chunks", "documents", "characters", "file_size", "files")}
        return every.join(counted, "shard_id", "left").join(sizes, "shard_id", "left").fillna(zero)

    def rebuild_shards(self) -> DataFrame:
        """Puts chunks that lie in another shard than their document's hash says, or in none, where they belong, by a new generation.
        Returns the figures of the shards."""
        wrong = ~F.col("shard_id").eqNullSafe(shard_of(F.col("doc_id"), self.options.shard_count))
        if not self.all_chunks().where(wrong).isEmpty():
            self.vacuum(days=None, shard=shard_of(F.col("doc_id"), self.options.shard_count))
        return self.shard_details()

    def _listed(self, generation: str) -> DataFrame:
        """Files of the shards by their names and sizes; nothing of them is read."""
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{generation}/chunks")
        return listed.select(F.regexp_extract("path", r"shard_id=(\d+)", 1).try_cast("int").alias("shard_id"), F.col("length").alias("bytes"))

    def shard_files(self) -> DataFrame:
        """Files of each shard with size and SHA-256, hashed in blocks by the tasks: what :meth:`validate_shards` compares.

        A file that can't be read has no checksum.
        """
        return self._files_of(self.generation)

    def _files_of(self, generation: str) -> DataFrame:
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{generation}/chunks")

        def run(batches):
            import hashlib

            import pyarrow as pa
            from pyarrow import fs

            for batch in batches:
                sums = []
                for path in batch.column(1).to_pylist():
                    try:
                        system, inner = fs.FileSystem.from_uri(path)
                        digest = hashlib.sha256()
                        with system.open_input_stream(inner) as f:
                            while block := f.read(1 << 20):
                                digest.update(block)
                        sums.append(digest.hexdigest())
                    except OSError:
                        sums.append(None)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], names=["bytes", "path", "checksum"])

        hashed = listed.select(F.col("length").alias("bytes"), F.regexp_replace("path", "^file:/+", "file:///").alias("path")).mapInArrow(
            run, "bytes long, path string, checksum string"
        )
        return hashed.select(
            F.regexp_extract("path", r"shard_id=(\d+)", 1).cast("int").alias("shard_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "bytes", "checksum"
        )

    def save_manifest(self) -> None:
        self.shard_files().write.mode("overwrite").parquet(f"{self.generation}/manifest")

    def validate_shards(self) -> DataFrame:
        """(shard_id, file, state): missing, empty, corrupt, checksum_mismatch, unknown or ok, against the saved manifest."""
        want = self.spark.read.parquet(f"{self.generation}/manifest").select("shard_id", "file", F.col("checksum").alias("wanted"))
        both = want.join(self.shard_files(), ["shard_id", "file"], "full")
        state = (
            F.when(F.col("bytes").isNull(), "missing").when(F.col("bytes") == 0, "empty").when(F.col("checksum").isNull(), "corrupt").when(F.col("wanted").isNull(), "unknown")
            .when(F.col("wanted") != F.col("checksum"), "checksum_mismatch").otherwise("ok")
        )
        return both.select("shard_id", "file", state.alias("state"))

    def migrate_legacy(self, metadata: DataFrame, vectors: DataFrame) -> dict:
        """Moves an old single-file store in: metadata rows without a shard joined to vectors by ``vector_idx``. Repeatable."""
        have = self.all_chunks().select("chunk_id")
        old = metadata.where("shard_id IS NULL").drop("shard_id").join(have, "chunk_id", "left_anti")
        with self._lock():

            def write(tx: str) -> dict:
                rows = old.join(vectors.select("vector_idx", "vector"), "vector_idx").withColumn("write_tx", F.lit(tx)).withColumn(
                    "shard_id", shard_of(F.col("doc_id"), self.options.shard_count)
                )
                self._write_chunks(rows.select(*CHUNKS.names))
                return {"migrated": self._read(f"{self.generation}/chunks", CHUNKS).where(F.col("write_tx") == tx).count(), "skipped": 0}

            done = self._transaction("migrate", "", write)
        done["skipped"] = metadata.count() - done["migrated"]
        return done
