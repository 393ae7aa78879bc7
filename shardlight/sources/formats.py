"""Readers and writers of the store's exchange formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_metadata_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Chunk metadata, one JSON object a line; of lines with one ``chunk_id`` the last counts, blank and broken lines don't.

    Lines are ordered by file and position within it. The order is kept by a block and line number, so nothing is sorted
    globally.
    """
    schema = (
        "chunk_id string, doc_id string, text string, text_length int, start_idx int, end_idx int, vector_idx long, shard_id int, "
        "shard_offset long, metadata string, created_at double"
    )
    lines = spark.read.text(path).select("value", F.struct(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n")).alias("_at"))
    rows = lines.select(F.from_json("value", schema).alias("r"), "_at").where("r.chunk_id IS NOT NULL")
    return rows.groupBy("r.chunk_id").agg(F.max_by("r", "_at").alias("r")).select("r.*")


def read_log_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """The transaction log, one JSON object a line. Broken lines are skipped; records of the old format are upgraded."""
    schema = (
        "entry_id long, tx_id string, operation string, doc_id string, document_id string, timestamp string, status string, "
        "details string, data string, checksum string"
    )
    r = spark.read.text(path).select(F.from_json("value", schema).alias("r")).where("r.entry_id IS NOT NULL").select("r.*")
    old = F.col("doc_id").isNull() & F.col("document_id").isNotNull()
    return r.select(
        "entry_id", F.when(old, F.concat(F.lit("legacy-"), "entry_id")).otherwise(F.col("tx_id")).alias("tx_id"),
        F.coalesce("operation", F.lit("unknown")).alias("operation"), F.coalesce("doc_id", "document_id", F.lit("")).alias("doc_id"),
        F.to_timestamp_ntz(F.col("timestamp")).alias("logged_at"), F.coalesce("status", F.lit("committed")).alias("status"),
        F.coalesce("details", "data", F.lit("{}")).alias("details"), "checksum",
    )


def read_tombstones_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Tombstones, one JSON object a line; a missing reason is a user's delete."""
    r = spark.read.text(path).select(F.from_json("value", "chunk_id string, document_id string, deleted_at string, reason string").alias("r"))
    return r.where("r.chunk_id IS NOT NULL").select(
        "r.chunk_id", "r.document_id", F.to_timestamp_ntz(F.col("r.deleted_at")).alias("deleted_at"), F.coalesce("r.reason", F.lit("user_delete")).alias("reason")
    )


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def read_npy(spark: SparkSession, path: str, key: str = "vector_idx") -> DataFrame:
    """(vector_idx, vector) of a two-dimensional NumPy file, read by row ranges through a memory map in the tasks."""
    import numpy as np
    import pyarrow as pa

    shape = np.load(path, mmap_mode="r").shape
    step = max(1, (32 << 20) // max(1, 4 * shape[1]))

    def run(batches):
        data = np.load(path, mmap_mode="r")
        for batch in batches:
            for lo in batch.column(0).to_pylist():
                part = np.asarray(data[lo : lo + step], np.float32)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, shape[1]), pa.int32()), pa.array(part.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(part)), pa.int64()), flat], names=[key, "vector"])

    return spark.range(0, shape[0], step).mapInArrow(run, f"{key} long, vector array<float>")
