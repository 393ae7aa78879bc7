"""Statistics of a store: shards, documents, health, latencies."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardlight.operators import deletions
from shardlight.operators.orphans import tidy_id
from shardlight.operators.positions import rows_at


def shard_stats(rows: DataFrame, shards: int) -> DataFrame:
    """Rows of each shard, empty ones too, with the total and the average."""
    every = rows.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard_id"))
    counts = rows.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"))
    joined = every.join(counts, "shard_id", "left").select("shard_id", F.coalesce("n", F.lit(0)).alias("vectors"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return joined.join(F.broadcast(total), F.lit(True)).withColumn("average", F.round(F.col("total") / shards, 6))


def shard_details(chunks: DataFrame) -> DataFrame:
    """Chunks, documents and characters of each shard; repeated rows of a chunk count once."""
    c = chunks.select("chunk_id", "doc_id", "shard_id", "text_length").distinct()
    return c.groupBy("shard_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.countDistinct("doc_id").alias("documents"), F.sum("text_length").alias("characters")
    )


def document_summary(chunks: DataFrame) -> DataFrame:
    """Chunk count and length of the first chunk of each document; repeated rows of a chunk count once."""
    c = chunks.select("chunk_id", "doc_id", "text_length", "start_idx", "end_idx").distinct()
    return c.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunk_count"), F.min_by("text_length", F.struct("start_idx", "end_idx", "chunk_id")).alias("first_chunk_length")
    )


def _counts(chunks: DataFrame, tombstones: DataFrame) -> DataFrame:
    dead = deletions.once(tombstones).select(F.col("chunk_id"), F.lit(1).alias("dead"))
    rows = chunks.select(tidy_id(F.col("chunk_id")).alias("chunk_id"), "doc_id", "shard_id", F.lit(1).alias("row")).where("chunk_id IS NOT NULL").distinct()
    both = rows.join(dead, "chunk_id", "full")
    alive = F.col("row").isNotNull() & F.col("dead").isNull()
    return both.agg(
        F.countDistinct(F.when(alive, F.col("doc_id"))).alias("documents"), F.count_if(alive).alias("chunks"), F.count("row").alias("stored_chunks"),
        F.countDistinct(F.when(F.col("dead").isNotNull(), F.col("chunk_id"))).alias("deleted"), F.countDistinct("shard_id").alias("shards"),
    )


def store_stats(chunks: DataFrame, tombstones: DataFrame, dimension: int) -> DataFrame:
    """Active documents and chunks, stored chunks, deleted ids, shards, dimension."""
    return _counts(chunks, tombstones).withColumn("dimension", F.lit(dimension))


def health(chunks: DataFrame, tombstones: DataFrame) -> DataFrame:
    return _counts(chunks, tombstones).select(F.lit("healthy").alias("status"), "documents", "chunks")


def shard_validation(shard_info: DataFrame) -> DataFrame:
    """State of each saved descriptor: missing, empty, count_mismatch, corrupt (null or repeated ids) or ok."""
    ids = F.col("chunk_ids")
    real = F.filter(ids, lambda x: x.isNotNull())
    state = (
        F.when(ids.isNull(), "missing").when(F.size(ids) == 0, "empty").when(~F.col("vector_count").eqNullSafe(F.size(ids)), "count_mismatch")
        .when((F.size(real) < F.size(ids)) | (F.size(F.array_distinct(real)) < F.size(real)), "corrupt").otherwise("ok")
    )
    return shard_info.select("info_id", "vector_count", "chunk_ids").distinct().select("info_id", state.alias("state"))


def latency(samples: DataFrame, value: str) -> DataFrame:
    """Count, mean, extremes and percentiles that are samples themselves (no interpolation).

    ``p`` is the sample at position floor(n p) of the sorted ones, ``p95_lower`` the one before.
    """
    rows = samples.select(F.col(value).alias("v")).where("v IS NOT NULL")
    n = rows.count()
    summary = rows.agg(F.count("v").alias("samples"), F.round(F.avg("v"), 6).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    want = {"p50": int(n * 0.5), "p95": int(n * 0.95), "p99": int(n * 0.99), "p95_lower": max(int(n * 0.95), 1) - 1}
    found = rows_at(rows, ["v"], list(want.values()))[0] if n else {}
    return summary.select("*", *[F.lit(float(found[w]["v"]) if n else None).cast("double").alias(k) for k, w in want.items()])


def _fields(path: str) -> dict[str, int]:
    """Numbers of a kernel status file in bytes (kB lines) or as they are; empty where there is none."""
    try:
        with open(path, encoding="ascii", errors="replace") as f:
            lines = [line.split() for line in f]
    except OSError:
        return {}
    return {x[0].rstrip(":"): int(x[1]) * (1024 if x[-1] == "kB" else 1) for x in lines if len(x) > 1 and x[1].isdigit()}


def memory_bytes() -> tuple[int, int]:
    """Resident and virtual bytes of this process; zeros where the system doesn't tell."""
    own = _fields("/proc/self/status")
    return own.get("VmRSS", 0), own.get("VmSize", 0)


def system_stats(spark: SparkSession) -> DataFrame:
    """One row about the driver: its memory, the memory and load of its machine, the cores of the application."""
    rss, vms = memory_bytes()
    machine = _fields("/proc/meminfo")
    total, free = machine.get("MemTotal", 0), machine.get("MemAvailable", 0)
    load = os.getloadavg()[0] / (os.cpu_count() or 1) * 100 if hasattr(os, "getloadavg") else 0.0
    row = (rss / 2**20, vms / 2**20, float(load), 100 * (1 - free / total) if total else 0.0, free / 2**20, spark.sparkContext.defaultParallelism)
    return spark.createDataFrame([row], "rss_mb double, vms_mb double, cpu_percent double, memory_percent double, available_memory_mb double, cores int")
