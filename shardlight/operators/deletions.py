"""Soft deletes: tombstones against chunks.

Chunk ids compare trimmed and in lower case; null and blank ids are neither chunks nor tombstones. A chunk is deleted from its
first tombstone on; later ones change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardlight.operators.orphans import tidy_id


def once(tombstones: DataFrame) -> DataFrame:
    """(chunk_id, deleted_at): the first tombstone of each chunk."""
    tidy = tombstones.select(tidy_id(F.col("chunk_id")).alias("chunk_id"), "deleted_at").where("chunk_id IS NOT NULL")
    return tidy.groupBy("chunk_id").agg(F.min("deleted_at").alias("deleted_at"))


def active(chunks: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The chunks without a tombstone."""
    dead = once(tombstones).select(F.col("chunk_id").alias("_dead"))
    rows = chunks.withColumn("_key", tidy_id(F.col("chunk_id"))).where("_key IS NOT NULL")
    return rows.join(dead, F.col("_key") == F.col("_dead"), "left_anti").drop("_key")


def stats(tombstones: DataFrame) -> DataFrame:
    return once(tombstones).agg(
        F.count(F.lit(1)).alias("deleted"), F.min("deleted_at").alias("first_at"), F.max("deleted_at").alias("last_at")
    )


def expired(tombstones: DataFrame, now, days: int = 30) -> DataFrame:
    """Tombstones older than ``days`` before ``now`` (a column or timestamp)."""
    return tombstones.where(F.col("deleted_at") < F.lit(now).cast("timestamp_ntz") - F.make_interval(days=F.lit(days)))
