"""References to records that do not exist.

References and parents are hash partitioned on the id, sorted, and merged in one pass. A parent id
has one validity interval: from its first creation to its first deletion. A reference is *missing*
if the id has no parent, *late* if every parent row is younger than the reference, *deleted* if the
id was deleted at or before it.

Ids are compared trimmed and in lower case; null and blank ids are no references. A null reference
time can only be *missing*. Repeated rows count once. Empty tables give an empty result. A hot id
(a third of all references may name one) is salted over several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardlight.operators.skew import salted_left_join
from shardlight.runtime import WHITESPACE


def tidy_id(c: Column) -> Column:
    t = F.lower(F.btrim(c.cast("string"), F.lit(WHITESPACE)))
    return F.when(F.length(t) > 0, t)


def references(vector_entries: DataFrame, shard_info: DataFrame, tombstones: DataFrame) -> DataFrame:
    """All references: (ref_table, ref_id, chunk_id, ref_at)."""
    shape = lambda df, name, ref, cid, at: df.select(
        F.lit(name).alias("ref_table"), F.col(ref).cast("long").alias("ref_id"), tidy_id(cid).alias("chunk_id"),
        F.col(at).alias("ref_at"),
    )
    exploded = shard_info.select("info_id", "last_updated", F.explode("chunk_ids").alias("_element"))
    return (
        shape(vector_entries, "vector_entries", "vector_idx", F.col("chunk_id"), "created_at")
        .unionByName(shape(exploded, "shard_info", "info_id", F.col("_element"), "last_updated"))
        .unionByName(shape(tombstones, "tombstones", "tombstone_id", F.col("chunk_id"), "deleted_at"))
        .where(F.col("chunk_id").isNotNull())
    )


def parents(chunks: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Validity interval of each chunk id: (chunk_id, born_at, died_at, exists)."""
    born = chunks.select(
        tidy_id(F.col("chunk_id")).alias("chunk_id"), F.col("created_at").alias("born_at"),
        F.lit(None).cast("timestamp_ntz").alias("died_at"), F.lit(1).alias("row"),
    )
    died = tombstones.select(
        tidy_id(F.col("chunk_id")).alias("chunk_id"), F.lit(None).cast("timestamp_ntz").alias("born_at"),
        F.col("deleted_at").alias("died_at"), F.lit(0).alias("row"),
    )
    return (
        born.unionByName(died)
        .where(F.col("chunk_id").isNotNull())
        .groupBy("chunk_id")
        .agg(F.min("born_at").alias("born_at"), F.min("died_at").alias("died_at"), F.max("row").alias("present"))
    )


def orphan_references(
    refs: DataFrame, parent_intervals: DataFrame, deletion_ignored_for: tuple[str, ...] = ("tombstones",), salts: int = 64
) -> DataFrame:
    """References without a living parent: (ref_table, ref_id, chunk_id, ref_at, reason).

    ``deletion_ignored_for`` names tables whose references are never *deleted* (a tombstone
    refers to the chunk it deletes).
    """
    joined = salted_left_join(refs, parent_intervals, "chunk_id", F.col("ref_id"), salts=salts)
    missing = F.coalesce(F.col("present"), F.lit(0)) == 0
    late = F.col("born_at") > F.col("ref_at")
    deleted = ~F.col("ref_table").isin(*deletion_ignored_for) & (F.col("died_at") <= F.col("ref_at"))
    reason = F.when(missing, "missing").when(late, "late").when(deleted, "deleted")
    return (
        joined.withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select("ref_table", "ref_id", "chunk_id", "ref_at", "reason")
    )


def report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, month of the reference and reason."""
    return (
        orphans.withColumn("month", F.date_format("ref_at", "yyyy-MM"))
        .groupBy("ref_table", "month", "reason")
        .agg(F.count(F.lit(1)).alias("orphans"), F.countDistinct("chunk_id").alias("chunk_ids"))
    )
