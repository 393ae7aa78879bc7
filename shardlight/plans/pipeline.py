"""Queries of the general data-pipeline operators (change feed, orphan references, heavy keys)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardlight.operators import changefeed, hotkeys, orphans
from shardlight.operators.hotkeys import KeyField
from shardlight.runtime import WHITESPACE, cut, stored, table

ENTRY_FIELDS = [KeyField("vector_entries.doc_id", "doc_id", 0.02), KeyField("vector_entries.shard_id", "shard_id", 0.05)]
SHARD_FIELDS = [KeyField("shard_info.shard_id", "shard_id", 0.05)]


# -- change feed ---------------------------------------------------------------------------------
def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents alive at the end of the feed and the entry of their last effect."""
    current = changefeed.replay(table(spark, root, "wal_entries")).current()
    return current.select("doc_id", F.col("seq").alias("entry_id"))


def p2_history(spark: SparkSession, root: str) -> DataFrame:
    """Effects per operation, and documents left alive or ended by each as their last effect."""
    changes = changefeed.replay(table(spark, root, "wal_entries")).changes()
    last = changefeed.newest(changes).groupBy("operation").agg(F.count(F.lit(1)).alias("last_of_documents"))
    return (
        changes.groupBy("operation").agg(F.count(F.lit(1)).alias("effects"))
        .join(last, "operation", "left")
        .select("operation", "effects", F.coalesce("last_of_documents", F.lit(0)).alias("last_of_documents"))
    )


# -- orphan references ---------------------------------------------------------------------------
def _orphans(spark: SparkSession, root: str) -> DataFrame:
    tombstones = table(spark, root, "tombstones")
    refs = orphans.references(table(spark, root, "vector_entries"), table(spark, root, "shard_info"), tombstones)
    refs = stored(refs.distinct(), "refs")  # read for the heavy keys and for the join
    return orphans.orphan_references(refs, orphans.parents(table(spark, root, "chunks"), tombstones))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """References that had no living chunk behind them."""
    return _orphans(spark, root).select("ref_table", "ref_id", "chunk_id").distinct()


def p6_report(spark: SparkSession, root: str) -> DataFrame:
    """The same references counted per table, month of the reference and reason."""
    return orphans.report(_orphans(spark, root))


# -- heavy keys ----------------------------------------------------------------------------------
def _keyed_entries(spark: SparkSession, root: str, *carried: str) -> DataFrame:
    rows = hotkeys.once(
        table(spark, root, "vector_entries"), "vector_idx", "arrived_at", ["doc_id", "shard_id", *carried]
    )
    return hotkeys.by_field(rows, ENTRY_FIELDS, *carried)


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Keys that hold most rows."""
    shards = hotkeys.once(table(spark, root, "shard_info"), "info_id", "last_updated", ["shard_id"])
    counts = hotkeys.key_counts(_keyed_entries(spark, root)).unionByName(
        hotkeys.key_counts(hotkeys.by_field(shards, SHARD_FIELDS))
    )
    return hotkeys.heavy(cut(counts), ENTRY_FIELDS + SHARD_FIELDS).select("field", "key_value")  # counts are read twice


def p7_key_results(spark: SparkSession, root: str) -> DataFrame:
    """Rows, distinct chunks and latest time for every key of vector_entries.doc_id and .shard_id and shard_info.shard_id."""
    entries = _keyed_entries(spark, root, "chunk_id", "created_at").withColumnRenamed("created_at", "at")
    shards = hotkeys.once(table(spark, root, "shard_info"), "info_id", "last_updated", ["shard_id", "chunk_ids"])
    # one row a descriptor counts as a row of its key; its list elements only feed the distinct count
    elements = hotkeys.by_field(shards.select("shard_id", F.explode_outer("chunk_ids").alias("chunk_id")), SHARD_FIELDS, "chunk_id")
    per_entry = hotkeys.key_results(entries, "chunk_id", "at")
    distinct = (
        elements.where(F.col("key_value").isNotNull()).groupBy("field", "key_value", "chunk_id").agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("field", "key_value").agg(F.count("chunk_id").alias("distinct_chunks"))
    )
    totals = (
        hotkeys.by_field(
            hotkeys.once(table(spark, root, "shard_info"), "info_id", "last_updated", ["shard_id"])
            .join(
                table(spark, root, "shard_info").groupBy("info_id").agg(F.max("last_updated").alias("at")), "info_id"
            ),
            SHARD_FIELDS, "at",
        )
        .where(F.col("key_value").isNotNull())
        .groupBy("field", "key_value").agg(F.count(F.lit(1)).alias("rows"), F.max("at").alias("latest_at"))
    )
    per_shard = totals.join(distinct, ["field", "key_value"], "left").select(
        "field", "key_value", "rows", F.coalesce("distinct_chunks", F.lit(0)).alias("distinct_chunks"), "latest_at"
    )
    return per_entry.unionByName(per_shard)


def queries() -> dict:
    return {q.__name__: q for q in (p2_found, p2_history, p6_found, p6_report, p7_found, p7_key_results)}


# -- the same in SQL -----------------------------------------------------------------------------
_WS = "".join(f"chr({ord(c)})||" for c in WHITESPACE)[:-2]

_EFFECTS = f"""
ws AS (SELECT {_WS} AS w),
entries AS (
  SELECT entry_id, arg_min(tx, a) AS tx, arg_min(op, a) AS op, arg_min(doc, a) AS doc, arg_min(st, a) AS st FROM (
    SELECT entry_id, coalesce(arrived_at, TIMESTAMP '1970-01-01') AS a,
      coalesce(nullif(trim(tx_id, w), ''), 'legacy-' || entry_id) AS tx,
      coalesce(nullif(lower(trim(operation, w)), ''), 'unknown') AS op,
      coalesce(trim(doc_id, w), '') AS doc,
      coalesce(nullif(lower(trim(status, w)), ''), 'committed') AS st
    FROM wal_entries, ws) GROUP BY entry_id),
committed AS (SELECT tx, min(entry_id) AS seq FROM entries WHERE st = 'committed' GROUP BY tx),
effects AS (
  SELECT c.seq,
    CASE WHEN e.op <> 'unknown' THEN e.op ELSE (SELECT arg_min(x.op, x.entry_id) FROM entries x WHERE x.tx = c.tx AND x.op <> 'unknown') END AS op,
    CASE WHEN e.doc <> '' THEN e.doc ELSE (SELECT arg_min(x.doc, x.entry_id) FROM entries x WHERE x.tx = c.tx AND x.doc <> '') END AS doc
  FROM committed c JOIN entries e ON e.entry_id = c.seq),
valid AS (SELECT * FROM effects WHERE op IS NOT NULL AND doc IS NOT NULL),
last_of AS (SELECT doc, max(seq) AS seq, arg_max(op, seq) AS op FROM valid GROUP BY doc)
"""

_ORPHANS = f"""
ws AS (SELECT {_WS} AS w),
refs AS (
  SELECT DISTINCT * FROM (
    SELECT 'vector_entries' AS ref_table, vector_idx AS ref_id, lower(trim(chunk_id, w)) AS chunk_id, created_at AS moment FROM vector_entries, ws
    UNION ALL SELECT 'shard_info', info_id, lower(trim(u, w)), last_updated FROM (SELECT info_id, last_updated, unnest(chunk_ids) AS u FROM shard_info), ws
    UNION ALL SELECT 'tombstones', tombstone_id, lower(trim(chunk_id, w)), deleted_at FROM tombstones, ws)
  WHERE chunk_id <> ''),
born AS (SELECT lower(trim(chunk_id, w)) AS chunk_id, min(created_at) AS b FROM chunks, ws GROUP BY 1),
died AS (SELECT lower(trim(chunk_id, w)) AS chunk_id, min(deleted_at) AS d FROM tombstones, ws GROUP BY 1),
orphans AS (
  SELECT r.*, CASE WHEN b.chunk_id IS NULL THEN 'missing' WHEN b.b > r.moment THEN 'late'
    WHEN r.ref_table <> 'tombstones' AND d.d <= r.moment THEN 'deleted' END AS reason
  FROM refs r LEFT JOIN born b ON b.chunk_id = r.chunk_id LEFT JOIN died d ON d.chunk_id = r.chunk_id)
"""

_KEYS = """
ve AS (SELECT DISTINCT vector_idx, doc_id, shard_id, chunk_id, created_at FROM vector_entries WHERE vector_idx IS NOT NULL),
si AS (SELECT DISTINCT info_id, shard_id, chunk_ids, last_updated FROM shard_info WHERE info_id IS NOT NULL),
keyed AS (
  SELECT 'vector_entries.doc_id' AS field, doc_id AS key_value, chunk_id, created_at AS moment, 0.02 AS share FROM ve
  UNION ALL SELECT 'vector_entries.shard_id', shard_id::VARCHAR, chunk_id, created_at, 0.05 FROM ve
  UNION ALL SELECT 'shard_info.shard_id', shard_id::VARCHAR, NULL, last_updated, 0.05 FROM si)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"WITH {_EFFECTS} SELECT doc AS doc_id, seq AS entry_id FROM last_of WHERE op <> 'delete'",
        "p2_history": f"""WITH {_EFFECTS} SELECT v.op AS operation, count(*) AS effects,
            (SELECT count(*) FROM last_of l WHERE l.op = v.op) AS last_of_documents FROM valid v GROUP BY v.op""",
        "p6_found": f"WITH {_ORPHANS} SELECT DISTINCT ref_table, ref_id, chunk_id FROM orphans WHERE reason IS NOT NULL",
        "p6_report": f"""WITH {_ORPHANS} SELECT ref_table, strftime(moment, '%Y-%m') AS month, reason, count(*) AS orphans,
            count(DISTINCT chunk_id) AS chunk_ids FROM orphans WHERE reason IS NOT NULL GROUP BY 1, 2, 3""",
        "p7_found": f"""WITH {_KEYS}, n AS (SELECT field, key_value, share, count(*) AS c FROM keyed GROUP BY 1, 2, 3),
            t AS (SELECT field, sum(c) AS total FROM n GROUP BY 1)
            SELECT n.field, n.key_value FROM n JOIN t USING (field) WHERE key_value IS NOT NULL AND c >= share * total""",
        "p7_key_results": f"""WITH {_KEYS}, d AS (SELECT shard_id::VARCHAR AS key_value, count(DISTINCT u) AS dc
              FROM (SELECT shard_id, unnest(chunk_ids) AS u FROM si) GROUP BY 1)
            SELECT field, k.key_value, count(*) AS rows,
              CASE WHEN field = 'shard_info.shard_id' THEN coalesce(max(dc), 0) ELSE count(DISTINCT chunk_id) END AS distinct_chunks,
              max(moment) AS latest_at
            FROM keyed k LEFT JOIN d ON d.key_value = k.key_value WHERE k.key_value IS NOT NULL GROUP BY 1, 2""",
    }
