"""Per-key results over keys of very unequal size.

All aggregates are algebraic (count, distinct count by two-level grouping, max): each map task folds
its rows into a hash table of key states, spills it if need be, and only those compact states are
shuffled. A key that holds most rows therefore costs its reducer one state a map task.

Nulls are no key but count in the totals. Repeated rows of an id count once: the row that arrived
first. Empty tables give no keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KeyField:
    """One column whose values are keys; ``share`` is the part of the rows from which a key is heavy."""

    name: str
    column: str
    share: float


def once(df: DataFrame, row_id: str, arrival: str, columns: list[str]) -> DataFrame:
    """One row a ``row_id`` (the earliest by ``arrival``), reduced to ``columns``."""
    kept = df.where(F.col(row_id).isNotNull()).groupBy(row_id).agg(F.min(F.struct(arrival, *columns)).alias("_r"))
    return kept.select(row_id, *[F.col(f"_r.{c}").alias(c) for c in columns])


def by_field(df: DataFrame, fields: list[KeyField], *carried: str) -> DataFrame:
    """A row for each key field: (field, key_value, *carried); null keys are kept for the totals."""
    pairs = F.array(
        *[F.struct(F.lit(f.name).alias("field"), F.col(f.column).cast("string").alias("key_value")) for f in fields]
    )
    return df.select(F.explode(pairs).alias("_k"), *carried).select("_k.field", "_k.key_value", *carried)


def key_counts(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("field", "key_value").agg(F.count(F.lit(1)).alias("rows"))


def heavy(counts: DataFrame, fields: list[KeyField]) -> DataFrame:
    """Keys with at least their field's share of all rows, null keys counted in the total only."""
    limits = F.create_map(*[x for f in fields for x in (F.lit(f.name), F.lit(f.share))])
    totals = counts.groupBy("field").agg(F.sum("rows").alias("total"))
    return (
        counts.join(F.broadcast(totals), "field")  # one row a key field
        .where(F.col("key_value").isNotNull() & (F.col("rows") >= limits[F.col("field")] * F.col("total")))
        .select("field", "key_value", "rows", "total")
    )


def key_results(keyed: DataFrame, item: str, at: str) -> DataFrame:
    """Rows, distinct items and latest time of every key, heavy or not.

    Distinct items are counted by grouping on (key, item) first, so a heavy key is spread over its
    items before the states of the key itself are merged.
    """
    per_item = keyed.where(F.col("key_value").isNotNull()).groupBy("field", "key_value", item).agg(
        F.count(F.lit(1)).alias("n"), F.max(at).alias("latest")
    )
    return per_item.groupBy("field", "key_value").agg(
        F.sum("n").alias("rows"), F.count(item).alias("distinct_chunks"), F.max("latest").alias("latest_at")
    )
