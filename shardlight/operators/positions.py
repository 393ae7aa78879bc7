"""Rows at given positions of a global order, without sorting everything in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from shardlight.runtime import cut


def rows_at(df: DataFrame, order: list[str], wanted: list[int]) -> tuple[dict[int, Row], int]:
    """The rows at the 0-based positions ``wanted`` (few) of ``df`` ordered by ``order``, and the number of rows.

    A range-partitioned sort numbers the rows of each partition; the numbered table is written, so that both
    passes see the same partitions, and the partition sizes turn numbers into positions. ``df`` should be narrow.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    low = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    numbered = cut(ordered.select("*", F.spark_partition_id().alias("_p"), low.alias("_i")))
    sizes = {r["_p"]: r["n"] for r in numbered.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    conditions, at = [], 0
    start: dict[int, int] = {}
    for p in sorted(sizes):
        start[p] = at
        inside = [w - at for w in set(wanted) if at <= w < at + sizes[p]]
        if inside:
            conditions.append((F.col("_p") == p) & F.col("_i").isin(inside))
        at += sizes[p]
    if not conditions:
        return {}, at
    found = numbered.where(reduce(lambda a, b: a | b, conditions)).collect()  # at most len(wanted)
    return {start[r["_p"]] + r["_i"]: r for r in found}, at
