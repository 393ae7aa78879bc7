"""Heavy keys: finding them exactly, and aggregating or joining without a hot task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def heavy_keys(df: DataFrame, key: str, share: float, least_rows: int = 0) -> list:
    """Keys that hold at least ``share`` of the rows of ``df``; none if it has at most ``least_rows``.

    At most ``1 / share`` keys can qualify, so the driver receives a bounded list whatever the
    input. The counts are algebraic and combined before the shuffle. Null is no key but its rows
    count in the total.
    """
    if not 0 < share <= 1:
        raise ValueError("share must lie in (0, 1]")
    total = df.count()
    if total <= least_rows:
        return []
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    rows = counts.where((F.col("_n") >= total * share) & F.col(key).isNotNull()).select(key).collect()
    return sorted(r[0] for r in rows)


def salted_left_join(
    big: DataFrame, small: DataFrame, key: str, spread: Column, share: float = 0.01, salts: int = 64, least_rows: int = 1_000_000
) -> DataFrame:
    """Left join of ``big`` with unique keys of ``small`` in which hot keys are spread over ``salts`` tasks.

    ``small`` must hold one row a key. Rows of ``big`` under a heavy key get a salt derived from
    ``spread``, and only the few heavy rows of ``small`` are repeated once a salt. Both sides are
    hash partitioned on (key, salt), sorted, and merged in one pass. Up to ``least_rows`` rows fit one task
    anyway, so no heavy key is looked for.
    """
    hot = heavy_keys(big, key, share, least_rows)
    if not hot:
        return big.hint("merge").join(small, key, "left")
    is_hot = F.col(key).isin(hot)
    salt = F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    salted = big.withColumn("_salt", salt)
    repeated = small.withColumn(
        "_salt",
        F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))),
    )
    return salted.hint("merge").join(repeated, [key, "_salt"], "left").drop("_salt")
