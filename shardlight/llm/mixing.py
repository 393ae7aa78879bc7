"""Mixing sources to target weights.

Token totals a source give each source's repetition rate: target share times the size of the mix over the tokens available.
A document is emitted floor(rate) times and once more with the probability of the fraction, decided by a seeded hash of its
id. Only the totals a source reach the driver, a row for each row of the targets at most.

The size of the mix is the largest for which no source with documents needs more than its ``max_repeats``, unless
``total_tokens`` asks for another; a source that can't reach its share then gives all it may. Shares of sources without
documents can't be met; the others keep their proportions. Source names match trimmed, in lower case, with ``_`` and spaces as
``-``; targets of equal name add up their shares under the least ``max_repeats``. Documents of other or null sources are not used. Null or
non-positive shares count as 0, a null ``max_repeats`` as 1. Documents without tokens are used like others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardlight.runtime import WHITESPACE


def tidy_source(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.btrim(c, F.lit(WHITESPACE))), r"[_\s]+", "-")


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    max_repeats: int


def read_targets(targets: DataFrame) -> list[Target]:
    """The targets, one a tidy source name; the table is a list of parameters."""
    share = F.when(F.col("target_share") > 0, F.col("target_share")).otherwise(0.0)
    rows = (
        targets.select(tidy_source(F.col("source")).alias("source"), share.alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("r"))
        .where("source IS NOT NULL")
        .groupBy("source").agg(F.sum("share").alias("share"), F.min("r").alias("r")).orderBy("source").collect()
    )
    return [Target(x["source"], float(x["share"]), max(0, int(x["r"]))) for x in rows]


def rates(targets: list[Target], tokens: dict[str, int], total_tokens: float | None = None) -> dict[str, float]:
    """Repetition rate of each source that has tokens."""
    able = [t for t in targets if t.share > 0 and t.max_repeats > 0 and tokens.get(t.source, 0) > 0]
    whole = sum(t.share for t in able)
    if not able:
        return {}
    if total_tokens is None:
        total_tokens = min(t.max_repeats * tokens[t.source] * whole / t.share for t in able)
    return {t.source: min(float(t.max_repeats), t.share / whole * total_tokens / tokens[t.source]) for t in able}


def mix(sized: DataFrame, targets: list[Target], seed: int = 17, total_tokens: float | None = None, key: str = "doc_id") -> DataFrame:
    """Chosen documents: (key, source, tokens, repeats). ``sized`` has key, source (raw) and tokens."""
    tidy = sized.select(key, tidy_source(F.col("source")).alias("source"), "tokens").where(F.col("source").isin([t.source for t in targets]))
    totals = {r["source"]: int(r["n"]) for r in tidy.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    rate = rates(targets, totals, total_tokens)
    if not rate:
        return tidy.withColumn("repeats", F.lit(0)).where("repeats > 0")
    r = F.create_map(*[x for s, v in sorted(rate.items()) for x in (F.lit(s), F.lit(v))])[F.col("source")]
    chance = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    copies = (F.floor(r) + (chance < r - F.floor(r)).cast("int")).cast("int")
    return tidy.withColumn("repeats", F.coalesce(copies, F.lit(0))).where("repeats > 0")


def shares(mixed: DataFrame, sized: DataFrame, targets: list[Target]) -> DataFrame:
    """One row a target: its share, what was available and used, the actual share of the mix, and how far it is off (part of the target)."""
    spark = mixed.sparkSession
    goal = spark.createDataFrame([(t.source, t.share, t.max_repeats) for t in targets], "source string, target_share double, max_repeats int")
    have = sized.select(tidy_source(F.col("source")).alias("source"), "tokens").groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("available_tokens")
    )
    used = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("used_documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"), F.max("repeats").alias("most_repeats")
    )
    total = used.agg(F.sum("mixed_tokens").alias("_t"))
    joined = F.broadcast(goal).join(have, "source", "left").join(used, "source", "left")  # a row a target
    zero = {c: 0 for c in ("documents", "available_tokens", "used_documents", "mixed_tokens", "most_repeats")}
    whole = total.first()[0] or 0
    shares_ = joined.fillna(zero).withColumn("actual_share", F.round(F.col("mixed_tokens") / F.lit(float(max(1, whole))), 6))
    return shares_.withColumn("deviation", F.when(F.col("target_share") > 0, F.round(F.col("actual_share") / F.col("target_share") - 1, 6)))
