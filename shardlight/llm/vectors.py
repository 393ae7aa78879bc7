"""Usable vectors in a compact exact form, and their exact copies collapsed.

A vector is usable if it has the asked dimension, only finite numbers, and not only zeros. It travels
as a *code*: one tag byte and the numbers in the narrowest of half, single and double precision that
holds them exactly. Half-precision input therefore costs two bytes a number in every shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardlight.operators.skew import salted_left_join
from shardlight.runtime import cut

CODE_SCHEMA = "vector_idx long, code binary"
_TAGS = {b"h": np.dtype("<f2"), b"f": np.dtype("<f4"), b"d": np.dtype("<f8")}


def _encode_rows(x: np.ndarray) -> list[bytes]:
    """Codes of the rows of a float64 matrix of finite numbers."""
    with np.errstate(over="ignore"):
        f, h = x.astype("<f4"), x.astype("<f2")
    fits_f, fits_h = (f == x).all(1), (h == x).all(1)
    out = []
    for i in range(len(x)):
        if fits_h[i]:
            out.append(b"h" + h[i].tobytes())
        elif fits_f[i]:
            out.append(b"f" + f[i].tobytes())
        else:
            out.append(b"d" + x[i].astype("<f8").tobytes())
    return out


def decode(codes: list[bytes], dimension: int) -> np.ndarray:
    """Float64 matrix of the coded vectors."""
    out = np.empty((len(codes), dimension))
    tags = np.array([c[:1] for c in codes], dtype="S1") if codes else np.empty(0, "S1")
    for tag, kind in _TAGS.items():
        at = np.flatnonzero(tags == tag)
        if len(at):
            flat = np.frombuffer(b"".join([codes[i][1:] for i in at]), dtype=kind)
            out[at] = flat.reshape(len(at), dimension)
    return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, safe against overflow and underflow of the squares."""
    x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] if len(x) else x


def usable(df: DataFrame, row_id: str = "vector_idx", vector: str = "vector", dimension: int = 64) -> DataFrame:
    """(vector_idx, code) of the usable rows; rows with a null id are ignored. Repeated rows remain."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            right = (lengths == dimension) & ids.is_valid().to_numpy(zero_copy_only=False)
            rows = pa.array(np.flatnonzero(right))
            values = vectors.take(rows).flatten()
            x = values.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dimension)
            ok = np.isfinite(x).all(1) & (x != 0).any(1)  # a null number reads as NaN
            kept = ids.take(pa.array(np.flatnonzero(right)[ok])).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [kept, pa.array(_encode_rows(x[ok]), pa.binary())], names=["vector_idx", "code"]
            )

    return df.select(row_id, vector).mapInArrow(encode, CODE_SCHEMA)


def without_conflicts(df: DataFrame, row_id: str = "vector_idx", vector: str = "vector", arrival: str = "arrived_at") -> DataFrame:
    """Rows of ids that come with several different vectors, reduced to the vector that arrived first.

    Ordinary input repeats an id with the same vector only; then nothing but a narrow check
    (id and a 64-bit hash, combined before the shuffle) runs and ``df`` is returned as it is.
    """
    slim = df.where(F.col(row_id).isNotNull()).select(row_id, F.xxhash64(vector).alias("_h"))
    clash = slim.groupBy(row_id).agg(F.min("_h").alias("_a"), F.max("_h").alias("_b")).where("_a <> _b").select(row_id)
    if clash.isEmpty():
        return df
    moment = F.col(arrival) if arrival in df.columns else F.lit(0)
    repeated = df.join(clash, row_id, "left_semi").withColumn("_o", F.struct(moment.alias("t"), F.xxhash64(vector).alias("h")))
    first = (
        repeated.withColumn("_n", F.row_number().over(Window.partitionBy(row_id).orderBy("_o"))).where("_n = 1").drop("_n", "_o")
    )
    return df.join(clash, row_id, "left_anti").unionByName(first)


def keyed_by(codes: DataFrame, row_id: str) -> DataFrame:
    """(row_id, key): ids with a 128-bit hash of their code instead of it."""
    return codes.select(row_id, F.struct(F.xxhash64("code").alias("h"), F.xxhash64(F.lit(1), "code").alias("g")).alias("key"))


def _with_group(pairs: DataFrame, groups: DataFrame, row_id: str) -> DataFrame:
    """Rows of ``pairs`` whose key is in ``groups`` (key, ...), hot keys salted."""
    side = groups.withColumn("_h", F.col("key.h")).withColumnRenamed("key", "_k")
    joined = salted_left_join(pairs.withColumn("_h", F.col("key.h")), side, "_h", F.col(row_id))
    return joined.where(F.col("key") == F.col("_k")).drop("_h", "_k", "key")


def copy_groups_of(pairs: DataFrame, row_id: str) -> DataFrame:
    """(rid, member, n) of all members of groups of two or more equal codes; ``rid`` is the smallest member, n the size.

    ``pairs`` come from :func:`keyed_by`. Sizes are combined before the shuffle.
    """
    pairs = cut(pairs.distinct())
    groups = cut(pairs.groupBy("key").agg(F.min(row_id).alias("_first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    return cut(_with_group(pairs, groups, row_id).select(F.col("_first").alias("rid"), F.col(row_id).alias("member"), "n"))


def copy_groups(codes: DataFrame, keep: int) -> tuple[DataFrame, DataFrame, int]:
    """Exact copies: (id, ids) a vector that several ids have, and (vector_idx) of all those ids but the smallest;
    and the number of rows. ``ids`` are the ``keep`` smallest ids in order. The ranking is cut to ``keep`` before the shuffle, so a vector
    held by a third of all rows sends at most ``keep`` rows a map task.
    """
    pairs = cut(keyed_by(codes, "vector_idx"))
    order = Window.partitionBy("key").orderBy("vector_idx")
    ranked = pairs.withColumn("_r", F.dense_rank().over(order)).where(F.col("_r") <= keep)
    first = ranked.groupBy("key").agg(F.array_sort(F.collect_set("vector_idx")).alias("ids")).where(F.size("ids") > 1)
    first = cut(first.select("key", F.col("ids")[0].alias("id"), "ids"))
    spare = _with_group(pairs, first.select("key", "id"), "vector_idx").where(F.col("vector_idx") != F.col("id")).select("vector_idx")
    return first.select("id", "ids"), spare, pairs.count()


def distinct_vectors(codes: DataFrame, spare: DataFrame, bound: int = 500_000) -> DataFrame:
    """(id, code) of the smallest id of each vector; ``spare`` are the other ids (as from :func:`copy_groups`).

    Up to ``bound`` spare ids (4 MB) are broadcast, more are joined by a shuffle.
    """
    spare = cut(spare.distinct())
    few = spare.count() <= bound
    return codes.join(F.broadcast(spare) if few else spare, "vector_idx", "left_anti").select(F.col("vector_idx").alias("id"), "code")
