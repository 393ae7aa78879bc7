"""Exact cosine search: one query, a batch of queries, filtered."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardlight.functions.scalars import cosine


def top_k(vectors: DataFrame, key: str, vector: str, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """The ``k`` rows most similar to the query: all columns plus ``score``; ties by key.

    The query is a literal, so the plan is scan, filter, project, take-ordered: no shuffle.
    """
    rows = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("score", cosine(F.col(vector), q)).orderBy(F.desc(F.round("score", 12)), key).limit(k)


def best_keys(vectors: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """(key, score) of the ``k`` rows most similar to the query, ties by key: a task scores its Arrow batches by a matrix product and
    hands on the best ``k`` of each; only two columns are read."""
    kind = vectors.schema[key].dataType.simpleString()
    q = _scaled(np.array([query], np.float64))[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = np.round(_scaled(_matrix(batch.column(1))) @ q, 15)
                near = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k] - 1e-12) if len(s) > k else np.arange(len(s))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(near)), pa.array(s[near])], names=[key, "score"])

    scored = vectors.select(key, vector).where(F.col(vector).isNotNull()).mapInArrow(run, f"`{key}` {kind}, score double")
    return scored.orderBy(F.desc(F.round("score", 12)), key).limit(k)


def top_k_batch(
    vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, query_block: int = 2048, row_block: int = 65_536,
    bucket: str | None = None, probed: Callable[[np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """(query_id, key, score, rank): the best ``k`` rows for each row of ``queries`` (query_id, vector).

    A stated query set meets all rows in blocks. Up to ``query_block`` queries travel with the tasks, and the vectors are read where they are.
    More are cut into blocks on both sides, and each pair of blocks is a task: neither side is collected, and the vectors are scanned once.
    A task keeps ``k`` rows a query by a matrix product; only those are ranked after a shuffle. With ``bucket``, a column
    of ``vectors``, a query meets only the rows of its buckets: ``probed`` gives them as a mask (queries x buckets) for a block of queries.
    """
    kind = vectors.schema[key].dataType.simpleString()
    shape = f"query_id long, `{key}` {kind}, score double"
    rows = vectors.select(key, vector, *([bucket] if bucket else [])).where(F.col(vector).isNotNull())
    total = queries.count()

    def best(ids: np.ndarray, q: np.ndarray, keys: pa.Array, x: np.ndarray, own: np.ndarray | None) -> pa.RecordBatch:
        s = q @ _scaled(x).T
        if own is not None:
            s[~probed(q)[:, own]] = -np.inf
        if s.shape[1] > k:
            # everything at least as good as the k-th, so that ties are decided by key in the end
            floor = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - 1e-12
            qi, xi = np.nonzero((s >= floor[:, None]) & (s > -np.inf))
        else:
            qi, xi = np.nonzero(s > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(ids[qi]), keys.take(pa.array(xi)), pa.array(s[qi, xi])], names=["query_id", key, "score"])

    if total <= query_block:
        asked = queries.select("query_id", vector).collect()  # at most a block
        if not asked:
            return vectors.sparkSession.createDataFrame([], shape + ", rank int")
        ids, q = np.array([r[0] for r in asked]), _scaled(np.array([r[1] for r in asked], np.float64))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield best(ids, q, batch.column(0), _matrix(batch.column(1)), batch.column(2).to_numpy() if bucket else None)

        scored = rows.mapInArrow(run, shape)
    else:
        q_blocks, r_blocks = -(-total // query_block), max(1, -(-rows.count() // row_block))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        own_block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        none = [F.lit(None).cast(rows.schema[bucket].dataType).alias("_b")] if bucket else []
        data = rows.select(
            own_block(key, r_blocks).alias("_r"), every(q_blocks).alias("_q"), F.lit(None).cast("long").alias("_id"), F.col(key).alias("_key"),
            F.col(vector).cast("array<float>" if "float" in rows.schema[vector].dataType.simpleString() else "array<double>").alias("_v"),
            *([F.col(bucket).alias("_b")] if bucket else []),
        )
        asking = queries.select(
            every(r_blocks).alias("_r"), own_block("query_id", q_blocks).alias("_q"), F.col("query_id").cast("long").alias("_id"), F.lit(None).cast(kind).alias("_key"),
            F.col(vector).cast(data.schema["_v"].dataType).alias("_v"), *none,
        )

        def meet(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            is_q = table["_id"].is_valid()
            asked, have = table.filter(is_q), table.filter(pa.compute.invert(is_q))
            if not len(asked) or not len(have):
                empty = pa.RecordBatch.from_arrays([pa.array([], pa.int64()), have["_key"].combine_chunks().slice(0, 0), pa.array([], pa.float64())], names=["query_id", key, "score"])
                return pa.Table.from_batches([empty])
            part = best(
                asked["_id"].to_numpy(), _scaled(_matrix(asked["_v"].combine_chunks())), have["_key"].combine_chunks(), _matrix(have["_v"].combine_chunks()),
                have["_b"].to_numpy() if bucket else None,
            )
            return pa.Table.from_batches([part])

        scored = data.unionByName(asking).groupBy("_r", "_q").applyInArrow(meet, shape)
    ranked = scored.selectExpr("*", f"row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, `{key}`) AS rank")
    return ranked.where(F.col("rank") <= k)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _scaled(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(n == 0, 1, n)
