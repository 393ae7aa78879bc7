"""Centroid and hash-bucket indexes over vectors.

Centroids come from spherical k-means: seeds are rows evenly spaced in id order, each round assigns rows to the most
similar centroid (ties to the lowest), averages the raw vectors of each bucket (an empty bucket keeps its centroid) and scales
to length 1. A round is one pass: tasks add up their rows a bucket by matrix products, and only k sums of ``dimension``
numbers a task are shuffled. The driver holds the k centroids, never the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardlight.functions.scalars import stable_hash
from shardlight.operators.positions import rows_at


def bucket_count(rows: int, most: int) -> int:
    return min(most, max(1, int(rows**0.5)))


def seed_positions(rows: int, k: int) -> list[int]:
    """Positions of the seeds in id order: evenly spaced, rounded down, the last row last."""
    if k == 1:
        return [0]
    step = (rows - 1) / (k - 1)
    return [int(i * step) for i in range(k - 1)] + [rows - 1]


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(n == 0, 1, n)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Most similar centroid of each row by cosine; equal ones (to 12 digits) to the lowest number."""
    return np.argmax(np.round(_unit(x) @ _unit(centroids).T, 12), axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


@dataclass
class CentroidIndex:
    """Centroids (k x dimension) and the table of assignments (key, bucket_id)."""

    centroids: np.ndarray
    assignments: DataFrame
    key: str

    def probes(self, query: list[float], count: int = 3) -> list[int]:
        """The ``count`` buckets most similar to a query, best first."""
        q = np.asarray(query, np.float64)
        norms = np.sqrt((self.centroids**2).sum(1)) * (np.sqrt(q @ q) or 1)
        s = np.round(self.centroids @ q / np.where(norms == 0, 1, norms), 12)
        return [int(i) for i in np.lexsort((np.arange(len(s)), -s))[:count]]

    def probe_ranks(self, queries: np.ndarray) -> np.ndarray:
        """Place (from 1) of every bucket in the probing order of each query: queries x buckets."""
        order = np.argsort(-np.round(_unit(queries) @ _unit(self.centroids).T, 12), axis=1, kind="stable")
        ranks = np.empty_like(order)
        np.put_along_axis(ranks, order, np.arange(1, order.shape[1] + 1)[None, :], 1)
        return ranks

    def mask(self, probes: int):
        """A function from a block of queries to the buckets each probes (queries x buckets), for use in tasks."""
        index = CentroidIndex(self.centroids, None, self.key)
        return lambda queries: index.probe_ranks(queries) <= probes

    def probe_rows(self, queries: DataFrame) -> DataFrame:
        """(query_id, bucket_id, probe) of every bucket for each row of ``queries`` (query_id, vector)."""
        index = CentroidIndex(self.centroids, None, self.key)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    ranks = index.probe_ranks(_matrix(batch.column(1)))
                    ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(ranks)), ranks.shape[1])))
                    buckets = np.tile(np.arange(ranks.shape[1], dtype=np.int32), len(ranks))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(buckets), pa.array(ranks.ravel(), pa.int32())], names=["query_id", "bucket_id", "probe"])

        return queries.mapInArrow(run, "query_id long, bucket_id int, probe int")

    def recall_curve(self, queries: DataFrame, exact: DataFrame) -> DataFrame:
        """(probes, recall, hit_rate) for every number of probes.

        ``exact`` (query_id, key) are the true neighbours: one is found as soon as its bucket is probed. ``hit_rate`` is the
        part of all rows that a query meets on average.
        """
        ranks = self.probe_rows(queries)
        total, met = exact.count(), queries.count() * self.assignments.count()
        if not total:
            return exact.sparkSession.createDataFrame([], "probes int, recall double, hit_rate double")
        hits = exact.join(self.assignments, self.key).join(ranks, ["query_id", "bucket_id"]).groupBy("probe").agg(F.count(F.lit(1)).alias("hits"))
        rows = ranks.join(F.broadcast(self.sizes()), "bucket_id").groupBy("probe").agg(F.sum("size").alias("size"))
        upto = Window.orderBy("probe").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as buckets
        return rows.join(hits, "probe", "left").select(
            F.col("probe").alias("probes"), F.round(F.sum(F.coalesce("hits", F.lit(0))).over(upto) / total, 6).alias("recall"),
            F.round(F.sum("size").over(upto) / met, 6).alias("hit_rate"),
        )

    def candidates(self, query: list[float], count: int = 3) -> DataFrame:
        """Keys in the probed buckets."""
        return self.assignments.where(F.col("bucket_id").isin(self.probes(query, count))).select(self.key)

    def sizes(self) -> DataFrame:
        """(bucket_id, size) of all buckets, empty ones too."""
        spark = self.assignments.sparkSession
        every = spark.range(len(self.centroids)).select(F.col("id").cast("int").alias("bucket_id"))
        have = self.assignments.groupBy("bucket_id").agg(F.count(F.lit(1)).alias("n"))
        return every.join(have, "bucket_id", "left").select("bucket_id", F.coalesce("n", F.lit(0)).alias("size"))

    def stats(self) -> DataFrame:
        return self.sizes().agg(
            F.lit("centroid").alias("index_type"), F.count(F.lit(1)).alias("num_buckets"), F.sum("size").alias("indexed"),
            F.count_if(F.col("size") > 0).alias("non_empty_buckets"),
        )

    def centroid_rows(self) -> DataFrame:
        spark = self.assignments.sparkSession
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(self.centroids)]
        return spark.createDataFrame(rows, "bucket_id int, centroid array<double>")


def build_centroid_index(vectors: DataFrame, key: str, vector: str, num_buckets: int = 100, rounds: int = 8) -> CentroidIndex:
    """Builds the index over all rows with a vector. No rows give no buckets."""
    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.select(key, vector).where(F.col(vector).isNotNull())
    n = rows.count()
    if n == 0:
        return CentroidIndex(np.zeros((0, 0)), vectors.sparkSession.createDataFrame([], f"`{key}` {kind}, bucket_id int"), key)
    k = bucket_count(n, num_buckets)
    centroids = _seeds(rows, key, vector, n, k)
    if n > k:
        for _ in range(rounds):
            centroids = _round(rows, vector, centroids)
    return CentroidIndex(centroids, assign(rows, key, vector, centroids), key)


def _seeds(rows: DataFrame, key: str, vector: str, n: int, k: int) -> np.ndarray:
    """Vectors at the seed positions of the key order; only keys are sorted."""
    wanted = seed_positions(n, k)
    found, _ = rows_at(rows.select(key), [key], wanted)
    keys = {w: found[w][key] for w in wanted}
    picked = {r[0]: r[1] for r in rows.where(F.col(key).isin(list(set(keys.values())))).select(key, vector).collect()}  # at most k rows
    return np.array([picked[keys[w]] for w in wanted], np.float64)


def _round(rows: DataFrame, vector: str, centroids: np.ndarray) -> np.ndarray:
    k, d = centroids.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, d)), np.zeros(k, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0))
            a = nearest(x, centroids)
            np.add.at(sums, a, x)
            counts += np.bincount(a, minlength=k)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int32()), pa.array(list(sums[seen]), pa.list_(pa.float64())), pa.array(counts[seen])],
            names=["b", "s", "n"],
        )

    partial = rows.select(vector).mapInArrow(add_up, "b int, s array<double>, n long")
    total = partial.select("b", "n", F.posexplode("s").alias("i", "x")).groupBy("b", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    pdf: pd.DataFrame = total.toPandas()  # k x dimension numbers
    mean = centroids.copy()
    mean[pdf["b"], pdf["i"]] = pdf["x"] / pdf["n"]
    norms = np.sqrt((mean * mean).sum(1, keepdims=True))
    return mean / np.where(norms == 0, 1, norms)


def assign(rows: DataFrame, key: str, vector: str, centroids: np.ndarray) -> DataFrame:
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = nearest(_matrix(batch.column(1)), centroids) if batch.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.int32())], names=[key, "bucket_id"])

    return rows.select(key, vector).mapInArrow(run, f"`{key}` {kind}, bucket_id int")


# -- hash buckets -----------------------------------------------------------------------------------------------------
def hash_bucket(vector, buckets: int):
    """Bucket from the first eight components in steps of 0.0001: the stable hash of these numbers, joined by commas."""
    steps = F.transform(F.slice(vector, 1, 8), lambda x: F.floor(x.cast("double") * 10000 + 0.5).cast("string"))
    return F.pmod(stable_hash(F.concat_ws(",", steps)), F.lit(buckets).cast("decimal(20,0)")).cast("int")


def hash_probes(bucket, buckets: int, neighbours: int = 2):
    """The bucket and its neighbours on either side, around the end."""
    return F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(-neighbours), F.lit(neighbours)), lambda d: F.pmod(bucket + d, F.lit(buckets)))))
