"""Queries of the engine's own operators over the test tables, and the same in SQL.

All run over whole tables. Where the search operator needs queries, the rows whose id is divisible by 100 are the stated
query set.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardlight.config import EngineOptions
from shardlight.functions import scalars as S
from shardlight.functions.embedding import HashedProvider, embed
from shardlight.functions.metadata import metadata_filter
from shardlight.operators import chunker, deletions, index, search, stats, txlog
from shardlight.runtime import WHITESPACE, shared_dir, spread, table
from shardlight.sources.store import Engine

DIMENSION = 64
SEARCH_TEXT = "the nightly rebuild truncates the tombstone file"
FILTER = {"category": "science", "priority": 3}


# -- hashing, shards, vectors -------------------------------------------------------------------------------------------
def stable_hash(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", S.stable_hash(F.col("ext_id")).cast("string").alias("hash"))


def shard_assignment(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", S.shard_of(F.col("ext_id"), 4).alias("shard_id"))


def shard_stats(spark: SparkSession, root: str) -> DataFrame:
    return stats.shard_stats(shard_assignment(spark, root), 4)


def shard_details(spark: SparkSession, root: str) -> DataFrame:
    return stats.shard_details(table(spark, root, "chunks"))


def _first_vector(spark: SparkSession, root: str) -> list[float]:
    return table(spark, root, "embeddings").where("vec_id = 0").first()["embedding"]


def cosine_topk_exact(spark: SparkSession, root: str) -> DataFrame:
    """Flagship: the ten vectors most similar to vector 0."""
    hits = search.top_k(table(spark, root, "embeddings"), "vec_id", "embedding", _first_vector(spark, root), 10)
    return hits.select("vec_id", F.round("score", 6).alias("score"))


def cosine_topk_batch(spark: SparkSession, root: str) -> DataFrame:
    vectors = table(spark, root, "embeddings")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = search.top_k_batch(vectors, queries, "vec_id", "embedding", 10)
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def cosine_pairwise(spark: SparkSession, root: str) -> DataFrame:
    v = table(spark, root, "embeddings")
    following = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(following, "vec_id").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


def vector_norms(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embeddings").select("vec_id", F.round(S.l2_norm(F.col("embedding")), 6).alias("norm"))


def half_precision_vectors(spark: SparkSession, root: str) -> DataFrame:
    v = table(spark, root, "embeddings").select("vec_id", F.posexplode(S.half_precision(F.col("embedding"))).alias("pos", "value"))
    return v.select("vec_id", "pos", F.col("value").cast("double").alias("value"))


def filtered_search(spark: SparkSession, root: str) -> DataFrame:
    hits = search.top_k(table(spark, root, "embeddings"), "vec_id", "embedding", _first_vector(spark, root), 10, F.col("label") == 3)
    return hits.select("vec_id", "label", F.round("score", 6).alias("score"))


def metadata_filter_json(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents")
    return d.where(metadata_filter(F.col("metadata"), FILTER)).select("doc_id")


def metadata_filter_missing(spark: SparkSession, root: str) -> DataFrame:
    """None matches a missing key, a JSON null, and metadata that is no JSON object."""
    d = table(spark, root, "documents")
    return d.where(metadata_filter(F.col("metadata"), {"priority": None})).select("doc_id")


def union_sources(spark: SparkSession, root: str) -> DataFrame:
    v = table(spark, root, "embeddings").select("vec_id", "label")
    sharded, legacy = v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1")
    return sharded.withColumn("store", F.lit("sharded")).unionByName(legacy.withColumn("store", F.lit("legacy")))


# -- index --------------------------------------------------------------------------------------------------------------
def _index(spark: SparkSession, root: str) -> index.CentroidIndex:
    return index.build_centroid_index(table(spark, root, "embeddings"), "vec_id", "embedding")


def kmeans_centroids(spark: SparkSession, root: str) -> DataFrame:
    rows = _index(spark, root).centroid_rows().select("bucket_id", F.posexplode("centroid").alias("pos", "x"))
    return rows.select("bucket_id", "pos", F.round("x", 6).alias("value"))


def bucket_assignment(spark: SparkSession, root: str) -> DataFrame:
    return _index(spark, root).assignments


def bucket_stats(spark: SparkSession, root: str) -> DataFrame:
    return _index(spark, root).sizes()


def index_stats(spark: SparkSession, root: str) -> DataFrame:
    return _index(spark, root).stats()


def probe_buckets(spark: SparkSession, root: str) -> DataFrame:
    probes = _index(spark, root).probes(_first_vector(spark, root))
    return spark.createDataFrame([(i + 1, b) for i, b in enumerate(probes)], "rank int, bucket_id int")


def _ann(spark: SparkSession, root: str) -> DataFrame:
    query, vectors = _first_vector(spark, root), table(spark, root, "embeddings")
    candidates = _index(spark, root).candidates(query)
    return search.top_k(vectors.join(candidates, "vec_id", "left_semi"), "vec_id", "embedding", query, 10)


def ann_search(spark: SparkSession, root: str) -> DataFrame:
    return _ann(spark, root).select("vec_id", F.round("score", 6).alias("score"))


def ann_recall(spark: SparkSession, root: str) -> DataFrame:
    exact = cosine_topk_exact(spark, root).select("vec_id")
    both = exact.join(_ann(spark, root).select("vec_id"), "vec_id", "left_semi")
    return both.agg((F.count(F.lit(1)) / 10).alias("recall"))


def index_hit_rate(spark: SparkSession, root: str) -> DataFrame:
    found = _index(spark, root).candidates(_first_vector(spark, root)).agg(F.count(F.lit(1)).alias("candidates"))
    total = table(spark, root, "embeddings").agg(F.count(F.lit(1)).alias("total"))
    return found.join(F.broadcast(total), F.lit(True)).select("candidates", "total", F.round(F.col("candidates") / F.greatest("total", F.lit(1)), 6).alias("hit_rate"))


def _query_set(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _recall_curve(spark: SparkSession, root: str, built: index.CentroidIndex) -> DataFrame:
    return built.recall_curve(_query_set(spark, root), cosine_topk_batch(spark, root).select("query_id", "vec_id"))


def ann_recall_batch(spark: SparkSession, root: str) -> DataFrame:
    """Mean recall of the index over the stated query set, and the part of the rows met, for every number of probes."""
    return _recall_curve(spark, root, _index(spark, root))


def ann_search_batch(spark: SparkSession, root: str) -> DataFrame:
    """The stated query set through the index, with the fewest probes whose measured recall is at least 0.9."""
    built, vectors = _index(spark, root), table(spark, root, "embeddings")
    probes = _recall_curve(spark, root, built).where("recall >= 0.9").agg(F.min("probes")).first()[0] or 0
    placed = vectors.join(built.assignments, "vec_id")
    hits = search.top_k_batch(
        placed, _query_set(spark, root), "vec_id", "embedding", 10, bucket="bucket_id", probed=built.mask(probes)
    )
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def hash_bucket_index(spark: SparkSession, root: str) -> DataFrame:
    bucket = index.hash_bucket(F.col("embedding"), 100)
    return table(spark, root, "embeddings").select("vec_id", bucket.alias("bucket_id"), index.hash_probes(bucket, 100).alias("probes"))


# -- text ---------------------------------------------------------------------------------------------------------------
def chunk_documents(spark: SparkSession, root: str) -> DataFrame:
    return chunker.chunk(spread(table(spark, root, "documents").select("doc_id", "text")), "doc_id", "text")


def chunk_stats(spark: SparkSession, root: str) -> DataFrame:
    c = chunk_documents(spark, root)
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.min_by(F.length("text"), "chunk_no").alias("first_chunk_length"))


def _embedded(spark: SparkSession, root: str) -> DataFrame:
    return embed(chunk_documents(spark, root).select("doc_id", "chunk_no", "text"), "text", HashedProvider(DIMENSION), double=True)


def embed_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Norm and two projections of the embedding of every chunk of every document."""
    v = F.col("vector")
    ramp = F.array(*[F.lit(float(i)) for i in range(DIMENSION)])
    return _embedded(spark, root).select(
        "doc_id", "chunk_no", F.round(S.l2_norm(v), 6).alias("norm"), F.round(v[0], 6).alias("first"), F.round(S.dot(v, ramp), 5).alias("ramp")
    )


def text_search(spark: SparkSession, root: str) -> DataFrame:
    """Chunk, embed and rank every document against a query text."""
    query = HashedProvider(DIMENSION)([SEARCH_TEXT])[0].tolist()
    rows = _embedded(spark, root).withColumn("key", F.format_string("%012d#%06d", "doc_id", "chunk_no"))
    return search.top_k(rows, "key", "vector", query, 10).select("doc_id", "chunk_no", F.round("score", 6).alias("score"))


# -- the engine over the documents ------------------------------------------------------------------------------------------
def _engine(spark: SparkSession) -> Engine:
    """A new store whose searches probe every bucket, so that results are exact."""
    options = EngineOptions(dimension=DIMENSION, half_precision=False, probe_count=100, max_text_size=2**31 - 1)
    return Engine(spark, f"{shared_dir(spark)}/engine-{uuid.uuid4().hex}", options)


def _engine_documents(spark: SparkSession, root: str) -> DataFrame:
    return spread(table(spark, root, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "metadata"))


def _hits(hits: DataFrame) -> DataFrame:
    part = lambda n: F.element_at(F.split("chunk_id", "#"), n).cast("int")
    return hits.select(F.col("doc_id").cast("long").alias("doc_id"), part(-2).alias("version"), part(-1).alias("chunk_no"), F.round("score", 4).alias("score"))


def engine_search_after_ingest(spark: SparkSession, root: str) -> DataFrame:
    """Half of the documents are stored and indexed, the others stored after it; a search finds the best of all."""
    e, docs = _engine(spark), _engine_documents(spark, root)
    short = F.coalesce(F.length("text"), F.lit(0)) < 1000
    e.ingest(docs.where(short), limit_batch=False)
    e.rebuild_index()
    e.ingest(docs.where(~short), limit_batch=False)
    return _hits(e.search(SEARCH_TEXT, 10))


def engine_update_search(spark: SparkSession, root: str) -> DataFrame:
    """A document's new text is found at once, its old one no more."""
    e, docs = _engine(spark), _engine_documents(spark, root)
    e.ingest(docs, limit_batch=False)
    e.rebuild_index()
    e.update(str(e.chunks().agg(F.min(F.col("doc_id").cast("long"))).first()[0]), SEARCH_TEXT)
    return _hits(e.search(SEARCH_TEXT, 10))


def engine_log_clear(spark: SparkSession, root: str) -> DataFrame:
    """What a cleared log, and the store and index beside it, hold."""
    e, docs = _engine(spark), _engine_documents(spark, root)
    e.ingest(docs, limit_batch=False)
    e.rebuild_index()
    e.clear_log()
    indexed = json.loads(e.detailed_health().first()["index"])["indexed"]
    log = e.verify_log().agg(F.sum("total_entries").alias("entries"), F.sum("invalid").alias("invalid"))
    return e.health().select("documents", "chunks").join(F.broadcast(log), F.lit(True)).withColumn("indexed", F.lit(indexed))


# -- store state ----------------------------------------------------------------------------------------------------------
def active_chunks(spark: SparkSession, root: str) -> DataFrame:
    return deletions.active(table(spark, root, "chunks"), table(spark, root, "tombstones")).select("chunk_id").distinct()


def deletion_stats(spark: SparkSession, root: str) -> DataFrame:
    return deletions.stats(table(spark, root, "tombstones"))


def tombstone_purge(spark: SparkSession, root: str) -> DataFrame:
    """Tombstones more than 30 days older than the newest."""
    stones = deletions.once(table(spark, root, "tombstones"))
    now = stones.agg(F.max("deleted_at").alias("now"))
    return stones.join(F.broadcast(now), F.col("deleted_at") < F.col("now") - F.expr("INTERVAL 30 DAYS")).select("chunk_id", "deleted_at")


def batch_duplicates(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents")
    return d.groupBy("ext_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def ingest_conflicts(spark: SparkSession, root: str) -> DataFrame:
    """Documents whose id already has an active chunk."""
    live = deletions.active(table(spark, root, "chunks"), table(spark, root, "tombstones"))
    d = table(spark, root, "documents").select("doc_id", "ext_id")
    return d.join(live.select(F.col("doc_id").alias("ext_id")), "ext_id", "left_semi").select("doc_id")


def oversize_rejects(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").where(F.length("text") > 10_000).select("doc_id", F.length("text").alias("length"))


def document_summary(spark: SparkSession, root: str) -> DataFrame:
    return stats.document_summary(table(spark, root, "chunks"))


def store_stats(spark: SparkSession, root: str) -> DataFrame:
    return stats.store_stats(table(spark, root, "chunks"), table(spark, root, "tombstones"), DIMENSION)


def health(spark: SparkSession, root: str) -> DataFrame:
    return stats.health(table(spark, root, "chunks"), table(spark, root, "tombstones"))


def latest_version(spark: SparkSession, root: str) -> DataFrame:
    """The last received row of every document id."""
    d = table(spark, root, "documents")
    return d.groupBy("ext_id").agg(F.max_by("doc_id", F.struct("received_at", "doc_id")).alias("doc_id"))


def legacy_migration(spark: SparkSession, root: str) -> DataFrame:
    """Chunks of the old store (a vector index but rows in the vector table) with the shard they belong to."""
    vectors = table(spark, root, "vector_entries").select("vector_idx", "vector").where("vector IS NOT NULL").dropDuplicates(["vector_idx"])
    old = table(spark, root, "chunks").where("vector_idx IS NOT NULL").dropDuplicates(["chunk_id"])
    moved = old.join(vectors, "vector_idx").select(S.shard_of(F.col("doc_id"), 4).alias("shard_id"), "chunk_id")
    return moved.groupBy("shard_id").agg(F.count(F.lit(1)).alias("migrated"))


def shard_validation(spark: SparkSession, root: str) -> DataFrame:
    return stats.shard_validation(table(spark, root, "shard_info"))


# -- transaction log --------------------------------------------------------------------------------------------------------
def txlog_stats(spark: SparkSession, root: str) -> DataFrame:
    return txlog.counts(txlog.once(table(spark, root, "wal_entries")))


def txlog_pending(spark: SparkSession, root: str) -> DataFrame:
    return txlog.pending(txlog.once(table(spark, root, "wal_entries"))).select("tx_id", "operation", "doc_id")


def txlog_recovery(spark: SparkSession, root: str) -> DataFrame:
    return txlog.recovery_report(txlog.once(table(spark, root, "wal_entries")))


def txlog_verify(spark: SparkSession, root: str) -> DataFrame:
    """The log with its checksums, in which every failed entry was made a committed one afterwards: how many entries still hold."""
    sealed = txlog.with_checksum(txlog.once(table(spark, root, "wal_entries")))
    changed = F.when(F.col("status") == "failed", F.lit("committed")).otherwise(F.col("status"))
    return txlog.verify(sealed.withColumn("status", changed))


def txlog_checksums(spark: SparkSession, root: str) -> DataFrame:
    entries = txlog.once(table(spark, root, "wal_entries"))
    return entries.select("entry_id", S.checksum("entry_id", "tx_id", "operation", "doc_id", "status").alias("checksum"))


# -- measurements -----------------------------------------------------------------------------------------------------------
def latency_percentiles(spark: SparkSession, root: str) -> DataFrame:
    return stats.latency(table(spark, root, "events"), "value")


QUERIES = (
    stable_hash, shard_assignment, shard_stats, shard_details, cosine_topk_exact, cosine_topk_batch, cosine_pairwise, vector_norms,
    half_precision_vectors, filtered_search, metadata_filter_json, metadata_filter_missing, union_sources, kmeans_centroids,
    bucket_assignment, bucket_stats, index_stats, probe_buckets, ann_search, ann_recall, index_hit_rate, ann_recall_batch,
    ann_search_batch, hash_bucket_index,
    chunk_documents, chunk_stats, embed_chunks, text_search, engine_search_after_ingest, engine_update_search, engine_log_clear, active_chunks, deletion_stats, tombstone_purge, batch_duplicates,
    ingest_conflicts, oversize_rejects, document_summary, store_stats, health, latest_version, legacy_migration, shard_validation,
    txlog_stats, txlog_pending, txlog_recovery, txlog_verify, txlog_checksums, latency_percentiles,
)


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}


# -- the same in SQL ----------------------------------------------------------------------------------------------------------
_WS = "||".join(f"chr({ord(c)})" for c in WHITESPACE)
_HASH = "('0x' || substr(sha256({0}), 1, 16))::UBIGINT"
_D = "{0}::DOUBLE[]"


def _cos(a: str, b: str) -> str:
    a, b = _D.format(a), _D.format(b)
    n = f"(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
    return f"CASE WHEN {n} = 0 THEN 0.0 ELSE list_dot_product({a}, {b}) / {n} END"


_Q0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_TOP = f"SELECT * FROM (SELECT vec_id, label, {_cos('embedding', _Q0)} AS s FROM {{0}}) ORDER BY round(s, 12) DESC, vec_id LIMIT 10"


def _kmeans(rounds: int = 8) -> str:
    """The index as CTEs: v (rows), c<i>_ (centroids a dimension), a<i> (assignments); the last are c and a."""
    sql = f"""
v AS (SELECT vec_id, {_D.format('embedding')} AS e, row_number() OVER (ORDER BY vec_id) - 1 AS rn FROM embeddings),
n AS (SELECT count(*) AS n, least(100, greatest(1, floor(sqrt(count(*)))::INT)) AS k FROM v),
seed AS (SELECT i::INT AS b, CASE WHEN k = 1 THEN 0 WHEN i = k - 1 THEN n - 1 ELSE floor(i * ((n - 1)::DOUBLE / (k - 1)))::BIGINT END AS rn
  FROM n, range(100) t(i) WHERE i < k),
c0 AS (SELECT b, e AS c FROM seed JOIN v USING (rn)),
"""
    for i in range(rounds):
        sql += f"""a{i} AS MATERIALIZED (SELECT vec_id, arg_max(b, (s, -b)) AS b FROM (SELECT v.vec_id, c.b, round({_cos('v.e', 'c.c')}, 12) AS s FROM v, c{i} c) GROUP BY vec_id),
m{i} AS MATERIALIZED (SELECT b, list(x ORDER BY p) AS c FROM (SELECT b, p, avg(x) AS x FROM
  (SELECT a.b, unnest(v.e) AS x, unnest(range(len(v.e))) AS p FROM a{i} a JOIN v USING (vec_id)) GROUP BY b, p) GROUP BY b),
r{i} AS (SELECT c.b, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN m{i} m USING (b)),
c{i + 1} AS MATERIALIZED (SELECT b, CASE WHEN list_dot_product(c, c) = 0 THEN c ELSE list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) END AS c FROM r{i}),
"""
    sql += f"""c AS (SELECT b, c FROM c{rounds}),
a AS MATERIALIZED (SELECT vec_id, arg_max(b, (s, -b)) AS b FROM (SELECT v.vec_id, c.b, round({_cos('v.e', 'c.c')}, 12) AS s FROM v, c) GROUP BY vec_id),
probes AS (SELECT b, row_number() OVER (ORDER BY round({_cos('c', _Q0)}, 12) DESC, b) AS r FROM c QUALIFY r <= 3)"""
    return sql


_BATCH = f"""SELECT query_id, vec_id, s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS rank FROM
  (SELECT q.vec_id AS query_id, v.vec_id, {_cos('q.embedding', 'v.embedding')} AS s FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0{{0}}) QUALIFY rank <= 10"""

#: After _kmeans: pr (place of every bucket in the order of each query), ex (true neighbours), curve (recall by probes).
_CURVE = f"""
pr AS MATERIALIZED (SELECT q.vec_id AS query_id, c.b, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_cos('c.c', 'q.embedding')}, 12) DESC, c.b) AS r
  FROM embeddings q, c WHERE q.vec_id % 100 = 0),
ex AS MATERIALIZED ({_BATCH.format('')}),
near AS (SELECT r, count(*) AS hits FROM ex JOIN a USING (vec_id) JOIN pr ON pr.query_id = ex.query_id AND pr.b = a.b GROUP BY r),
met AS (SELECT r, count(a.vec_id) AS size FROM pr LEFT JOIN a USING (b) GROUP BY r),
curve AS MATERIALIZED (SELECT r::INT AS probes, round(sum(coalesce(hits, 0)) OVER (ORDER BY r) / (SELECT count(*) FROM ex), 6) AS recall,
  round(sum(size) OVER (ORDER BY r) / (SELECT sum(size) FROM met), 6) AS hit_rate FROM met LEFT JOIN near USING (r))"""

_CHUNKS = f"""
ws AS (SELECT {_WS} AS w),
d AS (SELECT doc_id, text, length(text) AS n FROM documents, ws WHERE trim(text, w) <> ''),
step(doc_id, s, e, last, no, emitted) AS (
  SELECT doc_id, 0, 0, -1, -1, false FROM d
  UNION ALL
  SELECT doc_id, s2, e2, CASE WHEN emit THEN s2 ELSE last END, CASE WHEN emit THEN no + 1 ELSE no END, emit FROM (
    SELECT *, trim(substr(text, s2 + 1, e2 - s2), w) <> '' AS emit FROM (
      SELECT *, CASE WHEN s2 + 512 >= n THEN n WHEN sp > 0 THEN s2 + 1 + length(win) - sp ELSE s2 + 512 END AS e2 FROM (
        SELECT *, CASE WHEN s2 + 512 < n THEN instr(reverse(win), ' ') ELSE 0 END AS sp FROM (
          SELECT *, substr(text, s2 + 2, 561) AS win FROM (
            SELECT t.doc_id, t.last, t.no, d.text, d.n, w,
              CASE WHEN t.no = -1 AND NOT t.emitted AND t.e = 0 THEN 0
                   WHEN t.e - 50 > greatest(t.last, 0) AND t.e - 50 > t.s THEN t.e - 50 ELSE greatest(t.e, t.s + 1) END AS s2
            FROM step t JOIN d USING (doc_id), ws) WHERE s2 < n AND no <= 10000))))
),
chunked AS (SELECT step.doc_id, no::INT AS chunk_no, s::INT AS start_idx, e::INT AS end_idx, trim(substr(text, s + 1, e - s), w) AS text
  FROM step JOIN d USING (doc_id), ws WHERE emitted)
"""

_EMBED = f"""
words AS (SELECT doc_id, chunk_no, list_filter(regexp_split_to_array(lower(text), '[\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+'), lambda x: x <> '') AS ws FROM chunked),
feats AS (
  SELECT doc_id, chunk_no, unnest(ws) AS f, 1 / (1 + 0.1 * unnest(range(len(ws)))) AS weight FROM words
  UNION ALL SELECT doc_id, chunk_no, substr(low, i::INT + 1, 2), 0.3 FROM (SELECT doc_id, chunk_no, lower(text) AS low, unnest(range(length(lower(text)) - 1)) AS i FROM chunked)
  UNION ALL SELECT doc_id, chunk_no, substr(low, i::INT + 1, 3), 0.2 FROM (SELECT doc_id, chunk_no, lower(text) AS low, unnest(range(length(lower(text)) - 2)) AS i FROM chunked)),
slots AS (SELECT f, ({_HASH.format('f')} % {DIMENSION})::INT AS slot FROM (SELECT DISTINCT f FROM feats)),
raw AS (SELECT doc_id, chunk_no, slot, sum(weight::DOUBLE) AS x FROM feats JOIN slots USING (f) GROUP BY ALL),
norms AS (SELECT doc_id, chunk_no, sqrt(sum(x * x)) AS norm FROM raw GROUP BY ALL),
emb AS (SELECT doc_id, chunk_no, slot, x / norm AS x FROM raw JOIN norms USING (doc_id, chunk_no))
"""

#: The query text in the same dimensions (q), and the cosine of every chunk with it.
_QUERY = f"""q AS (SELECT slot, sum(weight) AS y FROM (
  SELECT ({_HASH.format('f')} % {DIMENSION})::INT AS slot, weight FROM (
    SELECT unnest(string_split('{SEARCH_TEXT}', ' ')) AS f, 1 / (1 + 0.1 * unnest(range(len(string_split('{SEARCH_TEXT}', ' '))))) AS weight
    UNION ALL SELECT substr('{SEARCH_TEXT}', i::INT + 1, 2), 0.3 FROM range(length('{SEARCH_TEXT}') - 1) t(i)
    UNION ALL SELECT substr('{SEARCH_TEXT}', i::INT + 1, 3), 0.2 FROM range(length('{SEARCH_TEXT}') - 2) t(i))) GROUP BY slot),
scored AS (SELECT doc_id, chunk_no, sum(x * y) / (SELECT sqrt(sum(y * y)) FROM q) AS s FROM emb JOIN q USING (slot) GROUP BY ALL)
"""

_LOG = f"""
ws AS (SELECT {_WS} AS w),
log AS (SELECT entry_id, coalesce(nullif(trim(any_value(tx_id), any_value(w)), ''), 'legacy-' || entry_id) AS tx_id,
  coalesce(nullif(lower(trim(any_value(operation), any_value(w))), ''), 'unknown') AS operation, coalesce(trim(any_value(doc_id), any_value(w)), '') AS doc_id,
  coalesce(nullif(lower(trim(any_value(status), any_value(w))), ''), 'committed') AS status FROM wal_entries, ws GROUP BY entry_id),
ended AS (SELECT DISTINCT tx_id FROM log WHERE status IN ('committed', 'failed')),
pending AS (SELECT tx_id, arg_max(operation, entry_id) AS operation, arg_max(doc_id, entry_id) AS doc_id FROM log
  WHERE status = 'pending' AND tx_id NOT IN (SELECT tx_id FROM ended) GROUP BY tx_id)
"""

_STONES = f"""
ws AS (SELECT {_WS} AS w),
stones AS (SELECT lower(trim(chunk_id, w)) AS chunk_id, min(deleted_at) AS deleted_at FROM tombstones, ws WHERE trim(chunk_id, w) <> '' GROUP BY 1),
once AS (SELECT DISTINCT lower(trim(chunk_id, w)) AS chunk_id, doc_id, text_length, shard_id FROM chunks, ws WHERE trim(chunk_id, w) <> ''),
live AS (SELECT * FROM once WHERE chunk_id NOT IN (SELECT chunk_id FROM stones))
"""


def oracle_sql() -> dict[str, str]:
    km = _kmeans()
    half = """SELECT vec_id, pos::INT AS pos, CASE WHEN x = 0 THEN 0.0 ELSE round_even(x / q, 0) * q END AS value FROM (
        SELECT *, pow(2.0, greatest(floor(log2(abs(x))), -14) - 10) AS q FROM (
          SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings))"""
    shards = f"(SELECT doc_id, ({_HASH.format('ext_id')} % 4)::INT AS shard_id FROM documents)"
    json_ok = "CASE WHEN json_valid(metadata) AND json_type(metadata) = 'OBJECT' THEN metadata::JSON END"
    return {
        "hash_bucket_index": f"""SELECT vec_id, b AS bucket_id, list_sort([(b + d + 100) % 100 for d in [-2, -1, 0, 1, 2]]) AS probes FROM (
            SELECT vec_id, ({_HASH.format("list_aggregate(list_transform(embedding[1:8], lambda x: floor(x::DOUBLE * 10000 + 0.5)::BIGINT::VARCHAR), 'string_agg', ',')")} % 100)::INT AS b FROM embeddings)""",
        "stable_hash": f"SELECT doc_id, ({_HASH.format('ext_id')})::VARCHAR AS hash FROM documents",
        "shard_assignment": f"SELECT doc_id, shard_id FROM {shards}",
        "shard_stats": f"""SELECT s::INT AS shard_id, count(x.doc_id) AS vectors, (SELECT count(*) FROM documents) AS total, round((SELECT count(*) FROM documents) / 4, 6) AS average
            FROM range(4) t(s) LEFT JOIN {shards} x ON x.shard_id = s GROUP BY s""",
        "shard_details": """SELECT shard_id, count(*) AS chunks, count(DISTINCT doc_id) AS documents, sum(text_length)::BIGINT AS characters
            FROM (SELECT DISTINCT chunk_id, doc_id, shard_id, text_length FROM chunks) GROUP BY shard_id""",
        "cosine_topk_exact": f"SELECT vec_id, round(s, 6) AS score FROM ({_TOP.format('embeddings')})",
        "cosine_topk_batch": f"""SELECT query_id, vec_id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS rank
            FROM (SELECT q.vec_id AS query_id, v.vec_id, {_cos('q.embedding', 'v.embedding')} AS s FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)) WHERE rank <= 10""",
        "cosine_pairwise": f"SELECT v.vec_id, round({_cos('v.embedding', 'o.embedding')}, 6) AS score FROM embeddings v JOIN embeddings o ON o.vec_id = v.vec_id + 1",
        "vector_norms": f"SELECT vec_id, round(sqrt(list_dot_product({_D.format('embedding')}, {_D.format('embedding')})), 6) AS norm FROM embeddings",
        "half_precision_vectors": half,
        "filtered_search": f"SELECT vec_id, label, round(s, 6) AS score FROM ({_TOP.format('embeddings WHERE label = 3')})",
        "metadata_filter_json": f"""SELECT doc_id FROM (SELECT doc_id, {json_ok} AS m FROM documents) WHERE json_type(m, '$.category') = 'VARCHAR' AND m ->> '$.category' = 'science'
            AND json_type(m, '$.priority') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND (m ->> '$.priority')::DOUBLE = 3""",
        "metadata_filter_missing": f"SELECT doc_id FROM (SELECT doc_id, {json_ok} AS m FROM documents) WHERE coalesce(json_type(m, '$.priority'), 'NULL') = 'NULL'",
        "union_sources": """SELECT vec_id, label, 'sharded' AS store FROM embeddings WHERE vec_id % 2 = 0
            UNION ALL SELECT vec_id, label, 'legacy' FROM embeddings WHERE vec_id % 2 = 1""",
        "kmeans_centroids": f"WITH {km} SELECT b AS bucket_id, unnest(range(len(c)))::INT AS pos, round(unnest(c), 6) AS value FROM c",
        "bucket_assignment": f"WITH {km} SELECT vec_id, b AS bucket_id FROM a",
        "bucket_stats": f"WITH {km} SELECT c.b AS bucket_id, count(a.vec_id) AS size FROM c LEFT JOIN a USING (b) GROUP BY 1",
        "index_stats": f"""WITH {km}, z AS (SELECT c.b, count(a.vec_id) AS size FROM c LEFT JOIN a USING (b) GROUP BY 1)
            SELECT 'centroid' AS index_type, count(*) AS num_buckets, sum(size)::BIGINT AS indexed, count(*) FILTER (size > 0) AS non_empty_buckets FROM z""",
        "probe_buckets": f"WITH {km} SELECT r::INT AS rank, b AS bucket_id FROM probes",
        "ann_search": f"WITH {km} SELECT vec_id, round(s, 6) AS score FROM ({_TOP.format('embeddings WHERE vec_id IN (SELECT vec_id FROM a WHERE b IN (SELECT b FROM probes))')})",
        "ann_recall": f"""WITH {km}, x AS ({_TOP.format('embeddings')}),
            y AS ({_TOP.format('embeddings WHERE vec_id IN (SELECT vec_id FROM a WHERE b IN (SELECT b FROM probes))')})
            SELECT count(*) / 10 AS recall FROM x WHERE vec_id IN (SELECT vec_id FROM y)""",
        "index_hit_rate": f"""WITH {km} SELECT (SELECT count(*) FROM a WHERE b IN (SELECT b FROM probes)) AS candidates, count(*) AS total,
            round((SELECT count(*) FROM a WHERE b IN (SELECT b FROM probes)) / count(*), 6) AS hit_rate FROM embeddings""",
        "ann_recall_batch": f"WITH {km}, {_CURVE} SELECT probes, recall, hit_rate FROM curve",
        "ann_search_batch": f"""WITH {km}, {_CURVE}, y AS ({_BATCH.format(""" AND (q.vec_id, v.vec_id) IN (SELECT pr.query_id, a.vec_id FROM pr JOIN a USING (b)
              WHERE pr.r <= (SELECT min(probes) FROM curve WHERE recall >= 0.9))""")})
            SELECT query_id, vec_id, round(s, 6) AS score, rank FROM y""",
        "chunk_documents": f"WITH RECURSIVE {_CHUNKS} SELECT * FROM chunked",
        "chunk_stats": f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, count(*) AS chunks, arg_min(length(text), chunk_no) AS first_chunk_length FROM chunked GROUP BY doc_id",
        "embed_chunks": f"""WITH RECURSIVE {_CHUNKS}, {_EMBED} SELECT doc_id, chunk_no, round(sqrt(sum(x * x)), 6) AS norm,
            round(coalesce(sum(x) FILTER (slot = 0), 0), 6) AS first, round(sum(x * slot), 5) AS ramp FROM emb GROUP BY ALL""",
        "text_search": f"""WITH RECURSIVE {_CHUNKS}, {_EMBED}, {_QUERY} SELECT doc_id, chunk_no, round(s, 6) AS score FROM scored ORDER BY round(s, 12) DESC, doc_id, chunk_no LIMIT 10""",
        "engine_search_after_ingest": f"""WITH RECURSIVE {_CHUNKS}, {_EMBED}, {_QUERY} SELECT doc_id, 1 AS version, chunk_no, round(s, 4) AS score FROM scored
            ORDER BY round(s, 7) DESC, doc_id || '#1#' || chunk_no LIMIT 10""",
        "engine_update_search": f"""WITH RECURSIVE {_CHUNKS}, {_EMBED}, {_QUERY}, f AS (SELECT min(doc_id) AS first FROM chunked),
            every AS (SELECT doc_id, 1 AS version, chunk_no, s FROM scored, f WHERE doc_id <> first UNION ALL SELECT first, 2, 0, 1.0 FROM f)
            SELECT doc_id, version, chunk_no, round(s, 4) AS score FROM every ORDER BY round(s, 7) DESC, doc_id || '#' || version || '#' || chunk_no LIMIT 10""",
        "engine_log_clear": f"""WITH RECURSIVE {_CHUNKS} SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks, 1::BIGINT AS entries, 0::BIGINT AS invalid,
            count(*)::INT AS indexed FROM chunked""",
        "active_chunks": f"WITH {_STONES} SELECT DISTINCT c.chunk_id FROM chunks c, ws WHERE trim(c.chunk_id, w) <> '' AND lower(trim(c.chunk_id, w)) NOT IN (SELECT chunk_id FROM stones)",
        "deletion_stats": f"WITH {_STONES} SELECT count(*) AS deleted, min(deleted_at) AS first_at, max(deleted_at) AS last_at FROM stones",
        "tombstone_purge": f"WITH {_STONES} SELECT chunk_id, deleted_at FROM stones WHERE deleted_at < (SELECT max(deleted_at) FROM stones) - INTERVAL 30 DAYS",
        "batch_duplicates": "SELECT ext_id, count(*) AS rows FROM documents GROUP BY ext_id HAVING count(*) > 1",
        "ingest_conflicts": f"WITH {_STONES} SELECT doc_id FROM documents WHERE ext_id IN (SELECT doc_id FROM live)",
        "oversize_rejects": "SELECT doc_id, length(text)::INT AS length FROM documents WHERE length(text) > 10000",
        "document_summary": """SELECT doc_id, count(*) AS chunk_count, arg_min(text_length, (start_idx, end_idx, chunk_id)) AS first_chunk_length
            FROM (SELECT DISTINCT chunk_id, doc_id, text_length, start_idx, end_idx FROM chunks) GROUP BY doc_id""",
        "store_stats": f"""WITH {_STONES} SELECT (SELECT count(DISTINCT doc_id) FROM live) AS documents, (SELECT count(*) FROM live) AS chunks,
            (SELECT count(*) FROM once) AS stored_chunks, (SELECT count(*) FROM stones) AS deleted, (SELECT count(DISTINCT shard_id) FROM once) AS shards, 64 AS dimension""",
        "health": f"WITH {_STONES} SELECT 'healthy' AS status, (SELECT count(DISTINCT doc_id) FROM live) AS documents, (SELECT count(*) FROM live) AS chunks",
        "latest_version": "SELECT ext_id, arg_max(doc_id, (received_at, doc_id)) AS doc_id FROM documents GROUP BY ext_id",
        "legacy_migration": f"""SELECT shard_id, count(*) AS migrated FROM (SELECT DISTINCT c.chunk_id, ({_HASH.format('c.doc_id')} % 4)::INT AS shard_id
            FROM chunks c WHERE c.vector_idx IN (SELECT vector_idx FROM vector_entries WHERE vector IS NOT NULL)) GROUP BY shard_id""",
        "shard_validation": """SELECT info_id, CASE WHEN chunk_ids IS NULL THEN 'missing' WHEN len(chunk_ids) = 0 THEN 'empty'
            WHEN vector_count IS DISTINCT FROM len(chunk_ids) THEN 'count_mismatch' WHEN list_count(chunk_ids) < len(chunk_ids) OR len(list_distinct(chunk_ids)) < list_count(chunk_ids) THEN 'corrupt' ELSE 'ok' END AS state
            FROM (SELECT DISTINCT info_id, vector_count, chunk_ids FROM shard_info)""",
        "txlog_stats": f"""WITH {_LOG} SELECT 'operation' AS field, operation AS value, count(*) AS entries FROM log GROUP BY operation
            UNION ALL SELECT 'status', status, count(*) FROM log GROUP BY status""",
        "txlog_pending": f"WITH {_LOG} SELECT * FROM pending",
        "txlog_recovery": f"""WITH {_LOG} SELECT (SELECT count(*) FROM pending) AS pending, 0 AS recovered, (SELECT count(*) FROM log WHERE status = 'failed') AS failed,
            (SELECT count(*) FROM log) AS total_entries, (SELECT max(entry_id) FROM log) AS entry_counter""",
        "txlog_verify": f"WITH {_LOG} SELECT count(*) AS total_entries, count(*) FILTER (status <> 'failed') AS valid, count(*) FILTER (status = 'failed') AS invalid FROM log",
        "txlog_checksums": f"""WITH {_LOG} SELECT entry_id, sha256('{{"doc_id":' || to_json(doc_id) || ',"entry_id":"' || entry_id || '","operation":' || to_json(operation)
            || ',"status":' || to_json(status) || ',"tx_id":' || to_json(tx_id) || '}}') AS checksum FROM log""",
        "latency_percentiles": """SELECT n::BIGINT AS samples, round(m, 6) AS mean, lo AS min, hi AS max, l[floor(n * 0.5)::INT + 1] AS p50, l[floor(n * 0.95)::INT + 1] AS p95,
            l[floor(n * 0.99)::INT + 1] AS p99, l[greatest(floor(n * 0.95)::INT, 1)] AS p95_lower FROM (
            SELECT count(value) AS n, avg(value) AS m, min(value) AS lo, max(value) AS hi, list(value ORDER BY value) FILTER (value IS NOT NULL) AS l FROM events)""",
    }
