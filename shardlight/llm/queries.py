"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardlight.folder import Folder
from shardlight.llm import markov, minhash, mixing, packing, sentences, splitter, tokens
from shardlight.llm import permutation_index as pix
from shardlight.llm.vectors import usable, without_conflicts
from shardlight.runtime import WHITESPACE, shared_dir, spread, stored, table


def _clustering(spark: SparkSession, root: str, whole: bool = False) -> markov.Clustering:
    return markov.markov_clusters(table(spark, root, "vector_entries"), whole=whole)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Members of sets of three or more vectors joined by cosines of at least 0.85."""
    c = _clustering(spark, root)
    sets = c.with_copies(c.members, "grp", 3)
    return sets.select("vector_idx", F.col("grp").alias("cluster_key"))


def p1_clusters(spark: SparkSession, root: str) -> DataFrame:
    """Markov clusters with size and most typical members."""
    return markov.describe(_clustering(spark, root, whole=True))


def p1_sets(spark: SparkSession, root: str) -> DataFrame:
    """The sets of p1_found with size and most typical members."""
    d = markov.describe(_clustering(spark, root, whole=True), label="grp", by="closeness", least=3)
    return d.withColumnRenamed("grp", "cluster_key")


def _records(spark: SparkSession, root: str) -> DataFrame:
    """Documents and chunks as (rid, text, arrived); the first letter of ``rid`` tells the kind."""
    docs = table(spark, root, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("rid"), "text", F.col("received_at").alias("arrived")
    )
    chunks = table(spark, root, "chunks").select(F.concat(F.lit("c"), "chunk_id").alias("rid"), "text", F.col("created_at").alias("arrived"))
    return docs.unionByName(chunks)


def _kind(rid: str):
    return F.when(F.col(rid).startswith("d"), "document").otherwise("chunk")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of documents, and of chunks, that share at least 0.6 of their 5-character substrings."""
    pairs = minhash.near_duplicates(_records(spark, root)).pairs()
    a, b = F.substring("rid_a", 2, 2**31 - 1), F.substring("rid_b", 2, 2**31 - 1)
    return pairs.select(_kind("rid_a").alias("record_type"), F.least(a, b).alias("key_a"), F.greatest(a, b).alias("key_b"))


def p3_classes(spark: SparkSession, root: str) -> DataFrame:
    """Each record with a near duplicate: the class it belongs to and its number of links."""
    c = minhash.near_duplicates(_records(spark, root)).classes()
    return c.select(_kind("rid").alias("record_type"), F.expr("substring(rid, 2)").alias("record_key"), F.expr("substring(class_id, 2)").alias("class_id"), "links")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of vectors with cosine of at least 0.85 that are among each other's first ten."""
    reps, copied, rows = pix.prepare(table(spark, root, "vector_entries"), keep=11)
    return pix.mutual(pix.expand_neighbours(pix.neighbour_links(reps, 0.85, 10, rows=rows), copied, 10))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Stored chunks that aren't sound pieces of their document."""
    return splitter.faulty_chunks(table(spark, root, "documents"), table(spark, root, "chunks")).select("chunk_id")


def p4_pieces(spark: SparkSession, root: str) -> DataFrame:
    """Pieces of the documents above the limit."""
    p = splitter.split_documents(table(spark, root, "documents"))
    return p.select(F.col("key").cast("long").alias("doc_id"), "piece_no", "start_idx", "end_idx")


def p4_file_pieces(spark: SparkSession, root: str) -> DataFrame:
    """The same documents one after the other in large files, which are cut by byte ranges: pieces of each file."""
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    long = table(spark, root, "documents").where(F.length("text") > splitter.SplitOptions().limit)
    long.select("text").write.option("lineSep", "\n\n").text(path)
    paths = [f"{path}/{n}" for n in Folder(spark, path).names() if n.startswith("part-")]  # as many as the scan has tasks
    p = splitter.split_files(spark, paths, range_bytes=1 << 20)
    return p.select(F.regexp_extract("key", r"part-(\d+)", 1).cast("int").alias("file_no"), "piece_no", "start_idx", "end_idx")


def _packed(spark: SparkSession, root: str) -> DataFrame:
    capacities = [(r[0], r[1]) for r in table(spark, root, "pack_capacities").select("container_kind", "capacity_tokens").collect()]
    items = stored(tokens.token_counts(spread(table(spark, root, "documents").select("doc_id", "text")), ["doc_id"]), "items")
    return packing.pack(items, capacities)


def p8_packing(spark: SparkSession, root: str) -> DataFrame:
    """Every document (or piece of an oversize one) with its container of each kind and the space left in it."""
    return _packed(spark, root)


def p8_report(spark: SparkSession, root: str) -> DataFrame:
    """Containers, used and unused space of each kind."""
    return packing.report(_packed(spark, root))


def _sized(spark: SparkSession, root: str) -> DataFrame:
    return stored(tokens.token_counts(spread(table(spark, root, "documents").select("doc_id", "source", "text")), ["doc_id", "source"]), "sized")


def p9_mix(spark: SparkSession, root: str) -> DataFrame:
    """Chosen documents and how often each is used."""
    return mixing.mix(_sized(spark, root), mixing.read_targets(table(spark, root, "mix_targets")))


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    """Target and actual shares of each source."""
    sized, targets = _sized(spark, root), mixing.read_targets(table(spark, root, "mix_targets"))
    return mixing.shares(mixing.mix(sized, targets), sized, targets)


def p5_topk(spark: SparkSession, root: str) -> DataFrame:
    """The ten most similar other vectors of every vector whose id is divisible by 100, among all."""
    codes = usable(without_conflicts(table(spark, root, "vector_entries")))
    hits = pix.top_k(codes, codes.where("vector_idx % 100 = 0"))
    return hits.select("query_id", "neighbour", (F.col("cos6") / 1e6).alias("cosine"), "rank")


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """Sentence units of every document."""
    return sentences.sentence_units(spread(table(spark, root, "documents").select("doc_id", "text")))


def queries() -> dict:
    return {q.__name__: q for q in (p1_found, p1_clusters, p1_sets, p3_found, p3_classes, p4_found, p4_pieces, p4_file_pieces, p5_found, p5_topk, p8_packing, p8_report, p9_mix, p9_shares, p10_found)}


_WS = "||".join(f"chr({ord(c)})" for c in WHITESPACE)
_WORD = r"'^[\p{L}\p{N}]$'"
#: Usable vectors and their pairs of a cosine of at least 0.85, by brute force.
_LINKS = """
v AS MATERIALIZED (SELECT vector_idx, vector::DOUBLE[64] AS x FROM (SELECT vector_idx, arg_min(vector, arrived_at) AS vector FROM vector_entries WHERE vector_idx IS NOT NULL GROUP BY 1)
  WHERE len(vector) = 64 AND len(list_filter(vector, lambda y: NOT coalesce(isfinite(y), false))) = 0 AND len(list_filter(vector, lambda y: y <> 0)) > 0),
links AS MATERIALIZED (SELECT * FROM (SELECT p.vector_idx AS a, q.vector_idx AS b, round(array_cosine_similarity(p.x, q.x), 6) AS c FROM v p JOIN v q ON p.vector_idx < q.vector_idx) WHERE c >= 0.85)
"""
#: Records by their normalised text (t), and the pairs of texts that share 0.6 of their substrings of five. A pair of that
#: similarity shares one of the rarest two fifths (and one) of the substrings of either text, so only those are joined.
_NEAR = r"""
every AS (SELECT 'd' AS kind, doc_id::VARCHAR AS key, text, received_at AS arrived FROM documents UNION ALL SELECT 'c', chunk_id, text, created_at FROM chunks WHERE chunk_id IS NOT NULL),
first AS (SELECT kind, key, arg_min(text, arrived) AS text FROM every WHERE text IS NOT NULL GROUP BY kind, key),
norm AS (SELECT kind, key, lower(trim(regexp_replace(text, '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))) AS n FROM first),
texts AS MATERIALIZED (SELECT kind, n, row_number() OVER (ORDER BY kind, n) AS t FROM (SELECT DISTINCT kind, n FROM norm WHERE length(n) >= 200)),
rec AS MATERIALIZED (SELECT key, t FROM norm JOIN texts USING (kind, n)),
grams AS MATERIALIZED (SELECT t, kind, unnest(list_distinct(list_transform(range(1, length(n) - 3), lambda i: substr(n, i, 5)))) AS g FROM texts),
ranked AS MATERIALIZED (SELECT t, kind, g, size, row_number() OVER (PARTITION BY t ORDER BY f, g) AS r FROM
  (SELECT *, count(*) OVER (PARTITION BY kind, g) AS f, count(*) OVER (PARTITION BY t) AS size FROM grams)),
rare AS MATERIALIZED (SELECT t, kind, g FROM ranked WHERE r <= size - ceil(0.6 * size) + 1),
cand AS MATERIALIZED (SELECT DISTINCT x.t AS a, y.t AS b FROM rare x JOIN rare y ON x.kind = y.kind AND x.g = y.g AND x.t < y.t),
sizes AS MATERIALIZED (SELECT t, count(*) AS size FROM grams GROUP BY t),
near AS (SELECT a, b, sa.size AS sa, sb.size AS sb FROM cand JOIN sizes sa ON sa.t = a JOIN sizes sb ON sb.t = b WHERE least(sa.size, sb.size) >= 0.6 * greatest(sa.size, sb.size)),
pairs AS MATERIALIZED (SELECT a, b FROM (SELECT a, b, any_value(sa) AS sa, any_value(sb) AS sb, count(*) AS n FROM near JOIN grams x ON x.t = a JOIN grams y ON y.t = b AND y.g = x.g GROUP BY a, b)
  WHERE n >= 0.6 * (sa + sb - n))
"""
#: After _NEAR: the cases of p3_found.
_CASES = """
cases AS MATERIALIZED (SELECT u.kind, least(x.key, y.key) AS key_a, greatest(x.key, y.key) AS key_b
  FROM (SELECT p.a, p.b FROM pairs p UNION ALL SELECT t, t FROM texts) p JOIN rec x ON x.t = p.a JOIN rec y ON y.t = p.b JOIN texts u ON u.t = p.a
  WHERE p.a <> p.b OR x.key < y.key)"""
_BLANK = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_MARKS = r"'[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.!?。！？।؟]'"


def oracle_sql() -> dict[str, str]:
    """Only what SQL gives exactly and in time over whole tables."""
    return {
        "p1_found": f"""
            WITH RECURSIVE {_LINKS},
            ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
            reach(node, least) AS (SELECT a, least(a, min(b)) FROM ends GROUP BY a UNION SELECT e.b, r.least FROM reach r JOIN ends e ON e.a = r.node WHERE r.least < e.b),
            grouped AS (SELECT node, min(least) AS cluster_key FROM reach GROUP BY node)
            SELECT node AS vector_idx, cluster_key FROM grouped WHERE cluster_key IN (SELECT cluster_key FROM grouped GROUP BY 1 HAVING count(*) >= 3)""",
        "p5_found": f"""
            WITH {_LINKS},
            near AS (SELECT * FROM (SELECT a AS v, b AS o, c FROM links UNION ALL SELECT b, a, c FROM links) QUALIFY row_number() OVER (PARTITION BY v ORDER BY c DESC, o) <= 10)
            SELECT x.v AS vector_a, x.o AS vector_b FROM near x JOIN near y ON x.v = y.o AND x.o = y.v WHERE x.v < x.o""",
        "p1_sets": f"""
            WITH RECURSIVE {_LINKS},
            ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
            reach(node, least) AS (SELECT a, least(a, min(b)) FROM ends GROUP BY a UNION SELECT e.b, r.least FROM reach r JOIN ends e ON e.a = r.node WHERE r.least < e.b),
            grouped AS (SELECT node, min(least) AS k, x FROM reach JOIN v ON node = vector_idx GROUP BY node, x),
            once AS (SELECT min(node) AS id, k, x FROM grouped GROUP BY k, x),
            close AS (SELECT p.k, p.id, round(sum(array_cosine_similarity(p.x, q.x)), 6) AS c FROM once p JOIN once q USING (k) GROUP BY p.k, p.id)
            SELECT k AS cluster_key, (SELECT count(*) FROM grouped g WHERE g.k = close.k) AS size, list(id ORDER BY c DESC, id)[:3] AS typical FROM close GROUP BY k HAVING size >= 3""",
        "p3_found": f"WITH {_NEAR}, {_CASES} SELECT CASE kind WHEN 'd' THEN 'document' ELSE 'chunk' END AS record_type, key_a, key_b FROM cases",
        "p3_classes": f"""
            WITH RECURSIVE {_NEAR}, {_CASES},
            ends AS (SELECT kind, key_a AS a, key_b AS b FROM cases UNION SELECT kind, key_b, key_a FROM cases),
            reach(kind, node, least) AS (SELECT kind, a, least(a, min(b)) FROM ends GROUP BY kind, a
              UNION SELECT e.kind, e.b, r.least FROM reach r JOIN ends e ON e.kind = r.kind AND e.a = r.node WHERE r.least < e.b),
            class AS (SELECT kind, node, min(least) AS class_id FROM reach GROUP BY kind, node)
            SELECT CASE kind WHEN 'd' THEN 'document' ELSE 'chunk' END AS record_type, node AS record_key, class_id, (SELECT count(*) FROM ends e WHERE e.kind = class.kind AND e.a = node) AS links
            FROM class""",
        "p4_pieces": f"""
            WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 512),
            step(doc_id, piece_no, s, e) AS (
              SELECT doc_id, -1, 0, 50 FROM d
              UNION ALL
              SELECT doc_id, piece_no + 1, s2, CASE WHEN n - s2 <= 512 THEN n WHEN par > 1 THEN s2 + 411 + par WHEN sen > 1 THEN s2 + 411 + sen
                  WHEN blank > 1 THEN s2 + 411 + blank WHEN word > 1 THEN s2 + 411 + word ELSE s2 + 512 END FROM (
                SELECT doc_id, piece_no, s2, n, length(regexp_extract(w, '^.*\n\n', 0, 's')) AS par,
                  greatest(length(regexp_extract(w, '^.*[。！？।]', 0, 's')), length(regexp_extract(x, '^(.*[.!?。！？।؟]){_BLANK}', 1, 's'))) AS sen,
                  least(101, length(regexp_extract(x, '^.*{_BLANK}', 0, 's'))) AS blank, least(101, length(regexp_extract(x, '^.*[^\\p{{L}}\\p{{N}}]', 0, 's'))) AS word FROM (
                    SELECT *, substr(text, s2 + 412, 101) AS w, substr(text, s2 + 412, 102) AS x FROM (
                      SELECT t.doc_id, t.piece_no, t.e - 50 AS s2, d.text, d.n FROM step t JOIN d USING (doc_id) WHERE t.e < d.n))))
            SELECT doc_id, piece_no::BIGINT AS piece_no, s::BIGINT AS start_idx, e::BIGINT AS end_idx FROM step WHERE piece_no >= 0""",
        "p4_found": f"""
            WITH ws AS (SELECT {_WS} AS w),
            d AS (SELECT ext_id, arg_min(text, (received_at, doc_id)) AS t FROM documents WHERE ext_id IS NOT NULL AND text IS NOT NULL GROUP BY ext_id),
            c AS (SELECT DISTINCT chunk_id, doc_id, text, start_idx AS s, end_idx AS e FROM chunks),
            o AS (SELECT c.*, t, length(t) AS n, lag(e) OVER w1 AS before, row_number() OVER w1 AS rn, lead(chunk_id) OVER w1 AS following
              FROM c JOIN d ON c.doc_id = d.ext_id WINDOW w1 AS (PARTITION BY doc_id ORDER BY s, e, chunk_id))
            SELECT chunk_id FROM o, ws WHERE e - s > 512 OR s < 0 OR e > n OR e < s OR trim(substr(t, s + 1, e - s), w) <> text
              OR (rn = 1 AND s <> 0) OR (rn > 1 AND s <> before - 50) OR (following IS NULL AND e <> n)
              OR (following IS NOT NULL AND regexp_matches(substr(t, e, 1), {_WORD}) AND regexp_matches(substr(t, e + 1, 1), {_WORD})
                AND regexp_matches(substr(t, greatest(e - 99, 1), least(e, 100)), {_MARKS}))""",
    }
