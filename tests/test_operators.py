"""Operators of the engine against plain restatements, with edge cases."""

import hashlib
import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shardlight.config import check_top_k
from shardlight.functions import scalars as S
from shardlight.functions.embedding import HashedProvider, embed, provider
from shardlight.functions.metadata import metadata_filter
from shardlight.operators import chunker, index, search, stats, txlog


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize("s", ["", "a", "doc-1", "日本語", "ß" * 1000])
def test_stable_hash(spark, s):
    want = int.from_bytes(hashlib.sha256(s.encode()).digest()[:8], "big")
    assert int(one(spark, s, "string", S.stable_hash)) == want
    assert one(spark, s, "string", lambda c: S.shard_of(c, 4)) == want % 4


def test_half_precision(spark):
    values = [0.0, -0.0, 1.0, 1.0004883, 65504.0, 65519.0, 65520.0, 1e-8, 6.1e-5, -3.14159, 2.98e-8, float("inf")]
    got = one(spark, values, "array<float>", S.half_precision)
    with np.errstate(over="ignore"):
        assert np.array_equal(np.array(got, np.float32), np.array(values, np.float32).astype(np.float16).astype(np.float32))


def test_cosine_and_strip(spark):
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0], "　 a b\n ")], "a array<float>, b array<float>, z array<float>, s string").select(
        S.cosine(F.col("a"), F.col("b")), S.cosine(F.col("a"), F.col("z")), S.strip(F.col("s")), S.normalised(F.col("z"))
    ).first()
    assert math.isclose(row[0], 0.5**0.5) and row[1] == 0.0 and row[2] == "a b" and row[3] == [0.0, 0.0]


FILTERS = [
    ({"a": 1}, ['{"a": 1}', '{"a": 1.0}', '{"a": true}'], ['{"a": "1"}', '{"a": 2}', "{}", None, "[1]", "broken{"]),
    ({"a": "1"}, ['{"a": "1"}'], ['{"a": 1}', '{"a": null}']),
    ({"a": None}, ['{"a": null}', "{}", None, "broken{"], ['{"a": 0}', '{"a": ""}']),
    ({"a.b": "x"}, ['{"a.b": "x"}'], ['{"a": {"b": "x"}}']),
    ({"a": {"y": 1, "x": [1, 2]}}, ['{"a": {"x": [1, 2], "y": 1}}'], ['{"a": {"x": [2, 1], "y": 1}}', '{"a": "z"}']),
    ({"it's": False}, ['{"it\'s": false}', '{"it\'s": 0}'], ['{"it\'s": true}']),
    ({"a": 1, "b": "x"}, ['{"a": 1, "b": "x", "c": 2}'], ['{"a": 1}', '{"b": "x"}']),
]


@pytest.mark.parametrize("wanted,yes,no", FILTERS)
def test_metadata_filter(spark, wanted, yes, no):
    rows = [(m, True) for m in yes] + [(m, False) for m in no]
    df = spark.createDataFrame(rows, "m string, want boolean")
    bad = df.where(metadata_filter(F.col("m"), wanted) != F.col("want")).collect()
    assert not bad
    assert df.where(metadata_filter(F.col("m"), None)).count() == len(rows)


def plain_windows(text, size=512, overlap=50):
    """The window rules stated directly."""
    out, start, last = [], 0, None
    if not text.strip():
        return out
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            spaces = [p for p in range(start + 1, min(end + 50, len(text))) if text[p] == " "]
            end = spaces[-1] if spaces else end
        if text[start:end].strip():
            out.append((start, end, text[start:end].strip()))
            last = start
        step = end - overlap
        start = step if step > (last if last is not None else 0) and step > start else end
    return out


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n　é", max_size=400), st.integers(20, 80), st.integers(1, 19))
def test_windows(text, size, overlap):
    assert chunker.windows(text, size, overlap) == plain_windows(text, size, overlap)


@pytest.mark.parametrize("text", ["", "   ", None, "a" * 512, "a" * 513, "a " * 600, "a" + " " * 80, "x" * 5000, "é　" * 700, "word " * 30_000])
def test_window_edges(text):
    got = chunker.windows(text)
    assert got == plain_windows(text or "")
    assert all(b - a <= 512 + 49 for a, b, _ in got)


def test_tail_chunk_and_table(spark):
    assert [(a, b) for a, b, _ in chunker.windows("a" * 100)] == [(0, 100), (50, 100)]
    df = spark.createDataFrame([(1, "a" * 100, "x"), (2, None, "y"), (3, " ", "z")], "doc_id long, text string, chunk_no string")
    assert [(r["doc_id"], r["chunk_no"], r["start_idx"]) for r in chunker.chunk(df, "doc_id", "text").collect()] == [(1, 0, 0), (1, 1, 50)]
    assert chunker.chunk(df.limit(0), "doc_id", "text").count() == 0


def plain_embedding(text, dim):
    v = [0.0] * dim
    slot = lambda s: int.from_bytes(hashlib.sha256(s.encode()).digest()[:8], "big") % dim
    low = text.lower()
    for i, w in enumerate(low.split()):
        v[slot(w)] += 1 / (1 + 0.1 * i)
    for n, weight in ((2, 0.3), (3, 0.2)):
        for i in range(len(low) - n + 1):
            v[slot(low[i : i + n])] += weight
    norm = math.sqrt(sum(x * x for x in v))
    return [x / norm if norm else 0.0 for x in v]


def test_embedding(spark):
    texts = ["", "a", "The nightly  rebuild\nfailed", "日本語 テキスト", "İstanbul", "x" * 3000]
    got = HashedProvider(64, remembered=5)(texts)
    assert np.allclose(got, [plain_embedding(t, 64) for t in texts], atol=1e-12)
    df = embed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, None)], "i int, t string"), "t", HashedProvider(64))
    rows = {r["i"]: r["vector"] for r in df.collect()}
    assert np.allclose(rows[2], got[2], atol=1e-6) and not any(rows[9])
    assert embed(spark.createDataFrame([], "i int, t string"), "t", HashedProvider(8)).count() == 0
    with pytest.raises(ValueError):
        provider("nope", 8)


def test_search_and_index(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[7] = 0
    x[11] = x[12]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>").repartition(5)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    for q in (0, 7, 11):
        want = sorted(range(300), key=lambda i: (-round(float(unit[i].astype(float) @ unit[q].astype(float)), 6), i))[:10]
        got = [r["id"] for r in search.top_k(df, "id", "v", x[q].tolist(), 10).collect()]
        assert got == want or q == 12
    batch = search.top_k_batch(df, df.where("id < 20").selectExpr("id AS query_id", "v"), "id", "v", 5, query_block=7, row_block=64)
    exact = {q: [r["id"] for r in search.top_k(df, "id", "v", x[q].tolist(), 5).collect()] for q in (0, 5, 11)}
    rows = {}
    for r in batch.orderBy("query_id", "rank").collect():
        rows.setdefault(r["query_id"], []).append(r["id"])
    assert len(rows) == 20 and all(rows[q] == exact[q] for q in exact)
    built = index.build_centroid_index(df, "id", "v", 100)
    assert built.stats().first().asDict() == {"index_type": "centroid", "num_buckets": 17, "indexed": 300, "non_empty_buckets": built.sizes().where("size > 0").count()}
    assert built.candidates(x[0].tolist(), 17).count() == 300
    none = index.build_centroid_index(df.limit(0), "id", "v")
    assert none.assignments.count() == 0
    single = index.build_centroid_index(df.where("id = 3"), "id", "v")
    assert single.assignments.collect()[0]["bucket_id"] == 0
    probes = df.select(index.hash_probes(F.lit(99), 100).alias("p")).first()["p"]
    assert probes == [0, 1, 97, 98, 99]
    for n in (1, 2, 3, 231, 245, 500, 981):
        k = index.bucket_count(n, 100)
        assert index.seed_positions(n, k) == np.linspace(0, n - 1, k, dtype=int).tolist()
    with pytest.raises(ValueError):
        check_top_k(0)


def test_latency(spark):
    for values in ([5.0], [1.0, 2.0], [float(i % 97) for i in range(1000)], [2.0] * 50):
        s = sorted(values)
        r = stats.latency(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double"), "v").first()
        n = len(s)
        assert (r["samples"], r["p50"], r["p95"], r["p99"], r["min"], r["max"]) == (n, s[int(n * 0.5)], s[int(n * 0.95)], s[int(n * 0.99)], s[0], s[-1])
    assert stats.latency(spark.createDataFrame([], "v double"), "v").first()["samples"] == 0


def test_log_checksums(spark):
    rows = [(1, "t1", "insert", "é", "committed", "{}"), (2, "t2", "delete", None, "failed", None)]
    log = txlog.with_checksum(spark.createDataFrame(rows, "entry_id long, tx_id string, operation string, doc_id string, status string, details string"))
    assert txlog.verify(log).first().asDict() == {"total_entries": 2, "valid": 2, "invalid": 0}
    broken = log.withColumn("doc_id", F.when(F.col("entry_id") == 2, "x").otherwise(F.col("doc_id")))
    assert [r["entry_id"] for r in txlog.invalid_entries(broken).collect()] == [2]
    assert json.loads('{"a": 1}') == {"a": 1}
