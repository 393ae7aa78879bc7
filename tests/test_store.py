"""The store's life cycle, exchange formats, streams."""

import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardlight.config import Conflict, EngineOptions, NotFound, TooLarge
from shardlight.folder import Folder
from shardlight.functions.scalars import shard_of
from shardlight.operators import changefeed
from shardlight.sources import formats
from shardlight.sources.store import CHUNKS, Engine, WriterLock
from shardlight.streaming import ingest as streams

DOCS = [
    ("d1", "The nightly rebuild failed because the tombstone file was locked. " * 12, json.dumps({"category": "ops", "priority": 1})),
    ("d2", "Cooking pasta needs water, salt and patience.", json.dumps({"category": "food"})),
    ("d3", "Vector search ranks chunks by cosine similarity.", json.dumps({"category": "tech", "priority": 1.0})),
]


@pytest.fixture()
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), EngineOptions(dimension=64, max_text_size=2000, lock_timeout_seconds=1))
    e.ingest(spark.createDataFrame(DOCS, "doc_id string, text string, metadata string"))
    return e


def test_life_cycle(spark, engine):
    assert {r["doc_id"] for r in engine.chunks().collect()} == {"d1", "d2", "d3"}
    hits = engine.search("pasta and salt", 2).collect()
    assert hits[0]["doc_id"] == "d2" and hits[0]["score"] > hits[1]["score"]
    engine.rebuild_index()
    assert engine.search("pasta and salt", 1).first()["doc_id"] == "d2"
    assert {r["doc_id"] for r in engine.search("anything", 10, {"priority": 1}).collect()} == {"d1", "d3"}
    with pytest.raises(Conflict):
        engine.ingest_one("d2", "again")
    with pytest.raises(TooLarge):
        engine.ingest_one("big", "x" * 2001)
    with pytest.raises(NotFound):
        engine.delete("nope")
    assert engine.delete("d2") == 1
    assert "d2" not in {r["doc_id"] for r in engine.search("pasta and salt", 10).collect()}
    with pytest.raises(NotFound):
        engine.delete("d2")
    assert engine.restore("d2") == 1 and engine.document_exists("d2")
    with pytest.raises(TooLarge):
        engine.update("d2", "x" * 2001)
    assert engine.document_exists("d2")
    assert engine.update("d2", "Bread needs flour.") == 1
    assert [r["text"] for r in engine.chunks().where("doc_id = 'd2'").collect()] == ["Bread needs flour."]
    assert engine.verify_log().first()["invalid"] == 0
    before = engine.all_chunks().count()
    assert engine.vacuum(days=0) == 1
    assert engine.all_chunks().count() == before - 1 and engine.tombstones().count() == 0
    assert engine.stats().first()["documents"] == 3 and engine.health().first()["status"] == "healthy"
    with pytest.raises(ValueError):
        engine.clear()
    engine.clear(confirm=True)
    assert engine.chunks().count() == 0 and engine.log().count() == 0 and engine.search("pasta", 3).count() == 0


def test_batches(spark, engine):
    rows = [("d1", "taken", "{}"), (" d4 ", "fine text", None), ("d5", "   ", "{}"), ("", "no id", "{}"), ("d6", "y" * 2001, "{}")]
    got = {r["doc_id"]: (r["status"], r["error"]) for r in engine.ingest(spark.createDataFrame(rows, "doc_id string, text string, metadata string")).collect()}
    assert got["d4"] == ("success", None) and {k for k, v in got.items() if v[0] == "failed"} == {"d1", "d5", "", "d6"}
    with pytest.raises(Conflict):
        engine.ingest(spark.createDataFrame([("q", "a", "{}"), ("q ", "b", "{}")], "doc_id string, text string, metadata string"))
    with pytest.raises(TooLarge):
        engine.ingest(spark.createDataFrame([(str(i), "a", "{}") for i in range(101)], "doc_id string, text string, metadata string"))


def test_interrupted_write_is_invisible(spark, engine):
    def write(tx):
        engine._delete_in("d1", tx, "crash")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        engine._transaction("delete", "d1", write)
    engine._append_log("open-tx", "insert", "d9", "pending", {})
    assert engine.document_exists("d1")
    report = engine.recover().first()
    assert report["pending"] == 1 and report["failed"] == 1


def test_shard_validation(spark, engine):
    engine.save_manifest()
    assert {r["state"] for r in engine.validate_shards().collect()} == {"ok"}
    folder = f"{engine.generation}/chunks"
    files = [os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")]
    os.unlink(files[0])
    with open(files[1], "ab") as f:
        f.write(b"x")
    states = sorted(r["state"] for r in engine.validate_shards().collect())
    assert "missing" in states and "checksum_mismatch" in states


def test_lock(spark, tmp_path):
    folder, path = Folder(spark, str(tmp_path)), str(tmp_path / "LOCK")
    with WriterLock(folder, 5) as held:
        assert held.owned()
        with pytest.raises(TimeoutError):
            WriterLock(folder, 0.2).__enter__() if os.utime(path, (time.time() + 60, time.time() + 60)) is None else None
    assert not os.path.exists(path)
    with open(path, "w") as f:
        f.write("dead")
    os.utime(path, (1, 1))
    with WriterLock(folder, 1) as taken:
        assert taken.owned()


def test_a_working_writer_keeps_its_lock(spark, tmp_path):
    folder = Folder(spark, str(tmp_path))
    with WriterLock(folder, 0.6) as held:
        with pytest.raises(TimeoutError):
            WriterLock(folder, 0.6).__enter__()
        time.sleep(1.5)
        assert held.owned() and folder.age("LOCK") < 0.6


def test_nothing_is_committed_without_the_lock(spark, engine):
    def write(tx):
        engine.folder.delete("LOCK")
        engine._delete_in("d1", tx, "late")
        return {}

    with engine._lock(), pytest.raises(TimeoutError):
        engine._transaction("delete", "d1", write)
    assert engine.document_exists("d1")


@pytest.mark.parametrize("index_type", ["centroid", "bucket"])
def test_search_sees_what_the_index_does_not_hold(spark, tmp_path, index_type, monkeypatch):
    e = Engine(spark, str(tmp_path / "s"), EngineOptions(dimension=64, index_type=index_type, half_precision=False))
    shape = "doc_id string, text string, metadata string"
    e.ingest(spark.createDataFrame([(f"d{i}", f"sentence number {i} about shard {i % 7} and its merge", "{}") for i in range(40)], shape))
    e.rebuild_index()
    e.ingest(spark.createDataFrame([("new", "zebra quagga okapi", "{}")], shape))
    assert e.search("zebra quagga okapi", 3).first()["doc_id"] == "new"
    assert e.spark.read.parquet(f"{e._index_folder()}/vectors").where("chunk_id LIKE 'new#%'").count() == 1
    monkeypatch.setattr(e, "_index_new", lambda tx: None)  # a writer that dies after its commit
    e.ingest(spark.createDataFrame([("lost", "gnu eland kudu", "{}")], shape))
    assert e.search("gnu eland kudu", 3).first()["doc_id"] == "lost"
    monkeypatch.undo()
    e.update("d3", "heron stork crane")
    best = e.search("heron stork crane", 40).collect()
    assert best[0]["chunk_id"] == "d3#2#0" and "d3#1#0" not in {r["chunk_id"] for r in best}
    e.delete("new")
    assert "new" not in {r["doc_id"] for r in e.search("zebra quagga okapi", 40).collect()}
    before = {r["chunk_id"] for r in e.search("gnu eland kudu", 40).collect()}
    e.clear_log()
    assert e.log().count() == 1 and e.search("gnu eland kudu", 3).first()["doc_id"] == "lost"
    assert e._index_folder() and before <= {r["chunk_id"] for r in e.chunks().collect()}
    e.clear_index()
    assert e._index_folder() is None and e.search("gnu eland kudu", 1).first()["doc_id"] == "lost"


def test_vector_indices_are_unique(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"), EngineOptions(dimension=16))
    assert e.ingest_one("a", "one text") == 1 and e.ingest_one("b", "another text") == 1
    assert len({r["vector_idx"] for r in e.chunks().collect()}) == 2
    assert e.rebuild_index().first()["indexed"] == 2


def test_observability(spark, tmp_path, caplog):
    e = Engine(spark, str(tmp_path / "s"), EngineOptions(dimension=16, record_events=True))
    assert {"pending", "failed", "startup_ms", "memory"} <= set(e.startup) and e.startup["memory"].startswith("RSS: ")
    status = e.ingest(spark.createDataFrame([(r[0], r[1], r[2]) for r in DOCS] + [("", "no id", "{}")], "doc_id string, text string, metadata string"))
    summary = e.batch_summary(status).first()
    assert (summary["documents_processed"], summary["succeeded"], summary["failed"]) == (4, 3, 1) and summary["total_chunks"] == e.chunks().count()
    e.search("pasta and salt", 2)
    events = {r["event"]: json.loads(r["fields"]) for r in e.events().collect()}
    assert events["search"]["candidate_count"] == e.chunks().count() and events["search"]["index_hit_rate"] == 1.0 and events["search"]["search_latency_ms"] > 0
    assert events["ingestion"]["total_chunks"] == summary["total_chunks"]
    system = e.system_stats().first()
    assert system["rss_mb"] > 1 and system["cores"] >= 1
    e.rebuild_index()
    health = e.detailed_health().first()
    assert health["status"] == "healthy" and json.loads(health["index"])["indexed"] == e.chunks().count() and json.loads(health["stats"])["documents"] == 3
    assert e.locks().count() == 0
    with e._lock():
        assert [(r["resource"], r["stale"]) for r in e.locks().collect()] == [("LOCK", False)]
    details = {r["shard_id"]: r for r in e.shard_details().collect()}
    assert len(details) == 4 and sum(r["chunks"] for r in details.values()) == e.chunks().count()
    assert all((r["file_size"] > 0) == (r["chunks"] > 0) for r in details.values())


def test_shards_are_rebuilt(spark, engine):
    rows = engine.all_chunks().where("doc_id = 'd2'").withColumn("shard_id", (F.col("shard_id") + 1) % 4).withColumn("chunk_id", F.lit("stray#1#0"))
    engine._transaction("insert", "", lambda tx: engine._write_chunks(rows.withColumn("write_tx", F.lit(tx)).select(*CHUNKS.names)) or {})
    wrong = engine.all_chunks().where(F.col("shard_id") != shard_of(F.col("doc_id"), 4))
    assert wrong.count() == 1
    assert engine.rebuild_shards().agg(F.sum("chunks")).first()[0] == engine.all_chunks().count()
    assert engine.all_chunks().where(F.col("shard_id") != shard_of(F.col("doc_id"), 4)).count() == 0


def test_migration_and_formats(spark, engine, tmp_path):
    np.save(tmp_path / "v.npy", np.arange(12, dtype=np.float16).reshape(3, 4))
    vectors = formats.read_npy(spark, str(tmp_path / "v.npy"))
    assert sorted((r["vector_idx"], r["vector"][1]) for r in vectors.collect()) == [(0, 1.0), (1, 5.0), (2, 9.0)]
    base = dict.fromkeys(CHUNKS.names)
    rows = [{**base, "chunk_id": f"old{i}", "doc_id": f"o{i}", "text": "t", "vector_idx": i, "shard_id": None if i < 2 else 1} for i in range(4)]
    meta = spark.createDataFrame([tuple(r[n] for n in CHUNKS.names) for r in rows], CHUNKS).drop("vector", "write_tx")
    assert engine.migrate_legacy(meta, vectors)["migrated"] == 2
    assert engine.migrate_legacy(meta, vectors)["migrated"] == 0
    lines = ['{"chunk_id": "a", "doc_id": "1"}', "", "broken", '{"chunk_id": "a", "doc_id": "2"}', '{"chunk_id": "b", "doc_id": "3"}']
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    assert {(r["chunk_id"], r["doc_id"]) for r in formats.read_metadata_jsonl(spark, str(tmp_path / "m.jsonl")).collect()} == {("a", "2"), ("b", "3")}
    (tmp_path / "w.jsonl").write_text('{"entry_id": 1, "document_id": "x", "data": {"k": 1}}\n{oops\n{"entry_id": 2, "tx_id": "t", "operation": "insert", "doc_id": "y", "status": "pending"}')
    log = {r["entry_id"]: r for r in formats.read_log_jsonl(spark, str(tmp_path / "w.jsonl")).collect()}
    assert log[1]["tx_id"] == "legacy-1" and log[1]["status"] == "committed" and log[2]["operation"] == "insert"
    (tmp_path / "t.jsonl").write_text('{"chunk_id": "c", "document_id": "d", "deleted_at": "2025-01-01T00:00:00"}')
    assert formats.read_tombstones_jsonl(spark, str(tmp_path / "t.jsonl")).first()["reason"] == "user_delete"
    formats.write_jsonl(meta.select("chunk_id"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 4


def test_bucket_index_and_batch_search(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"), EngineOptions(dimension=32, index_type="bucket", half_precision=False))
    e.ingest(spark.createDataFrame(DOCS, "doc_id string, text string, metadata string"))
    assert e.rebuild_index().first()["index_type"] == "bucket"
    assert e.search("Cooking pasta needs water, salt and patience.", 1).first()["doc_id"] == "d2"
    q = spark.createDataFrame([(1, DOCS[1][1]), (2, DOCS[2][1])], "query_id long, text string")
    best = {r["query_id"]: r["chunk_id"] for r in e.search_batch(q, 1).collect()}
    assert best[1].startswith("d2") and best[2].startswith("d3")


def test_streams(spark, engine, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("s1", "streamed text", "{}"), ("s1", "streamed text", "{}")], "doc_id string, text string, metadata string").write.parquet(str(source))
    docs = spark.readStream.schema("doc_id string, text string, metadata string").parquet(str(source))
    streams.ingest_stream(docs, engine, str(tmp_path / "cp")).awaitTermination()
    assert engine.document_exists("s1")
    log = tmp_path / "log"
    rows = [(1, "a", "insert", "x", "committed"), (2, "b", "delete", "y", "committed")]
    feed = spark.createDataFrame(rows, "entry_id long, tx_id string, operation string, doc_id string, status string").withColumn("arrived_at", F.lit("2025-01-01").cast("timestamp_ntz"))
    feed.write.parquet(str(log))
    store = changefeed.RunStore(spark, f"file://{tmp_path}/runs")
    streams.apply_changes(spark.readStream.schema(feed.schema).parquet(str(log)), store, str(tmp_path / "cp2")).awaitTermination()
    assert [(r["doc_id"], r["seq"]) for r in store.current().collect()] == [("x", 1)]
    counted = streams.status_counts(spark.readStream.schema(feed.withColumnRenamed("arrived_at", "logged_at").schema).parquet(str(log)))
    assert counted.isStreaming


def test_stream_of_updates(spark, engine, tmp_path):
    source = tmp_path / "in"
    shape = "doc_id string, text string, metadata string, n int"
    spark.createDataFrame([("d2", "zzz first", "{}", 1), ("d2", "bread needs flour", "{}", 2), ("s1", "streamed text", "{}", 1), ("s2", "   ", "{}", 1)], shape).coalesce(1).write.parquet(str(source))
    docs = spark.readStream.schema(shape).parquet(str(source))
    streams.ingest_stream(docs, engine, str(tmp_path / "cp"), order="n", updates=True).awaitTermination()
    assert [r["text"] for r in engine.chunks().where("doc_id = 'd2'").collect()] == ["bread needs flour"]
    assert engine.document_exists("s1") and not engine.document_exists("s2")
    status = {r["doc_id"]: (r["status"], r["error"]) for r in engine.upsert(spark.createDataFrame([("d1", "", "{}"), ("d3", "new", "{}")], "doc_id string, text string, metadata string")).collect()}
    assert status == {"d1": ("failed", "no chunks"), "d3": ("success", None)} and engine.document_exists("d1")
