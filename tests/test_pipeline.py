"""Change feed, orphan references, heavy keys: small fixtures, dirty input, empty tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shardlight.folder import Folder
from shardlight.operators import changefeed, hotkeys, orphans
from shardlight.operators.components import connected_components
from shardlight.operators.hotkeys import KeyField
from shardlight.operators.skew import heavy_keys, salted_left_join

FEED = "entry_id long, tx_id string, operation string, doc_id string, status string, arrived_at timestamp_ntz, extra string"
T0 = dt.datetime(2025, 1, 1)


def feed(spark, rows):
    return spark.createDataFrame([(*r, T0 + dt.timedelta(minutes=i), "x") for i, r in enumerate(rows)], FEED)


ROWS = [
    (1, "a", "Insert ", "d1", "pending"), (2, "a", "unknown", "", "committed"),
    (3, "b", "insert", " d2 ", None), (4, "c", "delete", "d2", "COMMITTED "),
    (5, "d", "update", "d3", "pending"), (6, "d", "update", "d3", "failed"),
    (8, "e", "insert", "d1", " committed"), (7, "f", "delete", "d1", "committed"),
    (9, "g", None, "d9", "committed"), (10, None, "insert", "d10", None), (None, "z", "insert", "d0", None),
    (11, "h", "insert", None, "committed"), (2, "a", "unknown", "", "committed"), (12, "i", "delete", "d4", "committed"),
    (13, "j", "update", "d5", "committed"), (14, "j", "delete", "d5", "committed"),
]
WANT = {("d1", 8), ("d10", 10), ("d5", 13)}


def current(store):
    return {(r["doc_id"], r["seq"]) for r in store.current().collect()}


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_changefeed_any_order(spark, batches):
    rows = ROWS * 2
    random.Random(batches).shuffle(rows)
    store = changefeed.replay(feed(spark, rows), batches=batches)
    assert current(store) == WANT
    store.compact()
    assert len(store.runs()) == 1 and current(store) == WANT
    store.append(feed(spark, [(20, "late", "delete", "d10", "committed")]))
    assert current(store) == WANT - {("d10", 10)}


def test_changefeed_empty(spark):
    assert current(changefeed.replay(feed(spark, []))) == set()
    assert current(changefeed.RunStore(spark)) == set()


def _plain(rows):
    """Documents alive by a plain restatement: first copy of an entry, first commit of a transaction, last effect of a document."""
    first = {}
    for r in sorted(rows, key=lambda r: (r[5], r[1] or f"legacy-{r[0]}", r[2] or "", r[3] or "", r[4])):
        first.setdefault(r[0], r)
    txs = {}
    for e in sorted(first):
        txs.setdefault(first[e][1] or f"legacy-{e}", []).append(first[e])
    last = {}
    for entries in txs.values():
        done = [e for e in entries if e[4] == "committed"]
        if done:
            op = done[0][2] or next((e[2] for e in entries if e[2]), None)
            doc = done[0][3] or next((e[3] for e in entries if e[3]), None)
            if op and doc:
                last.setdefault(doc, []).append((done[0][0], op))
    return {(d, max(v)[0]) for d, v in last.items() if max(v)[1] != "delete"}


@pytest.mark.parametrize("seed", [1, 2])
def test_changefeed_does_not_depend_on_batches(spark, seed):
    """Copies of an entry that disagree, cut into batches in any way, with compactions in between."""
    rng = random.Random(seed)
    rows = []
    for i in range(240):
        e = rng.randrange(60)
        rows.append((e, f"t{rng.randrange(25)}", rng.choice(["insert", "update", "delete", None]), rng.choice(["a", "b", "c", "d", None]),
                     rng.choice(["pending", "committed", "failed"]), T0 + dt.timedelta(minutes=rng.randrange(200) * 2 + i % 2), "x"))
    rows = list({(r[0], r[5]): r for r in rows}.values())
    want = _plain(rows)
    for parts in (1, 4):
        rng.shuffle(rows)
        store = changefeed.RunStore(spark)
        for p in range(parts):
            store.append(spark.createDataFrame(rows[p::parts], FEED))
            if p == 2:
                store.compact()
        assert current(store) == want
    sliced = changefeed.RunStore(spark)
    df = spark.createDataFrame(rows, FEED)
    sliced.append_slices(df, *changefeed.arrival_slice(df, 5))
    assert len(sliced.runs()) == 5 and current(sliced) == want


def test_changefeed_settles_into_documents(spark):
    rows = [(1, "a", "insert", "d1", "committed"), (2, "b", "insert", "d2", "committed"), (3, "c", "delete", "d1", "committed"), (4, "d", "insert", "d3", "pending"),
            (5, "e", None, "d4", "committed"), (6, "f", "delete", "d4", "committed")]
    store = changefeed.RunStore(spark)
    store.append(feed(spark, rows))
    store.compact(settled_before=7)
    assert current(store) == {("d2", 2)}
    base = spark.read.parquet(f"{store.path}/{store.manifest()['base']}")
    assert {(r["doc_id"], r["operation"]) for r in base.collect()} == {("d2", "insert"), ("d4", "delete")}
    assert {r["tx_id"] for r in store.merged().collect()} == {"d", "e"}
    store.append(feed(spark, [(8, "d", None, None, "committed"), (9, "e", "insert", None, "pending"), (10, "g", "delete", "d2", "committed")]))
    assert current(store) == {("d3", 8)}
    store.compact(settled_before=11)
    assert current(store) == {("d3", 8)} and store.merged().count() == 0
    base = spark.read.parquet(f"{store.path}/{store.manifest()['base']}")
    assert {(r["doc_id"], r["operation"]) for r in base.collect()} == {("d3", "insert")}


def test_manifest_keeps_runs_of_other_writers(spark, monkeypatch):
    one = changefeed.RunStore(spark)
    two = changefeed.RunStore(spark, one.path)
    latest, beaten = one.folder.latest, []

    def slow(prefix):
        found = latest(prefix)
        if not beaten:
            beaten.append(1)
            two.append(feed(spark, [(2, "b", "insert", "d2", "committed")]))
        return found

    monkeypatch.setattr(one.folder, "latest", slow)
    one.append(feed(spark, [(1, "a", "insert", "d1", "committed")]))
    assert current(two) == {("d1", 1), ("d2", 2)}


@pytest.mark.parametrize("through_hadoop", [False, True])
def test_folder(spark, tmp_path, through_hadoop):
    f = Folder(spark, f"file://{tmp_path}/f", through_hadoop)
    assert f.names() == [] and f.latest("v") == (0, None)
    assert all(f.publish("v", n, f"text {n} \u00e9") for n in range(1, 7)) and not f.publish("v", 6, "other")
    assert f.latest("v") == (6, "text 6 \u00e9") and len([n for n in f.names() if n.startswith("v-")]) == 4
    assert f.create("LOCK", "me") and not f.create("LOCK", "you") and f.read("LOCK") == "me"
    f.touch("LOCK")
    assert f.age("LOCK") < 60
    f.mkdirs("d/e")
    f.delete("d")
    f.delete("d")
    assert not f.exists("d") and f.exists()


def test_orphans(spark):
    at = lambda d: T0 + dt.timedelta(days=d)
    chunks = spark.createDataFrame([("c1", at(1)), ("c1", at(5)), ("C2 ", at(3)), (None, at(0))], "chunk_id string, created_at timestamp_ntz")
    stones = spark.createDataFrame([(1, "c1", at(10)), (2, "c9", at(2)), (3, None, at(1)), (4, "c2", None)], "tombstone_id long, chunk_id string, deleted_at timestamp_ntz")
    vectors = spark.createDataFrame(
        [(1, " C1", at(2)), (2, "c1", at(10)), (3, "c1", at(0)), (4, "cx", at(1)), (5, "  ", at(1)), (6, "c2", None), (1, " C1", at(2))],
        "vector_idx long, chunk_id string, created_at timestamp_ntz",
    )
    shards = spark.createDataFrame([(7, ["c2", None, "c2 ", "cy"], at(2)), (8, None, at(2)), (9, [], at(2))], "info_id long, chunk_ids array<string>, last_updated timestamp_ntz")
    found = orphans.orphan_references(orphans.references(vectors, shards, stones).distinct(), orphans.parents(chunks, stones))
    got = {(r["ref_table"], r["ref_id"], r["chunk_id"], r["reason"]) for r in found.collect()}
    assert got == {
        ("vector_entries", 2, "c1", "deleted"), ("vector_entries", 3, "c1", "late"), ("vector_entries", 4, "cx", "missing"),
        ("shard_info", 7, "c2", "late"), ("shard_info", 7, "cy", "missing"), ("tombstones", 2, "c9", "missing"),
    }
    empty = orphans.orphan_references(orphans.references(vectors.limit(0), shards.limit(0), stones.limit(0)), orphans.parents(chunks.limit(0), stones.limit(0)))
    assert empty.count() == 0 and orphans.report(empty).count() == 0


def test_hot_keys_and_salting(spark):
    rows = [(i, "hot" if i % 3 else f"k{i}", f"c{i % 7}", T0 + dt.timedelta(seconds=i)) for i in range(300)] + [(5, "hot", "c5", T0), (400, None, None, T0)]
    df = spark.createDataFrame(rows, "id long, doc string, chunk string, at timestamp_ntz")
    fields = [KeyField("t.doc", "doc", 0.1)]
    once = hotkeys.once(df, "id", "at", ["doc", "chunk"])
    assert [(r["key_value"], r["rows"], r["total"]) for r in hotkeys.heavy(hotkeys.key_counts(hotkeys.by_field(once, fields)), fields).collect()] == [("hot", 200, 301)]
    full = df.dropDuplicates(["id"])
    results = {r["key_value"]: r for r in hotkeys.key_results(hotkeys.by_field(full, fields, "chunk", "at"), "chunk", "at").collect()}
    assert results["hot"]["rows"] == 200 and results["hot"]["distinct_chunks"] == 7 and len(results) == 101
    assert heavy_keys(df, "doc", 0.1) == ["hot"] and heavy_keys(df.limit(0), "doc", 0.1) == []
    small = spark.createDataFrame([("hot", 1), ("k3", 2)], "doc string, v int")
    joined = salted_left_join(df, small, "doc", F.col("id"), share=0.1, salts=8, least_rows=0)
    assert joined.count() == df.count() and joined.where("v = 1").count() == 201 and joined.where("v = 2").count() == 1


@pytest.mark.parametrize("local_edges", [0, 40, 1_000_000])
def test_components(spark, local_edges):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100)] + [(200, 200 + i) for i in range(1, 30)] + [(None, 3)]
    rng.shuffle(edges)
    edges = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in edges]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges * 2, "a long, b long"), local_edges=local_edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, **dict.fromkeys([200, *range(201, 230)], 200)}
    words = spark.createDataFrame([("b", "c"), ("x", "x"), ("c", "a"), (None, "q")], "a string, b string")
    assert {(r["node"], r["component"]) for r in connected_components(words, local_edges=local_edges).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x")}
    assert connected_components(words.limit(0), local_edges=local_edges).count() == 0
