"""Permutation index and Markov clustering against brute force, with dirty vectors, copies and hot groups."""

import numpy as np
import pytest

from shardlight.llm import markov
from shardlight.llm import permutation_index as pix
from shardlight.llm.vectors import decode, unit_rows, usable, without_conflicts

SCHEMA = "vector_idx long, vector array<float>, arrived_at timestamp_ntz, a string, code string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, None, "x", "y") for i, v in rows], SCHEMA).repartition(4)


def world(seed=1, dim=64):
    """Clusters of many widths, noise, exact and scaled copies, a hot tight group, dirty rows."""
    rng = np.random.default_rng(seed)
    rows, n = [], 1
    for size, spread in [(2, 0.05), (3, 0.1), (5, 0.06), (8, 0.2), (40, 0.04), (30, 0.3), (200, 0.05)]:
        centre = rng.normal(size=dim)
        for _ in range(size):
            rows.append((n, centre + spread * rng.normal(size=dim)))
            n += 1
    for _ in range(150):
        rows.append((n, rng.normal(size=dim)))
        n += 1
    copied = rng.normal(size=dim)
    for i in range(30):
        rows.append((n, copied * (1 if i % 3 else 2)))
        n += 1
    rows = [(i, v.astype(np.float16).astype(np.float32).tolist()) for i, v in rows]
    rng.shuffle(rows)
    rows = [(int(i), [float(x) for x in v]) for i, v in rows]
    dirty = [(9001, None), (9002, [1.0] * 63), (9003, [0.0] * 64), (9004, [float("nan")] * 64), (9005, [float("inf")] + [1.0] * 63), (9006, [None] + [1.0] * 63), (None, [1.0] * 64), (9007, [])]
    return rows + rows[:40] + dirty


def truth(rows, threshold=0.85, k=10):
    got = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            got.setdefault(i, v)
    ids = np.array(sorted(got))
    x = np.array([got[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -2)
    first = {int(i): [int(ids[j]) for j in np.lexsort((ids, -s[r]))[:k]] for r, i in enumerate(ids)}
    linked = s >= threshold
    pairs = {(int(a), int(b)) for ra, a in enumerate(ids) for rb, b in enumerate(ids) if a < b and linked[ra, rb] and int(b) in first[int(a)] and int(a) in first[int(b)]}
    label = np.arange(len(ids))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(ids)).min(1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    size = np.bincount(label, minlength=len(ids))
    sets = {(int(i), int(ids[label[r]])) for r, i in enumerate(ids) if size[label[r]] >= 3}
    return pairs, sets, first


def test_codes(spark):
    rows = [(1, [0.5] * 64), (2, [0.1] * 64), (3, [1e-9] * 63 + [70000.0])]
    got = {r[0]: bytes(r[1]) for r in usable(table(spark, rows)).collect()}
    assert (len(got[1]), len(got[2])) == (129, 257)
    assert np.array_equal(decode([got[i] for i in (1, 2, 3)], 64), np.array([v for _, v in rows], np.float32).astype(float))
    assert np.allclose(np.linalg.norm(unit_rows(np.array([[1e-200] * 4, [1e200] * 4])), axis=1), 1)


def test_conflicting_rows(spark):
    df = spark.sql("SELECT 1L AS vector_idx, array(1f, 2f) AS vector, TIMESTAMP_NTZ'2025-01-02' AS arrived_at UNION ALL SELECT 1L, array(3f, 4f), TIMESTAMP_NTZ'2025-01-01' UNION ALL SELECT 2L, array(1f), NULL")
    assert sorted((r[0], r[1]) for r in without_conflicts(df).select("vector_idx", "vector").collect()) == [(1, [3.0, 4.0]), (2, [1.0])]


@pytest.mark.parametrize("block_rows", [16384, 60])
def test_mutual_neighbours(spark, block_rows):
    rows = world()
    pairs, _, _ = truth(rows)
    reps, copied, n = pix.prepare(table(spark, rows), keep=11)
    opts = pix.IndexOptions(pivots=12, block_rows=block_rows)
    links = pix.neighbour_links(reps, 0.85, 10, opts, n)
    got = {(r[0], r[1]) for r in pix.mutual(pix.expand_neighbours(links, copied, 10)).collect()}
    assert len(got & pairs) / len(pairs) >= 0.97 and len(got & pairs) / len(got) >= 0.97


def test_top_k_recall(spark):
    rows = world(7)
    _, _, first = truth(rows)
    codes = usable(table(spark, rows))
    hits = pix.top_k(codes, codes.where("vector_idx % 10 = 0"), opts=pix.SearchOptions(pivots=64, group_rows=150, share=0.3)).collect()
    found = {}
    for r in hits:
        found.setdefault(r["query_id"], set()).add(r["neighbour"])
    asked = [i for i in first if i % 10 == 0]
    assert set(found) == set(asked)
    assert sum(len(found[i] & set(first[i])) for i in asked) / (10 * len(asked)) >= 0.9
    assert pix.top_k(codes.limit(0), codes.limit(0)).count() == 0


@pytest.mark.parametrize("block_rows", [200_000, 100])
def test_clusters(spark, block_rows):
    rows = world(3)
    _, sets, _ = truth(rows)
    c = markov.markov_clusters(table(spark, rows), index=pix.IndexOptions(pivots=12), flow=markov.FlowOptions(block_rows=block_rows))
    got = {(r["vector_idx"], r["grp"]) for r in c.with_copies(c.members, "grp", 3).collect()}
    assert len(got & sets) / len(sets) >= 0.97 and len(got & sets) / len(got) >= 0.97
    described = markov.describe(c).collect()
    members = {r["id"]: r["cluster"] for r in c.members.collect()}
    assert all(1 <= len(d["typical"]) <= 3 for d in described)
    assert all(members.get(t, d["cluster"]) == d["cluster"] for d in described for t in d["typical"])
    assert 30 in {d["size"] for d in described}  # the copies


def test_flow_splits_weak_links():
    """Two cliques joined by one weak link are two clusters."""
    a = [(i, j) for i in range(5) for j in range(i)] + [(5 + i, 5 + j) for i in range(5) for j in range(i)] + [(0, 5)]
    w = np.array([1.0] * 20 + [0.1])
    attractor, strength = markov.markov_flow(10, np.array([x for x, _ in a]), np.array([y for _, y in a]), w, markov.FlowOptions())
    assert len({int(x) < 5 for x in attractor[:5]}) == 1 and len({int(x) < 5 for x in attractor[5:]}) == 1
    assert (attractor[:5] < 5).all() and (attractor[5:] >= 5).all() and (strength > 0).any()


def test_empty(spark):
    none = table(spark, [(1, None)])
    reps, copied, n = pix.prepare(none, keep=11)
    assert pix.mutual(pix.expand_neighbours(pix.neighbour_links(reps, rows=n), copied, 10)).count() == 0
    c = markov.markov_clusters(none)
    assert c.with_copies(c.members, "grp", 3).count() == 0 and markov.describe(c).count() == 0
