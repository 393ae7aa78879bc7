"""Strength of the Markov flow: the same whatever else is in the matrix, and in either form."""

import numpy as np
import pytest

from shardlight.llm import markov


def cliques():
    """A pair, a star of unequal weights, a clique with one strong centre and a long path: they settle in different rounds."""
    parts = [[(0, 1, 0.9)], [(0, i, 0.86 + i / 100) for i in range(1, 9)], [(i, j, 0.97 if i == 3 or j == 3 else 0.9) for i in range(7) for j in range(i)], [(i, i + 1, 0.9 + 0.01 * (i % 3)) for i in range(12)]]
    return [(1 + max(max(a, b) for a, b, _ in p), p) for p in parts]


def flow(n, edges):
    a, b, w = (np.array(c) for c in zip(*edges, strict=True))
    return markov.markov_flow(n, a, b, w, markov.FlowOptions())[1]


def together():
    edges, at = [], 0
    for n, p in cliques():
        edges += [(a + at, b + at, w) for a, b, w in p]
        at += n
    return at, edges


def test_strength_does_not_depend_on_other_blocks():
    n, edges = together()
    s = flow(n, edges)
    assert np.isclose(s.sum(), n * (markov.FlowOptions().rounds + 1))
    assert np.allclose(s, np.concatenate([flow(m, p) for m, p in cliques()]), rtol=1e-3, atol=1e-3)


def test_strength_of_distributed_flow(spark):
    n, edges = together()
    links = spark.createDataFrame([(a, b, round(w * 1e6)) for a, b, w in edges], "a long, b long, cos6 long")
    got = {r["id"]: r["strength"] for r in markov.distributed_flow(links, markov.FlowOptions()).collect()}
    assert sum(got.values()) == pytest.approx(n * (markov.FlowOptions().rounds + 1))
    assert np.allclose([got.get(i, 0) for i in range(n)], flow(n, edges), rtol=0.02, atol=0.05)


def plain_pruned(i, j, w, opts):
    """Column by column: the first ``kept``, of these the ones of at least ``least`` of the column and the first, scaled."""
    out = []
    for c in sorted(set(j.tolist())):
        own = sorted(((-w[e], i[e]) for e in np.flatnonzero(j == c)), key=lambda e: e)
        total = -sum(v for v, _ in own)
        own = [(r, -v) for rank, (v, r) in enumerate(own) if rank == 0 or rank < opts.kept and -v / total >= opts.least]
        out += [(r, c, v / sum(x for _, x in own)) for r, v in own]
    return out


def test_pruning_sorts_only_entries_that_can_stay(monkeypatch):
    opts = markov.FlowOptions()
    rng = np.random.default_rng(2)
    n = 400
    i, j = np.divmod(rng.permutation(n * n)[: n * n // 2], n)
    w = rng.integers(1, 9, len(i)) / 8 * np.where(rng.random(len(i)) < 0.05, 1.0, 1e-3)
    w[j < 40] = rng.integers(1, 3, (j < 40).sum())  # columns in which no entry is large, and with ties
    held, plain = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: held.append(len(keys[0])) or plain(keys))
    got = markov._pruned(i, j, w, n, opts)
    want = plain_pruned(i, j, w, opts)
    assert [(int(a), int(b)) for a, b in zip(*got[:2], strict=True)] == [(int(a), b) for a, b, _ in want]
    assert np.allclose(got[2], [v for *_, v in want])
    assert sum(held) < len(i) / 4


def test_entries_of_a_place_are_added_up():
    rng = np.random.default_rng(3)
    for n in (50, 2_000_000_000):  # beyond the second no place and position fit into a number
        i, j, w = rng.integers(0, 40, 5000), n - 1 - rng.integers(0, 40, 5000), rng.random(5000)
        got = markov._summed(i, j, w, n)
        want = {}
        for a, b, v in zip(i.tolist(), j.tolist(), w.tolist(), strict=True):
            want[b, a] = want.get((b, a), 0) + v
        assert list(zip(got[1].tolist(), got[0].tolist(), strict=True)) == sorted(want)
        assert np.allclose(got[2], [want[p] for p in sorted(want)])
