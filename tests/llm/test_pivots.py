"""The permutation index: what the footrule decides, the pivot tree, the packed form."""

import numpy as np

from shardlight.llm import permutation_index as pix


def vectors(n, seed=0, groups=40):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 64))
    centres = rng.normal(size=(groups, 64))
    at = rng.integers(0, groups, n // 2)
    x[: n // 2] = centres[at] + 0.35 * rng.normal(size=(n // 2, 64))
    return pix.unit_rows(x.astype("<f2").astype(float))


def test_agreement_is_the_footrule():
    rng = np.random.default_rng(1)
    orders = np.array([rng.permutation(20)[:6] for _ in range(50)], np.int32)
    files = pix.RankFiles(orders, pix.rank_weights(6, 1))
    got = np.array([files.agreement(r, 0) for r in range(50)])
    rank = np.full((50, 20), 6)
    for r, o in enumerate(orders):
        rank[r, o] = np.arange(6)
    for a in range(50):
        for b in range(50):
            footrule = np.abs(rank[a] - rank[b]).sum()
            assert footrule == 6 * 7 - 2 * got[a, b]


def test_footrule_decides_which_pairs_get_a_cosine(monkeypatch):
    x = vectors(12_000)[6000:]  # no tight group: every pair is compared by itself
    orders = pix.nearest_pivots(x.astype(np.float32), x[::60].astype(np.float32), 12)
    file = np.flatnonzero((orders[:, :4] == 7).any(1))
    part = (file, orders[file], x[file])
    compared = []
    plain = pix._pair_cosines
    monkeypatch.setattr(pix, "_pair_cosines", lambda x, rows, cols: compared.append(len(rows) * (x.dtype == np.float32)) or plain(x, rows, cols))
    tested = []
    for bound in (8, 9, 10, 12):
        compared.clear()
        pix._unit_links(part, part, 7, 0.85, 10, 4, bound, pix.rank_weights(12, 3))
        tested.append(sum(compared))
    assert len(file) * (len(file) - 1) // 2 > tested[0] > tested[1] > tested[2] > tested[3]


def test_tree_finds_the_nearest_pivots():
    x = vectors(20_000, seed=3).astype(np.float32)
    pivots, asked = x[:4000], x[4000:6000]
    tree = pix.PivotTree.grown(pivots, pix.IndexOptions(flat_pivots=1000))
    assert len(tree.centres) <= 64 and sum(len(m) for m in tree.members) == 4000
    flat, got = pix.nearest_pivots(asked, pivots, 4), tree.nearest(asked, 4)
    same = (flat[:, :, None] == got[:, None, :]).any(2).mean()
    assert same > 0.7 and (got >= 0).all()
    assert (np.sort(got, 1)[:, 1:] != np.sort(got, 1)[:, :-1]).all()


def test_packed_rows_come_back():
    rng = np.random.default_rng(4)
    ids = rng.integers(-(2**60), 2**60, 500)
    for most, kind in ((300, "<f2"), (70_000, "<f4"), (300, "<f8")):
        orders = rng.integers(-1, most, (500, 12)).astype(np.int32)
        x = rng.normal(size=(500, 8)).astype(kind).astype(float)
        got = pix.unpack([pix.pack(ids[:200], orders[:200], x[:200]), pix.pack(ids[200:], orders[200:], x[200:])], 12, 8)
        by = np.argsort(ids)
        assert (got[0] == ids[by]).all() and (got[1] == orders[by]).all() and (got[2] == x[by]).all()


def test_bound_follows_the_number_of_pivots():
    x = vectors(30_000, seed=6).astype(np.float32)
    opts = pix.IndexOptions()
    bounds = [pix.footrule_bound(pix.nearest_pivots(x[-8000:], x[:n], 12), opts, n) for n in (40, 400, 4000)]
    assert bounds[0] == opts.min_overlap and bounds[0] >= bounds[1] >= bounds[2] > 4
    assert pix.footrule_bound(pix.nearest_pivots(x[-50:], x[:3], 12), opts, 3) < opts.min_overlap


def files_of(x, pivots, posts, prefix=12):
    orders = pix.nearest_pivots(x.astype(np.float32), pivots.astype(np.float32), prefix)
    ids = np.arange(len(x)) * 3 + 1
    return orders, [(p, (ids[f], orders[f], x[f])) for p in range(len(pivots)) if len(f := np.flatnonzero((orders[:, :posts] == p).any(1)))]


def test_a_pair_is_compared_in_one_file_only(monkeypatch):
    x = vectors(4000, seed=8)[1900:2600]  # a few near pairs, no tight group
    orders, files = files_of(x, x[::5], 5)
    bound, w = 9, pix.rank_weights(12, 3)
    tested, plain = [], pix._pair_cosines

    def record(unit, rows, cols):
        if unit.dtype == np.float32:
            tested.extend(zip(part[0][rows].tolist(), part[0][cols].tolist(), strict=True))
        return plain(unit, rows, cols)

    monkeypatch.setattr(pix, "_pair_cosines", record)
    links = set()
    for pivot, part in files:
        found = pix._unit_links(part, part, pivot, 0.5, 1000, 5, bound, w)
        links |= {tuple(r) for r in found[found.cos6 >= 0][["a", "b"]].to_numpy().tolist()}
    rank = np.zeros((len(x), len(x[::5])), int)
    for r, o in enumerate(orders):
        rank[r, o] = w
    wanted = set()
    for a in range(len(x)):
        agree = np.minimum(rank[a], rank[a + 1 :]).sum(1)
        shared = (orders[a, :5][None, :, None] == orders[a + 1 :, None, :5]).any((1, 2))
        wanted |= {(3 * a + 1, 3 * (a + 1 + b) + 1) for b in np.flatnonzero(shared & (agree >= bound)).tolist()}
    assert len(tested) == len(set(tested)) and set(tested) == wanted
    near = {(a, b) for a, b in wanted if round(float(x[a // 3] @ x[b // 3]), 6) >= 0.5}
    assert near and links == near | {(b, a) for a, b in near}


def test_agreement_of_any_weights_and_pieces():
    rng = np.random.default_rng(9)
    for prefix, step, posts in ((12, 3, 5), (12, 1, 8), (30, 1, 3)):  # one byte, two bytes, sums over a byte
        orders = np.array([rng.permutation(40)[:prefix] for _ in range(700)], np.int32)
        orders[:3, -1] = -1  # no pivot
        w = pix.rank_weights(prefix, step)
        rank = np.zeros((700, 41), int)
        for r, o in enumerate(orders):
            rank[r, o] = w
        rank[:, 40] = 0
        own = 20
        plain, files = pix.RankFiles(orders, w), pix.RankFiles(orders, w, own, posts)
        for row in (0, 1, 300, 698):
            want = np.minimum(rank[row], rank[row + 1 :]).sum(1)
            assert (plain.agreement(row, row + 1) == want).all()
            common = (orders[row, :posts, None] == orders[row + 1 :, None, :posts]) & (orders[row, :posts, None] < own)
            got, here = files.agreement(row, row + 1), ~common.any((1, 2))
            assert (got[here] == want[here]).all() and (got[~here] < 0).all()


def test_best_links_of_two_blocks_are_those_of_the_whole_file():
    x = vectors(1200, seed=10, groups=6)
    _, files = files_of(x, x[::100], 4)
    w = pix.rank_weights(12, 3)
    pivot, (ids, orders, x) = max(files, key=lambda f: len(f[1][0]))
    cut = lambda m: (ids[m], orders[m], x[m])
    odd = ids % 2 == 1
    parts = [cut(odd), cut(~odd)]
    rows = [pix._unit_links(p, q, pivot, 0.85, 5, 4, 5, w) for p, q in ((parts[0], parts[0]), (parts[1], parts[1]), (parts[0], parts[1]))]
    split = sorted({tuple(r) for f in rows for r in f[f.cos6 >= 0][["a", "cos6", "b"]].to_numpy().tolist()}, key=lambda r: (r[0], -r[1], r[2]))
    whole = cut(np.ones(len(ids), bool))
    found = pix._unit_links(whole, whole, pivot, 0.85, 5, 4, 5, w)
    got = sorted((tuple(r) for r in found[found.cos6 >= 0][["a", "cos6", "b"]].to_numpy().tolist()), key=lambda r: (r[0], -r[1], r[2]))
    best = [r for i, r in enumerate(split) if i < 5 or split[i - 5][0] != r[0]]
    assert got == best and len(got) > 100
