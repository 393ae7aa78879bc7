"""Nearest vectors by a permutation index.

Every vector is represented by its nearest *pivots* in order of similarity. It is posted in the inverted
files of its first few pivots. Vectors that meet in a file are ranked by the footrule distance of their
pivot orders, read from rank-weight files without looking at a vector; only pairs that agree well enough get a cosine
(double precision, rounded to 6 decimals, ties by the smaller id).

The number of pivots grows in proportion to the rows, so that a file holds about ``file_rows`` of them at every size, and the
work and the copies of a vector stay the same a row. The pivots of many are found through a tree: a coarse level of
about the root of their number, then the pivots in the nearest ``cells`` coarse cells. Pivots are distinct vectors of the table, those with the
smallest hash, at most ``max_pivots`` (131,072 of 64 numbers: 32 MB); every row is indexed. A tight group supplies as large a part of the
pivots as of the rows. Exact copies are collapsed first and expanded in the result. Files larger than ``block_rows``
are cut into blocks, and block pairs become tasks of their own, so no file lands in one task whatever its size.

Two forms:

* :func:`neighbour_links` - for every vector, its best ``k`` among all vectors with cosine of at least
  ``threshold``; a self join through the posting files.
* :func:`top_k` - for a stated query set, the best ``k`` without a threshold; every data block is ranked by
  footrule through its inverted files and the best part of it is reranked.

Null ids, and vectors that are null, of wrong length, zero or not finite take no part. Repeated rows of an
id count once (the one that arrived first). An empty or single-row table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardlight.llm.vectors import copy_groups, decode, distinct_vectors, unit_rows, usable, without_conflicts

LINK_SCHEMA = "a long, b long, cos6 int, root long"


@dataclass(frozen=True)
class IndexOptions:
    """Parameters of the index.

    ``pivots``: number of pivots, or 0 for as many as give files of ``file_rows`` rows (between ``min_pivots`` and ``max_pivots``).
    ``posts``: files a vector is posted in. ``prefix``: pivots kept of its order, whose weights fall every ``step`` ranks. ``min_overlap``: least
    footrule agreement (sum over shared pivots of the smaller of both rank weights, here at most 30) of a pair that gets a cosine;
    ``passed``: see :func:`footrule_bound`. ``block_rows``: largest block of a file. ``flat_pivots``: pivots up to which all are compared;
    more are found through the tree, in the ``cells`` nearest coarse cells. ``sample_rows``: sample that sizes are estimated from.
    ``apart``: if not 0, a vector with a greater cosine with an earlier pivot is no pivot (few pivots for search without a threshold).
    """

    dimension: int = 64
    pivots: int = 0
    file_rows: int = 2048
    min_pivots: int = 16
    max_pivots: int = 131_072
    flat_pivots: int = 8192
    cells: int = 12
    apart: float = 0.0
    posts: int = 5
    prefix: int = 12
    step: int = 3
    min_overlap: int = 8
    passed: float = 0.1
    sample_rows: int = 16384
    block_rows: int = 16384


_KINDS = ("<f2", "<f4", "<f8")


def pack(ids: np.ndarray, orders: np.ndarray, x: np.ndarray) -> bytes:
    """Rows as one compressed block by id: ids as steps, the narrowest exact number formats, bytes of equal weight stored together."""
    with np.errstate(over="ignore"):
        kind = next(k for k in range(3) if k == 2 or (x.astype(_KINDS[k]) == x).all())
    by_id = np.argsort(ids, kind="stable")
    ids, orders, x = ids[by_id], orders[by_id], x[by_id]
    v = np.ascontiguousarray(x.astype(_KINDS[kind]))
    wide = int(len(orders) and orders.size and orders.max() > np.iinfo(np.int16).max)
    o = np.ascontiguousarray(orders.T.astype("<i4" if wide else "<i2"))
    head = np.array([len(ids), kind, wide], np.int64).tobytes()
    body = head + b"".join(_planes(a) for a in (np.diff(ids, prepend=0).astype("<i8"), o, v))
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _planes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()


def _unpack_one(blob: bytes, prefix: int, dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    body = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n, kind, wide = (int(v) for v in np.frombuffer(body, np.int64, 3))
    at = 24

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(body, np.uint8, count * size, at).reshape(size, count)
        at += count * size
        return np.ascontiguousarray(planes.T).view(kind).reshape(count)

    ids = np.cumsum(take("<i8", n))
    orders = take("<i4" if wide else "<i2", n * prefix).astype(np.int32).reshape(prefix, n).T
    return ids, orders, take(_KINDS[kind], n * dimension).reshape(n, dimension).astype(np.float64)


def unpack(blocks: list[bytes], prefix: int, dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, pivot orders, vectors) of packed blocks, by id; repeated ids are dropped."""
    ids, orders, x = (np.concatenate(c) for c in zip(*(_unpack_one(b, prefix, dimension) for b in blocks), strict=True))
    ids, first = np.unique(ids, return_index=True)
    return ids, orders[first], x[first]


def footrule_bound(orders: np.ndarray, opts: IndexOptions, pivots: int) -> int:
    """The least agreement of a pair that gets a cosine: ``min_overlap``, or less where the sample shows that fewer than ``passed`` of the
    pairs in a file agree so well (with more pivots all agree less); in proportion where there are fewer pivots than an order holds."""
    w = rank_weights(opts.prefix, opts.step)
    if pivots < opts.prefix:
        return int(opts.min_overlap * w[:pivots].sum() / w.sum())
    order = np.argsort(orders[:, 0], kind="stable")
    a, b = order[:-1], order[1:]
    met = orders[a, 0] == orders[b, 0]
    a, b = a[met], b[met]
    if not len(a):
        return opts.min_overlap
    agree = ((orders[a][:, :, None] == orders[b][:, None, :]) * np.minimum(w[:, None], w[None, :])).sum((1, 2))
    bound = opts.min_overlap
    while bound > int(w[0]) + 1 and (agree >= bound - 1).mean() <= opts.passed:
        bound -= 1
    return bound


def choose_pivots(codes: DataFrame, opts: IndexOptions, rows: int) -> tuple[PivotTree, np.ndarray, int]:
    """The pivots, for each the estimated number of rows posted in its file, and the :func:`footrule_bound`.

    One scan draws the distinct vectors whose hash falls below a bound; the first of them in the order of their hash are pivots, and up to
    ``sample_rows`` others tell the sizes.
    """
    want = opts.pivots or int(min(opts.max_pivots, max(opts.min_pivots, opts.posts * rows // opts.file_rows)))
    drawn = max(opts.sample_rows, want)
    part = min(1.0, 1.2 * drawn / max(1, rows))
    mixed = F.pmod(F.xxhash64(F.lit(7), "code"), F.lit(100_000_000))
    shown = codes.where(mixed < int(100_000_000 * part) + 1).select("code").distinct()
    sample = [bytes(r[0]) for r in shown.orderBy(F.xxhash64("code"), "code").limit(drawn).collect()]  # at most max_pivots or sample_rows
    x = unit_rows(decode(sample if opts.apart else sample[:want], opts.dimension)).astype(np.float32)
    tree = PivotTree.grown(_spread_out(x, want, opts.apart) if opts.apart else x, opts)
    if not len(tree.pivots):
        return tree, np.empty(0), 0
    rest = sample[want:] if len(sample) >= 2 * want else sample
    orders = tree.nearest(unit_rows(decode(rest, opts.dimension)).astype(np.float32), opts.prefix)
    seen = orders[:, : min(opts.posts, len(tree.pivots))]
    shares = np.bincount(seen[seen >= 0].ravel(), minlength=len(tree.pivots)) / max(1, len(rest))
    return tree, shares * rows, footrule_bound(orders, opts, len(tree.pivots))


def _spread_out(x: np.ndarray, want: int, most: float) -> np.ndarray:
    """The first ``want`` rows whose cosine with all earlier ones is at most ``most``; others only if these are too few."""
    chosen = np.empty((min(want, len(x)), x.shape[1]), np.float32)
    n, spare = 0, []
    for i in range(len(x)):
        if n == len(chosen):
            break
        if n and (chosen[:n] @ x[i]).max() > most:
            spare.append(i)
            continue
        chosen[n] = x[i]
        n += 1
    chosen[n:] = x[spare[: len(chosen) - n]]
    return chosen


@dataclass(frozen=True)
class PivotTree:
    """Pivots (unit rows), and above many of them a coarse level: centres, and the pivots of each cell."""

    pivots: np.ndarray
    centres: np.ndarray | None = None
    members: list[np.ndarray] | None = None
    cells: int = 12

    @staticmethod
    def grown(pivots: np.ndarray, opts: IndexOptions) -> PivotTree:
        if len(pivots) <= opts.flat_pivots:
            return PivotTree(pivots)
        centres = pivots[: int(len(pivots) ** 0.5)].copy()  # already in random order
        for _ in range(4):
            home = _most_similar(pivots, centres)
            for c in range(len(centres)):
                own = pivots[home == c]
                if len(own):
                    centres[c] = own.sum(0)
            centres /= np.maximum(np.sqrt(np.einsum("ij,ij->i", centres, centres)), 1e-12)[:, None]
        home = _most_similar(pivots, centres)
        used = np.unique(home)
        return PivotTree(pivots, centres[used], [np.flatnonzero(home == c) for c in used], opts.cells)

    def nearest(self, x: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` nearest pivots of each row in order, ties by the smaller pivot; padded with -1."""
        if self.centres is None:
            return nearest_pivots(x, self.pivots, count)
        cells = min(self.cells, len(self.centres))
        near = nearest_pivots(x, self.centres, cells)
        sims = np.full((len(x), cells * count), -np.inf, np.float32)
        found = np.full((len(x), cells * count), -1, np.int32)
        for c in np.unique(near):  # the rows that look into a cell, at once
            rows, place = np.nonzero(near == c)
            own = self.members[c]
            best = nearest_pivots(x[rows], self.pivots[own], count)
            have = best[:, :1].repeat(count, 1)
            keep = best >= 0
            have[keep] = best[keep]
            at = place[:, None] * count + np.arange(count)
            s = np.einsum("ij,ikj->ik", x[rows], self.pivots[own[have]])
            s[~keep] = -np.inf
            sims[rows[:, None], at] = s
            found[rows[:, None], at] = np.where(keep, own[have], -1)
        order = np.lexsort((found, -sims), axis=1)[:, :count]
        return np.take_along_axis(found, order, 1)


def _most_similar(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[lo : lo + 8192] @ centres.T).argmax(1) for lo in range(0, len(x), 8192)])


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest pivots of each row in order, ties by the smaller pivot; padded with -1."""
    have = min(count, len(pivots))
    out = np.full((len(x), count), -1, np.int32)
    for lo in range(0, len(x), 4096):
        s = x[lo : lo + 4096] @ pivots.T
        part = np.argpartition(-s, have - 1, axis=1)[:, :have] if have < s.shape[1] else np.tile(np.arange(have), (len(s), 1))
        part.sort(axis=1)
        order = np.argsort(-np.take_along_axis(s, part, 1), axis=1, kind="stable")
        out[lo : lo + 4096, :have] = np.take_along_axis(part, order, 1)
    return out


def rank_weights(prefix: int, step: int) -> np.ndarray:
    """Weights of the ranks of an order, falling by one every ``step`` ranks to 1."""
    return ((prefix - 1 - np.arange(prefix)) // step + 1).astype(np.uint8)


class RankFiles:
    """The inverted files of a unit: for each pivot, the rank weight of every row, 0 if it isn't in the row's order.

    With weights by rank the truncated footrule distance of two orders is twice the sum of the weights less twice their agreement, the sum over
    shared pivots of the smaller weight. A file is kept once for every weight that a row can ask with, cut to it, in pieces of ``width`` rows.

    A pair belongs to the file of the first pivot (by number) that both are posted in. With ``own`` (the pivot of the unit) rows that are
    posted in the file of an earlier pivot take so much off there that a pair of another file agrees by less than 0, whatever else it shares.
    """

    width = 512

    def __init__(self, orders: np.ndarray, weights: np.ndarray, own: int = -1, posts: int = 0):
        n, length = orders.shape
        count = np.bincount(orders.ravel() + 1)
        count[:1] = 0  # no pivot
        known = np.flatnonzero(count > 1) - 1  # the file of any other has no second row: all of them share an empty one
        names = np.zeros(len(count), np.int64)
        names[known + 1] = np.arange(1, len(known) + 1)
        local = names[orders + 1]
        total = int(weights.sum(dtype=np.int64))
        off = -(total + 1)
        posts = min(posts, length)
        least = off * max(0, posts - 1)  # the pivot of the unit is one of the posts and takes nothing off
        kind = np.int8 if total <= 127 and least >= -128 else np.int16 if total <= 32767 and least >= -32768 else np.int32
        steps = weights.astype(kind)
        earlier = (orders[:, :posts] >= 0) & (orders[:, :posts] < own)
        self.pieces = []
        for lo in range(0, n, self.width):
            here = local[lo : lo + self.width]
            size = len(here)
            files, places = np.zeros((len(known) + 1, size), kind), here * size + np.arange(size)[:, None]
            files.ravel()[places] = steps
            files[0] = 0
            less, cut = places[:, :posts][earlier[lo : lo + self.width]], {}
            for j, w in enumerate(steps):
                if (w, j < posts) not in cut:
                    file = cut[w, j < posts] = np.minimum(files, w)
                    if j < posts:
                        file.ravel()[less] = off
                        file[0] = 0
            self.pieces.append([cut[w, j < posts] for j, w in enumerate(steps)])
        self.asked = np.ascontiguousarray(local.T)
        self.rows, self.kind = n, kind

    def blocks(self, lo: int, hi: int, first: int) -> Iterator[tuple[int, np.ndarray]]:
        """Agreement of the rows from ``lo`` to ``hi`` with the rows from ``first`` on, piece by piece: (first row of the piece, agreement).

        An array is valid until the next piece."""
        total, part = (np.empty((hi - lo) * self.width, self.kind) for _ in range(2))
        for c in range(first // self.width, len(self.pieces)):
            files = self.pieces[c]
            size = files[0].shape[1]
            out, one = (v[: (hi - lo) * size].reshape(hi - lo, size) for v in (total, part))
            for j, file in enumerate(files):
                np.take(file, self.asked[j, lo:hi], axis=0, out=one if j else out, mode="clip")
                if j:
                    np.add(out, one, out)
            skip = max(0, first - c * self.width)
            yield c * self.width + skip, out[:, skip:]

    def agreement(self, row: int, first: int) -> np.ndarray:
        """Of a row with the rows from ``first`` on."""
        return np.concatenate([np.empty(0, self.kind)] + [a[0].copy() for _, a in self.blocks(row, row + 1, first)])


class _Groups:
    """Union-find over the rows of a unit, kept flat."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, rows: np.ndarray, cols: np.ndarray) -> None:
        """Joins the ends of all given links (minimum label, by repeated hooking and halving)."""
        of = self.of
        while True:
            a, b = of[rows], of[cols]
            differ = a != b
            if not differ.any():
                return
            rows, cols, a, b = rows[differ], cols[differ], a[differ], b[differ]
            np.minimum.at(of, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = of[of]
                if (up == of).all():
                    break
                of[:] = up


def _best(keys: np.ndarray, span: int, k: int) -> np.ndarray:
    """The first ``k`` keys in order of every row, where ``span`` keys belong to a row."""
    keys = np.sort(keys)
    row = keys // span
    return keys[np.r_[np.ones(min(k, len(keys)), bool), row[k:] != row[:-k]]]


def _pair_cosines(x: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    parts = [np.einsum("ij,ij->i", x[rows[p : p + 2048]], x[cols[p : p + 2048]]) for p in range(0, len(rows), 2048)]
    return np.concatenate(parts) if parts else np.empty(0, x.dtype)


def _unit_links(left, right, pivot: int, threshold: float, k: int, posts: int, bound: int, weights: np.ndarray) -> pd.DataFrame:
    """Links of the rows of ``left`` to rows of ``right`` (the same block, or another one of the file): only pairs that belong to this file."""
    same = right is left
    ids, orders, exact = left if same else tuple(np.concatenate([p, q]) for p, q in zip(left, right, strict=True))
    unit = unit_rows(exact)
    x = unit.astype(np.float32)
    n, split = len(ids), len(left[0])
    groups = _Groups(n)
    # links as numbers: by row, then the greatest cosine, then the smallest id of the other row
    by_id = np.argsort(ids, kind="stable")
    place = np.empty(n, np.int64)
    place[by_id] = np.arange(n)
    span = 2_000_001 * n
    if span * n >= 1 << 63:
        raise ValueError("a block has too many rows: lower block_rows")
    found: list[np.ndarray] = []
    held = 0
    slack = np.float32(threshold - 2e-6)
    step, many = 256, 4 * k
    ranks = RankFiles(orders, weights, pivot, posts)  # with the pairs of this file only
    for lo in range(0, split if not same else n, step):
        hi = min(n if same else split, lo + step)
        first = lo if same else split  # each pair is met once; the cosine counts for both
        near = np.empty((hi - lo, n - first), bool)
        for at, agree in ranks.blocks(lo, hi, first):
            np.greater_equal(agree, bound, out=near[:, at - first : at - first + agree.shape[1]])
        if same:
            near[:, : hi - lo] &= ~np.tri(hi - lo, dtype=bool)
        count = np.count_nonzero(near, axis=1)
        # rows that few others agree with are compared pair by pair, rows of tight groups as a block
        dense = np.flatnonzero(count > max(64, near.shape[1] // 8))
        if len(dense):
            block = near[dense]
            near[dense], count[dense] = False, 0
        rows = np.repeat(np.arange(hi - lo), count)
        cols = np.flatnonzero(near) - rows * near.shape[1]
        rows, cols = rows + lo, cols + first
        hit = _pair_cosines(x, rows, cols) >= slack
        rows, cols = rows[hit], cols[hit]
        if len(dense):
            # all hits of a row join its group, but only those are ranked that may be among the first k of the row or of the column
            s = np.where(block, x[lo + dense] @ x[first:].T, np.float32(-2))
            mask = s >= slack
            busy_rows = np.flatnonzero(np.count_nonzero(mask, axis=1) > many)
            label = groups.of[first:] if same else groups.of[split:]
            strange = mask[busy_rows] & (label != groups.of[lo + dense[busy_rows]][:, None])
            for r in np.flatnonzero(strange.any(axis=1)):
                row = lo + dense[busy_rows[r]]
                to = np.flatnonzero(strange[r])
                to = to[(s[busy_rows[r], to] >= threshold + 2e-6) & (groups.of[to + first] != groups.of[row])]
                groups.link(np.full(len(to), row), to + first)
            row_floor = np.full(len(dense), -2, np.float32)
            if s.shape[1] > k:
                row_floor[busy_rows] = np.partition(s[busy_rows], s.shape[1] - k, axis=1)[:, s.shape[1] - k] - 4e-6
            col_floor = np.full(s.shape[1], -2, np.float32)
            busy = np.flatnonzero(np.count_nonzero(mask, axis=0) > many)
            if len(busy):
                col_floor[busy] = np.partition(np.ascontiguousarray(s.T[busy]), len(dense) - k, axis=1)[:, len(dense) - k] - 4e-6
            mask &= (s >= row_floor[:, None]) | (s >= col_floor)
            more, to = np.divmod(np.flatnonzero(mask.ravel()), s.shape[1])
            rows, cols = np.r_[rows, lo + dense[more]], np.r_[cols, to + first]
        if not len(rows):
            continue
        cos = _pair_cosines(unit, rows, cols)
        cos6 = np.rint(cos * 1e6).astype(np.int64)
        ok = cos6 >= round(threshold * 1e6)
        rows, cols, cos6 = rows[ok], cols[ok], cos6[ok]
        groups.link(rows, cols)
        for a, b in ((rows, cols), (cols, rows)):
            found.append(a * span + (1_000_000 - cos6) * n + place[b])
        held += 2 * len(rows)
        if held > 2_000_000:
            found = [_best(np.concatenate(found), span, k)]
            held = len(found[0])
    if not found:
        return pd.DataFrame({"a": [], "b": [], "cos6": [], "root": []}).astype({"a": "int64", "b": "int64", "cos6": "int32", "root": "int64"})
    rows, cos6 = np.divmod(_best(np.concatenate(found), span, k), span)
    cos6, cols = np.divmod(cos6, n)
    cos6, cols = 1_000_000 - cos6, by_id[cols]
    # ids are sorted within a block, so across blocks the smallest id of a group has to be looked up
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, groups.of, ids)
    roots = least[groups.of]
    grouped = np.flatnonzero(np.bincount(groups.of, minlength=n)[groups.of] > 1)
    stars = grouped[roots[grouped] != ids[grouped]]
    return pd.DataFrame(
        {
            "a": np.r_[ids[rows], ids[stars]],
            "b": np.r_[ids[cols], roots[stars]],
            "cos6": np.r_[cos6, np.full(len(stars), -1)].astype(np.int32),
            "root": np.r_[roots[rows], roots[stars]],
        }
    )


def prepare(vector_entries: DataFrame, keep: int, dimension: int = 64) -> tuple[DataFrame, DataFrame, int]:
    """Distinct usable vectors (id, code); the copies: (id, ids) of vectors that several ids have; the number of rows.

    ``id`` is the smallest id of a vector, ``ids`` its ``keep`` smallest ids.
    """
    codes = usable(without_conflicts(vector_entries), dimension=dimension)
    copied, spare, rows = copy_groups(codes, keep)
    return distinct_vectors(codes, spare), copied, rows


def neighbour_links(reps: DataFrame, threshold: float = 0.85, k: int = 10, opts: IndexOptions = IndexOptions(), rows: int | None = None) -> DataFrame:
    """Links between distinct vectors with cosine of at least ``threshold``, found through the posting files.

    Rows (a, b, cos6, root): ``b`` is one of the best ``k`` of ``a`` in some file (each pair is ranked in one
    file only), ``cos6`` the cosine in millionths. ``root`` is the smallest id that ``a`` is joined to, directly
    or through others, by the pairs of that file. Rows with ``cos6`` of -1 say only that ``a`` and ``b`` are joined.
    """
    tree, sizes, bound = choose_pivots(reps, opts, reps.count() if rows is None else rows)
    if len(tree.pivots) == 0:
        return reps.sparkSession.createDataFrame([], LINK_SCHEMA)
    blocks = np.maximum(1, np.ceil(sizes / opts.block_rows)).astype(np.int64)
    if blocks.max() >= 1 << 15:
        raise ValueError("a file has too many blocks: raise block_rows")
    posts = min(opts.posts, len(tree.pivots))
    weights = rank_weights(opts.prefix, opts.step)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush():
            t = pa.Table.from_batches(held)
            ids, exact = t["id"].to_numpy(), decode(t["code"].to_pylist(), opts.dimension)
            x = unit_rows(exact).astype(np.float32)
            orders = tree.nearest(x, opts.prefix)
            home = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            units, blobs = [], []
            flat = orders[:, :posts].ravel()
            by_pivot = np.argsort(flat, kind="stable")
            for run in np.split(by_pivot, np.flatnonzero(np.diff(flat[by_pivot])) + 1):
                p, rows = flat[run[0]], run // posts
                if p < 0:
                    continue
                block = (home[rows] % np.uint64(blocks[p])).astype(np.int64)
                for b in np.unique(block):
                    own = rows[block == b]
                    blob = pack(ids[own], orders[own], exact[own])
                    for other in range(blocks[p]):
                        units.append((int(p) << 32) | (min(int(b), other) << 17) | (max(int(b), other) << 2) | int(other < b))
                        blobs.append(blob)
            return pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(blobs, pa.binary())], names=["unit", "blob"])

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 50_000:
                yield flush()
                held, rows = [], 0
        if rows:
            yield flush()

    def link(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pivot, i, j = int(key[0]) >> 30, (int(key[0]) >> 15) & 0x7FFF, int(key[0]) & 0x7FFF
        take = lambda side: pdf["blob"][pdf["side"] == side].tolist()
        left = unpack(take(0), opts.prefix, opts.dimension) if take(0) else None
        right = left if i == j else (unpack(take(1), opts.prefix, opts.dimension) if take(1) else None)
        if left is None or right is None:
            left = right = tuple(v[:0] for v in (left or right))
        return _unit_links(left, right, pivot, threshold, k, opts.posts, bound, weights)

    posted = reps.select("id", "code").mapInArrow(post, "unit long, blob binary")
    keyed = posted.select(F.shiftright("unit", 2).alias("unit"), F.col("unit").bitwiseAND(1).alias("side"), "blob")
    return keyed.groupBy("unit").applyInPandas(link, LINK_SCHEMA)


def expand_neighbours(links: DataFrame, copied: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of every vector, copies included: (vector_idx, neighbour, cos6, rank).

    ``copied`` has the first ``k + 1`` ids of each group of copies. No other member of a group can be among
    anyone's first ``k``; members beyond them all have the first ``k`` of their group.
    """
    best = links.where("cos6 >= 0").select("a", "b", "cos6")  # a pair belongs to one file
    pairs = (
        best.join(copied.select(F.col("id").alias("b"), F.col("ids").alias("ids_b")), "b", "left")
        .select("a", "cos6", F.explode(F.coalesce("ids_b", F.array("b"))).alias("n"))
        .unionByName(copied.select(F.col("id").alias("a"), F.lit(1_000_000).alias("cos6"), F.explode("ids").alias("n")))
    )
    members = pairs.join(copied.select(F.col("id").alias("a"), F.col("ids").alias("ids_a")), "a", "left").select(
        F.explode(F.coalesce("ids_a", F.array("a"))).alias("vector_idx"), "n", "cos6"
    )
    ranked = members.where("vector_idx <> n").selectExpr(
        "vector_idx", "n AS neighbour", "cos6",
        "row_number() OVER (PARTITION BY vector_idx ORDER BY cos6 DESC, n) AS rank",
    )
    return ranked.where(F.col("rank") <= k)


def mutual(neighbours: DataFrame) -> DataFrame:
    """Pairs in which each is among the other's first: (vector_a, vector_b)."""
    pair = neighbours.select(
        F.least("vector_idx", "neighbour").alias("vector_a"), F.greatest("vector_idx", "neighbour").alias("vector_b")
    )
    return pair.groupBy("vector_a", "vector_b").agg(F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")


# -- a stated query set without a threshold ---------------------------------------------------------------------------
@dataclass(frozen=True)
class SearchOptions:
    """``prefix`` pivots of an order are kept, their ranks in steps of ``step``. Of each data block the ``share`` of rows that
    agree best with a query (ties included) is reranked. ``group_rows``: rows of a data block."""

    pivots: int = 256
    prefix: int = 32
    step: int = 4
    share: float = 0.08
    group_rows: int = 100_000
    query_block: int = 64
    row_block: int = 16_384


def _ranked(q_orders: np.ndarray, files: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Footrule agreement of each query with each row: its pivots' files are read one after the other.

    ``files`` (pivot x row) holds the rank weight of every row posted in a pivot's inverted file, else 0.
    """
    out = np.zeros((len(q_orders), files.shape[1]), np.uint8)
    for j, weight in enumerate(w):
        part = files[q_orders[:, j]]
        np.minimum(part, weight, out=part)
        out += part
    return out


def top_k(
    codes: DataFrame, queries: DataFrame, k: int = 10, dimension: int = 64, opts: SearchOptions = SearchOptions(), sample_rows: int = 16384
) -> DataFrame:
    """(query_id, neighbour, cos6, rank): the best ``k`` other rows of ``codes`` for every row of ``queries`` (both vector_idx, code).

    Each query meets every data block once; a block returns ``k`` rows a query, which are ranked after a shuffle.
    The pivot orders are compared before any vector is; only the rows ranked best are compared by cosine.
    """
    index = IndexOptions(dimension=dimension, pivots=opts.pivots, sample_rows=sample_rows, apart=0.7)
    rows = codes.count()
    pivots = choose_pivots(codes.withColumnRenamed("vector_idx", "id"), index, rows)[0].pivots
    schema = "query_id long, neighbour long, cos6 int"
    if not len(pivots):
        return codes.sparkSession.createDataFrame([], schema + ", rank int")
    prefix = min(opts.prefix, len(pivots))
    groups = max(1, -(-rows // opts.group_rows))
    w = rank_weights(prefix, max(1, opts.step))
    if int(w.sum()) > 255:
        raise ValueError("prefix and step must keep the sum of the rank weights below 256")

    def spread(is_query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                x = decode(batch.column(1).to_pylist(), dimension)
                none = np.empty((len(ids), 0), np.int16)
                if is_query:
                    blob = pack(ids, none, x) if len(ids) else b""
                    keys, blobs = (list(range(groups)), [blob] * groups) if len(ids) else ([], [])
                else:
                    home = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(groups)
                    keys = np.unique(home).astype(int).tolist()
                    blobs = [pack(ids[home == g], none[home == g], x[home == g]) for g in keys]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array([is_query] * len(keys), pa.bool_()), pa.array(blobs, pa.binary())], names=["grp", "q", "blob"]
                )

        return run

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.empty(0, np.int64), "neighbour": np.empty(0, np.int64), "cos6": np.empty(0, np.int32)})
        data, asked = pdf["blob"][~pdf["q"]].tolist(), pdf["blob"][pdf["q"]].tolist()
        if not data or not asked:
            return empty
        ids, _, x = unpack(data, 0, dimension)
        qids, _, q = unpack(asked, 0, dimension)
        x, q = unit_rows(x), unit_rows(q)
        x4, n = x.astype(np.float32), len(ids)
        orders, q_orders = nearest_pivots(x4, pivots, prefix), nearest_pivots(q.astype(np.float32), pivots, prefix)
        files = []
        for lo in range(0, n, opts.row_block):
            part = orders[lo : lo + opts.row_block]
            f = np.zeros((len(pivots), len(part)), np.uint8)
            for j in range(prefix):
                f[part[:, j], np.arange(len(part))] = w[j]
            files.append(f)
        least = max(k + 1, int(np.ceil(n * opts.share)))
        found = []
        for lo in range(0, len(qids), opts.query_block):
            agree = np.concatenate([_ranked(q_orders[lo : lo + opts.query_block], f, w) for f in files], axis=1)
            floor = np.partition(agree, n - least, axis=1)[:, n - least] if n > least else np.zeros(len(agree), np.uint8)
            for r, row in enumerate(agree):
                rows_ = np.flatnonzero(row >= floor[r])
                rows_ = rows_[ids[rows_] != qids[lo + r]]
                s = x4[rows_] @ q[lo + r].astype(np.float32)
                if len(rows_) > k:
                    rows_ = rows_[s >= np.partition(s, len(s) - k)[len(s) - k] - 4e-6]
                cos6 = np.rint(x[rows_] @ q[lo + r] * 1e6).astype(np.int32)
                best = np.lexsort((ids[rows_], -cos6))[:k]
                found.append((np.full(len(best), qids[lo + r]), ids[rows_[best]], cos6[best]))
        a, b, c = (np.concatenate(v) for v in zip(*found, strict=True))
        return pd.DataFrame({"query_id": a, "neighbour": b, "cos6": c})

    shape = "grp long, q boolean, blob binary"
    met = (
        codes.select("vector_idx", "code").mapInArrow(spread(False), shape)
        .unionByName(queries.select("vector_idx", "code").mapInArrow(spread(True), shape))
        .groupBy("grp").applyInPandas(search, schema)
    )
    ranked = met.selectExpr("*", "row_number() OVER (PARTITION BY query_id ORDER BY cos6 DESC, neighbour) AS rank")
    return ranked.where(F.col("rank") <= k)
