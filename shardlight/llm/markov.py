"""Grouping records into similarity clusters by Markov clustering.

The matrix is a sparse similarity graph: each vector's nearest neighbours with cosine of at least the
threshold, from the permutation index. Squaring (expansion), inflation and pruning of small entries
alternate until the columns settle; the row a column flows to most is its attractor, and columns that
lead to one another form a cluster. The members with the strongest incoming flow represent it.

Flow never leaves a component of the graph, so the matrix is block diagonal. The blocks come from the
groups the index tasks report, closed over several tasks. Many small blocks are squared together as one
sparse matrix in a task; a block with more than ``block_rows`` entries (a tight group may hold a third of
all vectors) is squared by distributed joins instead.

Markov clusters can cut a component at weak links. The exact check after it joins clusters that any link of the graph
connects (``grp``), which gives sets joined directly or through other links.

Exact copies are collapsed before and counted, and expanded, after. Unusable vectors belong to no cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardlight.operators.components import connected_components
from shardlight.operators.skew import salted_left_join
from shardlight.llm import permutation_index as pix
from shardlight.llm.vectors import copy_groups_of, decode, distinct_vectors, keyed_by, unit_rows, usable, without_conflicts
from shardlight.runtime import cut, shuffle_width, stored

MEMBER_SCHEMA = "id long, cluster long, strength double, grp long"


@dataclass(frozen=True)
class FlowOptions:
    """``inflation``: power of the inflation. ``kept``: entries kept a column. ``least``: entries below this part of
    their column are pruned. ``rounds``: most expansions. ``settled``: a column is settled when its largest entry and
    the sum of its squares differ by less. ``block_rows``: graph entries up to which a block is squared in one task. ``block_pairs``: pairs of members up to which :func:`whole_members` treats one so.
    ``task_rows``: entries that tasks of many small blocks should hold.
    """

    inflation: float = 2.0
    kept: int = 10
    least: float = 0.005
    rounds: int = 16
    settled: float = 1e-3
    block_rows: int = 600_000
    block_pairs: int = 4096 * 4096
    task_rows: int = 150_000


# -- one task -----------------------------------------------------------------------------------
def _normalised(j: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    return w / np.bincount(j, w, minlength=n)[j]


def _summed(i: np.ndarray, j: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of equal place added up, in column order."""
    key = j * np.int64(n) + i
    bits = len(key).bit_length()
    if (n * n).bit_length() + bits < 64:  # numbers of place and position sort faster than positions by place
        key = np.sort((key << bits) | np.arange(len(key)))
        key, order = key >> bits, key & ((1 << bits) - 1)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    key = key[first]
    return key % n, key // n, np.add.reduceat(w[order], first)


def _pruned(i, j, w, n: int, opts: FlowOptions):
    """The largest entries of each column, those below a part of it dropped, scaled to sum 1."""
    large = _normalised(j, w, n) >= opts.least
    some = np.zeros(n, bool)
    some[j[large]] = True
    ranked = large | ~some[j]  # where none is large, the largest is looked for among all
    i, j, w = i[ranked], j[ranked], w[ranked]
    order = np.lexsort((i, -w, j))
    i, j, w = i[order], j[order], w[order]
    start = np.flatnonzero(np.r_[True, j[1:] != j[:-1]])
    rank = np.arange(len(j)) - np.repeat(start, np.diff(np.r_[start, len(j)]))
    keep = (rank < opts.kept) & some[j] | (rank == 0)
    i, j, w = i[keep], j[keep], w[keep]
    return i, j, _normalised(j, w, n)


def markov_flow(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, opts: FlowOptions) -> tuple[np.ndarray, np.ndarray]:
    """(attractor, strength) of each of ``n`` nodes of a graph with the links a-b of weight w.

    ``strength`` is the flow into a node summed over the start and all ``rounds``; a settled column counts with its last flow
    in the rounds that it isn't computed for. Columns that have settled leave the matrix with all that they flow to once no open column needs them.
    """
    a, b, w = np.r_[a, b], np.r_[b, a], np.r_[w, w]
    order = np.lexsort((-w, a, b))  # a pair can come from several tasks: its greatest weight counts
    i, j, w = a[order], b[order], w[order]
    first = np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])][: len(i)]
    i, j, w = i[first], j[first], w[first]
    loop = np.zeros(n)
    np.maximum.at(loop, j, w)
    i, j, m = np.r_[i, np.arange(n)], np.r_[j, np.arange(n)], np.r_[w, np.where(loop > 0, loop, 1.0)]
    i, j, m = _pruned(i, j, m, n, opts)
    strength = np.bincount(i, m, minlength=n)
    attractor = np.arange(n)
    steps = 1
    for _ in range(opts.rounds):
        count = np.bincount(j, minlength=n)
        start = np.r_[0, np.cumsum(count)[:-1]]
        reps = count[i]  # entry (i, j) meets all entries of column i
        at = np.repeat(start[i] - np.r_[0, np.cumsum(reps)[:-1]], reps) + np.arange(reps.sum())
        i2, j2, m2 = _summed(i[at], np.repeat(j, reps), np.repeat(m, reps) * m[at], n)
        i, j, m = _pruned(i2, j2, m2**opts.inflation, n, opts)
        strength += np.bincount(i, m, minlength=n)
        steps += 1
        # the first entry of a column is its largest
        start = np.flatnonzero(np.r_[True, j[1:] != j[:-1]])
        attractor[j[start]] = i[start]
        chaos = m[start] - np.add.reduceat(m * m, start)
        settled = np.zeros(n, bool)
        settled[j[start]] = chaos < opts.settled
        left = opts.rounds + 1 - steps
        if settled[j].all():
            strength += left * np.bincount(i, m, minlength=n)
            break
        open_ = np.zeros(n, bool)
        open_[j[~settled[j]]] = True
        while True:  # columns that an open column flows to stay
            more = i[open_[j]]
            if open_[more].all():
                break
            open_[more] = True
        stay = open_[j]
        strength += left * np.bincount(i[~stay], m[~stay], minlength=n)  # each column once, as it leaves
        i, j, m = i[stay], j[stay], m[stay]
    return attractor, strength


def _cluster_task(opts: FlowOptions):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, inverse = np.unique(np.r_[pdf["a"].to_numpy(), pdf["b"].to_numpy()], return_inverse=True)
        linked = (pdf["cos6"] >= 0).to_numpy()
        a, b = inverse[: len(pdf)][linked], inverse[len(pdf) :][linked]
        attractor, strength = markov_flow(len(ids), a, b, pdf["cos6"].to_numpy()[linked] / 1e6, opts)
        joined = pix._Groups(len(ids))
        joined.link(np.arange(len(ids)), attractor)
        cluster = ids[joined.of]
        joined.link(inverse[: len(pdf)], inverse[len(pdf) :])
        return pd.DataFrame({"id": ids, "cluster": cluster, "strength": strength, "grp": ids[joined.of]})

    return run


# -- blocks that are too large for a task -----------------------------------------------------------
def distributed_flow(links: DataFrame, opts: FlowOptions, capped: bool = True) -> DataFrame:
    """(id, cluster, strength) by squaring the whole sparse matrix in joins; ``strength`` as in :func:`markov_flow`."""
    both = links.select("a", "b", "cos6").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos6"))
    entries = both.groupBy(F.col("a").alias("i"), F.col("b").alias("j")).agg((F.max("cos6") / 1e6).alias("w"))
    loops = entries.groupBy("j").agg(F.max("w").alias("w")).select(F.col("j").alias("i"), "j", "w")

    def pruned(m: DataFrame) -> DataFrame:
        col = Window.partitionBy("j")
        ranked = m.withColumn("_r", F.row_number().over(col.orderBy(F.desc("w"), "i"))).withColumn("_s", F.sum("w").over(col))
        if not capped:
            kept = m.withColumn("_m", F.max("w").over(col)).where(F.col("w") >= opts.least * F.col("_m"))
            return kept.select("i", "j", (F.col("w") / F.sum("w").over(col)).alias("w"))
        kept = ranked.where((F.col("_r") == 1) | ((F.col("_r") <= opts.kept) & (F.col("w") >= opts.least * F.col("_s"))))
        return kept.select("i", "j", (F.col("w") / F.sum("w").over(col)).alias("w"))

    m = cut(pruned(entries.unionByName(loops)))
    strength = m.groupBy("i").agg(F.sum("w").alias("s"))
    for done in range(1, opts.rounds + 1):
        left, right = m.select(F.col("i").alias("k"), "j", "w"), m.select("i", F.col("j").alias("k"), F.col("w").alias("v"))
        square = left.join(right, "k").groupBy("i", "j").agg(F.pow(F.sum(F.col("w") * F.col("v")), F.lit(opts.inflation)).alias("w"))
        m = cut(pruned(square))
        strength = strength.unionByName(m.groupBy("i").agg(F.sum("w").alias("s")))
        open_columns = m.groupBy("j").agg((F.max("w") - F.sum(F.col("w") * F.col("w"))).alias("chaos")).where(F.col("chaos") >= opts.settled)
        if open_columns.isEmpty():
            strength = strength.unionByName(m.groupBy("i").agg((F.sum("w") * (opts.rounds - done)).alias("s")))
            break
    up = m.groupBy("j").agg(F.max_by("i", F.struct("w", -F.col("i"))).alias("i"))
    cluster = connected_components(up, "j", "i")
    total = strength.groupBy("i").agg(F.sum("s").alias("strength"))
    return cluster.join(total, cluster.node == total.i, "left").select(
        F.col("node").alias("id"), F.col("component").alias("cluster"), F.coalesce("strength", F.lit(0.0)).alias("strength")
    )


# -- whole sets: every link, no cap -------------------------------------------------------------------
def _scaled(m: np.ndarray, opts: FlowOptions) -> np.ndarray:
    """Entries below the part ``least`` of the largest of their column dropped, columns scaled to sum 1; in place."""
    m[m < opts.least * m.max(1, keepdims=True)] = 0
    m /= m.sum(1, keepdims=True)
    return m


def dense_flow(m: np.ndarray, opts: FlowOptions) -> tuple[np.ndarray, np.ndarray]:
    """(attractor, strength) of the members of blocks of equal size (blocks x n x n: weights, 0 without a link).

    Nothing is cut but by the relative threshold. A block leaves when all its columns have settled.
    """
    count, n = m.shape[:2]
    own = np.arange(n)
    m[:, own, own] = 0
    m[:, own, own] = m.max(1)
    m = _scaled(m, opts)
    strength, attractor, live = m.sum(2), np.zeros((count, n), np.int64), np.arange(count)
    for done in range(1, opts.rounds + 1):
        m = m @ m
        m = _scaled(np.power(m, opts.inflation, out=m), opts)
        flow = m.sum(2)
        strength[live] += flow
        attractor[live] = np.round(m, 4).argmax(1)
        settled = (m.max(1) - np.einsum("bij,bij->bj", m, m) < opts.settled).all(1)
        strength[live[settled]] += (opts.rounds - done) * flow[settled]
        if settled.any():
            m, live = m[~settled], live[~settled]
            if not len(live):
                break
    return attractor, strength


def _sets_task(threshold: float, dimension: int, opts: FlowOptions):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "id"])
        ids, block, u = pdf["id"].to_numpy(), pdf["block"].to_numpy(), unit_rows(decode(pdf["code"].tolist(), dimension))
        start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        size = np.diff(np.r_[start, len(ids)])
        cluster, strength, closeness = ids.copy(), np.zeros(len(ids)), np.zeros(len(ids))
        for n in np.unique(size):
            every, step = start[size == n], max(1, 1_000_000 // int(n * n))
            for lo in range(0, len(every), step):
                at = every[lo : lo + step, None] + np.arange(n)
                s = u[at] @ u[at].transpose(0, 2, 1)
                closeness[at] = total = s.sum(2)
                linked = s >= threshold - 5e-7  # as the cosine rounded to 6 decimals
                linked[:, np.arange(n), np.arange(n)] = True
                whole = linked.all((1, 2))
                cluster[at[whole]] = ids[at[whole][:, :1]]
                strength[at[whole]] = (opts.rounds + 1) * n * total[whole] / total[whole].sum(1, keepdims=True)
                if whole.all():
                    continue
                w = (s[~whole] * linked[~whole]).astype(np.float32 if n > 512 else np.float64)
                del s, linked
                attractor, strength[at[~whole]] = dense_flow(w, opts)
                for rows, to in zip(at[~whole], attractor, strict=True):
                    joined = pix._Groups(n)
                    joined.link(np.arange(n), to)
                    cluster[rows] = ids[rows][joined.of]
        return pd.DataFrame({"id": ids, "cluster": cluster, "strength": strength, "grp": block, "closeness": closeness})

    return run


def _large_sets(rows: DataFrame, threshold: float, dimension: int, opts: FlowOptions) -> DataFrame:
    """The same for blocks that no task holds.

    If all members lie within half the angle of the threshold from the centre of their block, every pair is linked: that takes
    no pairs. Of any other block the links are counted by products of its pieces, and written only if some pair isn't linked.
    """
    def units(batch):
        return unit_rows(decode(batch.column("code").to_pylist(), dimension))

    def add_up(batches):
        for batch in batches:
            if batch.num_rows:
                b, of = np.unique(batch.column("block").to_numpy(), return_inverse=True)
                sums = np.zeros((len(b), dimension))
                np.add.at(sums, of, units(batch))
                yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(list(sums), pa.list_(pa.float64()))], names=["block", "s"])

    partial = rows.mapInArrow(add_up, "block long, s array<double>").select("block", F.posexplode("s").alias("i", "x"))
    sums = partial.groupBy("block", "i").agg(F.sum("x").alias("x")).toPandas()  # dimension numbers a large block
    blocks_ = np.unique(sums["block"])
    centre = np.zeros((len(blocks_), dimension))
    centre[np.searchsorted(blocks_, sums["block"]), sums["i"]] = sums["x"]

    def measure(batches):
        for batch in batches:
            if batch.num_rows:
                c = centre[np.searchsorted(blocks_, batch.column("block").to_numpy())]
                total, length = np.einsum("ij,ij->i", units(batch), c), np.sqrt(np.einsum("ij,ij->i", c, c))
                columns = [batch.column("id"), batch.column("block"), pa.array(total), pa.array(total / length), pa.array(length**2)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "block", "closeness", "near", "all"])

    near = stored(rows.mapInArrow(measure, "id long, block long, closeness double, near double, all double"), "near")
    state = cut(near.groupBy("block").agg(F.min("near").alias("least"), F.count(F.lit(1)).alias("n")))
    bound = ((1 + threshold) / 2) ** 0.5 + 1e-9

    def one_cluster(blocks: DataFrame) -> DataFrame:
        return near.join(F.broadcast(blocks), "block").select(
            "id", F.col("block").alias("cluster"), ((opts.rounds + 1) * F.col("n") * F.col("closeness") / F.col("all")).alias("strength"),
            F.col("block").alias("grp"), "closeness",
        )

    tight = one_cluster(state.where(F.col("least") >= bound))
    loose = state.where(F.col("least") < bound).select("block", "n", F.ceil(F.col("n") / 2048).alias("pieces"))
    if loose.isEmpty():
        return tight
    placed = rows.join(F.broadcast(loose), "block").withColumn("own", F.pmod(F.xxhash64("id"), F.col("pieces")))
    sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    sent = sent.select("block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("side"), "id", "code")

    def near_pairs(key: tuple, pdf: pd.DataFrame):
        left = pdf[~pdf["side"]]
        right = left if key[1] == key[2] else pdf[pdf["side"]]
        if not len(left) or not len(right):
            return left, left, np.empty((len(left), 0)), None
        s = unit_rows(decode(left["code"].tolist(), dimension)) @ unit_rows(decode(right["code"].tolist(), dimension)).T
        if right is left:
            s[np.tri(len(s), dtype=bool)] = -2
        return left, right, s, s >= threshold - 5e-7

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        linked = near_pairs(key, pdf)[3]
        return pd.DataFrame({"block": [key[0]], "links": [0 if linked is None else int(np.count_nonzero(linked))]})

    def link(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, s, linked = near_pairs(key, pdf)
        if linked is None:
            return pd.DataFrame({"a": [], "b": [], "cos6": []}).astype("int64")
        r, c = np.nonzero(linked)
        return pd.DataFrame({"a": left["id"].to_numpy()[r], "b": right["id"].to_numpy()[c], "cos6": np.rint(s[r, c] * 1e6).astype(np.int64)})

    # a block in which every pair is linked is one cluster; that takes the number of its links, not the links
    counted = sent.groupBy("block", "i", "j").applyInPandas(count, "block long, links long").groupBy("block").agg(F.sum("links").alias("links"))
    split = cut(loose.join(counted, "block").where(F.col("links") < F.col("n") * (F.col("n") - 1) / 2).select("block"))
    whole = state.join(loose.select("block"), "block").join(split, "block", "left_anti")
    some = one_cluster(whole)
    if split.isEmpty():
        return tight.unionByName(some)
    links = stored(sent.join(F.broadcast(split), "block").groupBy("block", "i", "j").applyInPandas(link, "a long, b long, cos6 long"), "links")
    flow = distributed_flow(links, opts, capped=False)
    rest = near.join(F.broadcast(split), "block").join(flow, "id").select("id", "cluster", "strength", F.col("block").alias("grp"), "closeness")
    return tight.unionByName(some).unionByName(rest)


def whole_members(placed: DataFrame, reps: DataFrame, threshold: float, opts: FlowOptions, dimension: int = 64) -> DataFrame:
    """(id, cluster, strength, grp, closeness) of every vector of the blocks, from all links within each block.

    The blocks give only the members: the links are taken from the vectors again, so neither the best ``k`` of a file nor the
    way the files were cut has a part in the flow. A block in which every pair is linked is one cluster, and its flow goes to
    the members by their sum of cosines (the stationary flow). ``closeness`` is the sum of a member's cosines with its block.
    """
    ids = placed.select(F.col("a").alias("id"), "block").unionByName(placed.select(F.col("b").alias("id"), "block")).distinct()
    rows = stored(reps.join(ids, "id").dropDuplicates(["id"]).select("id", "code", "block"), "sets")  # repeated rows remain in reps
    counted = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    large = cut(counted.where(F.col("n") * F.col("n") > opts.block_pairs).select("block"))
    some = not large.isEmpty()
    small = rows.join(F.broadcast(large), "block", "left_anti") if some else rows
    tasks = max(shuffle_width(rows), rows.count() // 20_000 + 1)
    local = small.withColumn("task", F.pmod(F.xxhash64("block"), F.lit(tasks))).groupBy("task").applyInPandas(
        _sets_task(threshold, dimension, opts), MEMBER_SCHEMA + ", closeness double"
    )
    return local.unionByName(_large_sets(rows.join(F.broadcast(large), "block"), threshold, dimension, opts)) if some else local


# -- the operator ---------------------------------------------------------------------------------
def blocks(links: DataFrame) -> DataFrame:
    """The links with the diagonal block each belongs to.

    A task of the index names the smallest id of each group it sees (``root``). Groups of different tasks
    that share a vector are the same block; only pairs of differing roots enter the component search.
    """
    seen = links.groupBy("a").agg(F.min("root").alias("m"), F.collect_set("root").alias("roots"))  # as many roots as files
    differing = seen.where("size(roots) > 1").select(F.explode("roots").alias("r"), "m").where("r <> m")
    joined = connected_components(differing, "r", "m")
    top = joined.select(F.col("node").alias("root"), "component")
    return salted_left_join(links, top, "root", F.col("a")).withColumn("block", F.coalesce("component", "root")).drop("component")


def cluster_members(placed: DataFrame, opts: FlowOptions = FlowOptions()) -> DataFrame:
    """(id, cluster, strength, grp) for every vector of the blocked links (as from :func:`blocks`)."""
    large = placed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > opts.block_rows).select("block")
    large = cut(large)  # at most the number of links over block_rows
    columns = ["a", "b", "cos6"]
    tasks = max(shuffle_width(placed), placed.count() // opts.task_rows + 1)
    if large.isEmpty():
        small = placed
    else:
        small = placed.join(F.broadcast(large), "block", "left_anti")
    local = (
        small.select(F.pmod(F.xxhash64("block"), F.lit(tasks)).alias("task"), *columns)
        .groupBy("task")
        .applyInPandas(_cluster_task(opts), MEMBER_SCHEMA)
    )
    if large.isEmpty():
        return local
    rest = placed.join(F.broadcast(large), "block", "left_semi")
    flow = cut(distributed_flow(rest.where("cos6 >= 0"), opts))  # star rows have no cosine; they only join
    return local.unionByName(joined_clusters(rest, flow))


def joined_clusters(links: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` (id, cluster, strength) with ``grp``: clusters joined by any link, named by their smallest id."""
    side = members.select("id", "cluster")
    across = (
        links.select("a", "b")
        .join(side.select(F.col("id").alias("a"), F.col("cluster").alias("ca")), "a")
        .join(side.select(F.col("id").alias("b"), F.col("cluster").alias("cb")), "b")
        .where("ca <> cb").select("ca", "cb")
    )
    top = connected_components(across, "ca", "cb").select(F.col("node").alias("cluster"), "component")
    joined = salted_left_join(members, top, "cluster", F.col("id"))
    return joined.select("id", "cluster", "strength", F.coalesce("component", "cluster").alias("grp"))


def copies(codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of exactly equal vectors: (id, n) a group with its smallest id, and (id, vector_idx) of all its members."""
    found = copy_groups_of(keyed_by(codes, "vector_idx"), "vector_idx")
    return found.where("rid = member").select(F.col("rid").alias("id"), "n"), found.select(F.col("rid").alias("id"), F.col("member").alias("vector_idx"))


@dataclass
class Clustering:
    """Markov clusters of the distinct vectors, the links behind them, and the copies."""

    placed: DataFrame
    members: DataFrame
    copy_groups: DataFrame
    copy_members: DataFrame

    def with_copies(self, labels: DataFrame, label: str, least: int) -> DataFrame:
        """(vector_idx, label) of all vectors whose label has at least ``least`` of them."""
        alone = self.copy_groups.join(labels, "id", "left_anti").select("id", F.col("id").alias(label))
        own = labels.select("id", label).unionByName(alone).join(self.copy_groups, "id", "left")
        sizes = own.groupBy(label).agg(F.sum(F.coalesce("n", F.lit(1))).alias("size")).where(F.col("size") >= least)
        kept = salted_left_join(own, sizes, label, F.col("id")).where("size IS NOT NULL")
        lone = kept.where("n IS NULL").select(F.col("id").alias("vector_idx"), label, "size")
        grouped = salted_left_join(self.copy_members, kept.where("n > 1").select("id", label, "size"), "id", F.col("vector_idx"))
        return lone.unionByName(grouped.where("size IS NOT NULL").select("vector_idx", label, "size"))


def markov_clusters(
    vector_entries: DataFrame, threshold: float = 0.85, k: int = 6,
    index: pix.IndexOptions = pix.IndexOptions(posts=3, file_rows=2048), flow: FlowOptions = FlowOptions(),
    whole: bool = False,
) -> Clustering:
    """Clusters the usable vectors of a table; with ``whole`` by all links within each block (:func:`whole_members`)."""
    codes = usable(without_conflicts(vector_entries), dimension=index.dimension)
    groups, members_of = copies(codes)
    reps = distinct_vectors(codes, members_of.where("vector_idx <> id").select("vector_idx"))
    placed = stored(blocks(stored(pix.neighbour_links(reps, threshold, k, index), "links")), "placed")
    found = whole_members(placed, reps, threshold, flow, index.dimension) if whole else cluster_members(placed, flow)
    members = stored(found, "members")
    return Clustering(placed, members, groups, members_of)


def describe(c: Clustering, typical: int = 3, label: str = "cluster", by: str = "strength", least: int = 2) -> DataFrame:
    """One row a ``label`` of at least ``least`` vectors: (label, size, typical): its most typical members, greatest ``by`` first.

    With ``grp`` and ``closeness`` (of :func:`whole_members`) these are the sets of linked vectors, and the members with the greatest
    sum of cosines with the distinct vectors of the set.
    """
    sized = c.with_copies(c.members.select("id", label), label, least).groupBy(label).agg(F.max("size").alias("size"))
    order = Window.partitionBy(label).orderBy(F.desc(F.round(by, 6)), "id")
    lone = c.copy_groups.join(c.members, "id", "left_anti").select("id", F.col("id").alias(label), F.lit(1.0).alias(by))
    ranked = c.members.select("id", label, by).unionByName(lone).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= typical)
    best = ranked.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "id"))), lambda x: x["id"]).alias("typical"))
    return sized.join(best, label)
