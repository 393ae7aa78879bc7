"""Near-duplicate texts by b-bit MinHash.

A text is normalised (white space runs become one space, trimmed, lower case) and seen as the set of its
character n-grams (5 by default). ``bands * rows_per_band`` or more minima of random hash functions are taken;
groups of ``rows_per_band`` of them form the band keys that bring candidates together, and the lowest ``bits`` of
each are kept, packed, as the signature. Of two texts that share a band, the share of equal signature
parts m estimates the resemblance, corrected for chance collisions: (m - c) / (1 - c), c = 2 ** -bits.
Candidates whose estimate is within ``margin`` of the threshold or above are verified exactly on the sets.

Every record takes part: exact copies (after normalising) are collapsed to their smallest id first and
expanded at the end. Texts are read once for their hashes, band keys and signatures, which are written, and once more if they are
candidates. A band key that holds more than ``block_rows`` records, as a sample in proportion to the table tells, is cut into blocks whose
pairs are tasks of their own. No pair is dropped by a cap.

Null texts and texts shorter than ``least_chars`` are no cases. Repeated rows of an id count once (the earliest,
where they disagree). An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardlight.llm.vectors import copy_groups_of, keyed_by, without_conflicts
from shardlight.operators.components import connected_components
from shardlight.operators.skew import salted_left_join
from shardlight.runtime import cut, shuffle_width, stored

_SPACE = re.compile(r"\s+")


@dataclass(frozen=True)
class MinHashOptions:
    """``block_rows``: records a block of a band key should hold; a key with more is cut. ``seen``: how often a key of
    ``block_rows`` records comes in the sample on average. ``hot_keys``: most keys that are cut (the largest; others stay whole)."""

    threshold: float = 0.6
    chars: int = 5
    least_chars: int = 200
    bands: int = 20
    rows_per_band: int = 3
    minima: int = 128
    bits: int = 2
    margin: float = 0.16
    seen: int = 64
    hot_keys: int = 100_000
    block_rows: int = 20_000
    unit_rows: int = 500_000
    seed: int = 11


def normalise(text: str) -> str:
    return _SPACE.sub(" ", text).strip().lower()


def _mix32(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h


def _mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grams(texts: list[str], chars: int, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all character n-grams of the texts, one after the other, and where each text's begin.

    Every text must have at least ``chars`` characters. ``wide`` gives 64-bit hashes.
    """
    kind = np.uint64 if wide else np.uint32
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(kind)
    lengths = np.array([len(t) for t in texts], np.int64)
    n = len(points) - chars + 1
    factor = kind(0x9E3779B97F4A7C15 if wide else 0x9E3779B1)
    h = points[:n].copy()
    for d in range(1, chars):
        h *= factor
        h += points[d : d + n]
        if wide:
            h ^= h >> kind(29)
    h = _mix64(h) if wide else _mix32(h)
    ends = np.cumsum(lengths)
    inside = np.ones(n, bool)
    for d in range(1, chars):  # n-grams that run over the end of a text
        inside[(ends[:-1] - d)] = False
    starts = np.r_[0, np.cumsum(lengths - chars + 1)[:-1]]
    return h[inside], starts


def _hash_functions(opts: MinHashOptions) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(opts.seed)
    return (rng.integers(0, 2**32, opts.minima, dtype=np.uint32) | np.uint32(1)), rng.integers(0, 2**32, opts.minima, dtype=np.uint32)


def minima(texts: list[str], opts: MinHashOptions) -> np.ndarray:
    """MinHash values, one row a text. Works in slices that stay in the processor's cache."""
    mul, add = _hash_functions(opts)
    out = np.empty((len(texts), opts.minima), np.uint32)
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= 48_000):
            size += len(texts[hi])
            hi += 1
        h, starts = grams(texts[lo:hi], opts.chars)
        v = np.empty_like(h)
        for k in range(opts.minima):
            np.multiply(h, mul[k], out=v)
            v += add[k]
            out[lo:hi, k] = np.minimum.reduceat(v, starts)
        lo = hi
    return out


def band_keys(m: np.ndarray, opts: MinHashOptions) -> np.ndarray:
    """64-bit keys of the bands, one row a text."""
    m = m[:, : opts.bands * opts.rows_per_band].reshape(len(m), opts.bands, opts.rows_per_band).astype(np.uint64)
    h = np.broadcast_to(np.arange(opts.bands, dtype=np.uint64), m.shape[:2]).copy()
    for r in range(opts.rows_per_band):
        h = _mix64(h * np.uint64(0x9E3779B97F4A7C15) + m[:, :, r])
    return h


def signatures(m: np.ndarray, opts: MinHashOptions) -> np.ndarray:
    """The lowest bits of the minima, packed into 64-bit words, bit planes one after the other."""
    low = (m >> np.uint32(7)) & np.uint32(2**opts.bits - 1)
    planes = [(low >> np.uint32(b)) & np.uint32(1) for b in range(opts.bits)]
    width = -(-opts.minima // 64) * 64
    bits = np.zeros((len(m), opts.bits * width), np.uint8)
    for b, plane in enumerate(planes):
        bits[:, b * width : b * width + opts.minima] = plane
    return np.packbits(bits, axis=1).view(np.uint64)


def estimated(a: np.ndarray, b: np.ndarray, opts: MinHashOptions) -> np.ndarray:
    """Collision-corrected resemblance of signature rows."""
    differing = a ^ b
    words = differing.shape[1] // opts.bits
    any_bit = differing[:, :words].copy()
    for p in range(1, opts.bits):
        any_bit |= differing[:, p * words : (p + 1) * words]
    equal = 1 - np.bitwise_count(any_bit).sum(1, dtype=np.int64) / opts.minima
    chance = 2.0**-opts.bits
    return (equal - chance) / (1 - chance)


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays without repeats."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


# -- candidates -----------------------------------------------------------------------------------
def _pairs_of_runs(keys: np.ndarray, ids: np.ndarray, sig: np.ndarray, side: np.ndarray | None, opts: MinHashOptions):
    """Candidate pairs among rows of equal key (of different side, if sides are given)."""
    order = np.argsort(keys, kind="stable")
    keys, ids, sig = keys[order], ids[order], sig[order]
    side = side[order] if side is not None else None
    n = len(keys)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    last = np.r_[np.flatnonzero(keys[1:] != keys[:-1]), n - 1]
    end = last[np.searchsorted(last, np.arange(n))]
    at = np.flatnonzero(end > np.arange(n))
    out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    d = 1
    while len(at):
        a, b = at, at + d
        ok = (ids[a] != ids[b]) & (estimated(sig[a], sig[b], opts) >= opts.threshold - opts.margin)
        if side is not None:
            ok &= side[a] != side[b]
        out_a.append(np.minimum(ids[a[ok]], ids[b[ok]]))
        out_b.append(np.maximum(ids[a[ok]], ids[b[ok]]))
        d += 1
        at = at[end[at] >= at + d]
    return np.concatenate(out_a), np.concatenate(out_b)


def _packed(keys: np.ndarray, ids: np.ndarray, sig: np.ndarray) -> bytes:
    head = np.array([len(keys), sig.shape[1]], np.int64).tobytes()
    return head + keys.tobytes() + ids.tobytes() + np.ascontiguousarray(sig.T).tobytes()


def _unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = []
    for b in blobs:
        n, words = np.frombuffer(b, np.int64, 2)
        keys = np.frombuffer(b, np.uint64, n, 16)
        ids = np.frombuffer(b, np.int64, n, 16 + 8 * n)
        parts.append((keys, ids, np.frombuffer(b, np.uint64, n * words, 16 + 16 * n).reshape(words, n).T))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _keys_of(column: pa.Array, opts: MinHashOptions) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, opts.bands)


def hot_bands(signed: DataFrame, opts: MinHashOptions) -> dict[int, int]:
    """Band keys with more than ``block_rows`` records, and the number of blocks each is cut into.

    The sample grows with the table, so it is a size, not a share, that makes a key hot.
    """
    part = min(1.0, opts.seen / opts.block_rows)
    shown = signed.where(F.pmod(F.xxhash64(F.lit(3), "rid"), F.lit(1_000_000)) < int(1_000_000 * part) + 1)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_keys_of(batch.column(0), opts).ravel().view(np.int64))], names=["k"])

    counted = shown.select("keys").mapInArrow(keys, "k long").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.where(F.col("n") > part * opts.block_rows).orderBy(F.desc("n"), "k").limit(opts.hot_keys).collect()
    return {int(np.int64(r["k"]).view(np.uint64)): int(np.ceil(r["n"] / part / opts.block_rows)) for r in rows}


def candidates(signed: DataFrame, opts: MinHashOptions) -> DataFrame:
    """(a, b): hashed ids of records that share a band and whose signatures are close enough.

    ``signed`` has (rid, keys, sig) of distinct texts, as from :func:`signed_records`; the hashed id is xxhash64(rid), signed.
    Records of different kinds (the first character of ``rid``) never meet.
    """
    records = signed
    rows = records.count()
    if rows < 2:
        return records.sparkSession.createDataFrame([], "a long, b long")
    hot = hot_bands(signed, opts)
    hot_keys = np.array(sorted(hot), np.uint64)
    hot_blocks = [hot[int(k)] for k in hot_keys]
    first_hot = np.r_[0, np.cumsum([n * n for n in hot_blocks])].astype(np.int64)
    units = max(2 * shuffle_width(records), rows * opts.bands // opts.unit_rows + 1)

    def spread(ids, keys, sig):
        flat = keys.ravel()
        who = np.repeat(np.arange(len(ids)), opts.bands)
        unit, blobs = [], []

        def emit(u, sel):
            unit.append(int(u))
            blobs.append(_packed(flat[sel], ids[who[sel]], sig[who[sel]]))

        is_hot = np.isin(flat, hot_keys) if len(hot_keys) else np.zeros(len(flat), bool)
        cold = np.flatnonzero(~is_hot)
        u = (flat[cold] >> np.uint64(20)) % np.uint64(units)
        order = np.argsort(u, kind="stable")
        cold, u = cold[order], u[order]
        for part in np.split(np.arange(len(cold)), np.flatnonzero(u[1:] != u[:-1]) + 1):
            if len(part):
                emit(u[part[0]], cold[part])
        for h, key in enumerate(hot_keys):
            sel = np.flatnonzero(flat == key)
            block = (_mix64(ids[who[sel]].view(np.uint64)) % np.uint64(hot_blocks[h])).astype(np.int64)
            for b in np.unique(block):
                for other in range(hot_blocks[h]):
                    i, j = min(b, other), max(b, other)
                    emit(-1 - 2 * (first_hot[h] + i * hot_blocks[h] + j) - (1 if b > other else 0), sel[block == b])
        return pa.RecordBatch.from_arrays([pa.array(unit, pa.int64()), pa.array(blobs, pa.binary())], names=["unit", "blob"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["unit"].iat[0] >= 0:
            a, b = _pairs_of_runs(*_unpacked(pdf["blob"].tolist()), None, opts)
        else:  # blocks of a hot key: unit numbers 2m and 2m + 1 hold the two blocks of a pair
            sides = [pdf["blob"][(-1 - pdf["unit"]) % 2 == s].tolist() for s in (0, 1)]
            loaded = [_unpacked(s) for s in sides if s]
            keys, ids, sig = (np.concatenate(c) for c in zip(*loaded, strict=True))
            index = int(-1 - pdf["unit"].iat[0]) // 2
            h = int(np.searchsorted(first_hot, index, "right")) - 1
            i, j = divmod(index - int(first_hot[h]), hot_blocks[h])
            if i != j and len(loaded) < 2:
                return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
            side = None if i == j else np.repeat([0, 1], [len(loaded[0][0]), len(loaded[1][0])])
            a, b = _pairs_of_runs(keys, ids, sig, side, opts)
        return pd.DataFrame({"a": a, "b": b}).drop_duplicates()

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _joined(batches, 40_000):
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            yield spread(batch.column(0).to_numpy(), _keys_of(batch.column(1), opts), sig)

    posted = records.select(F.xxhash64("rid").alias("h"), "keys", "sig").mapInArrow(post, "unit long, blob binary")
    # both blocks of a pair of blocks go to one group
    group = F.when(F.col("unit") >= 0, F.col("unit")).otherwise(-1 - F.shiftright(-1 - F.col("unit"), 1))
    met = posted.withColumn("grp", group).groupBy("grp").applyInPandas(lambda pdf: meet(pdf), "a long, b long")
    return met.distinct()


def _joined(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches put together to about ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def signed_records(records: DataFrame, opts: MinHashOptions) -> DataFrame:
    """(rid, code, keys, sig) of every record with a text: a 128-bit hash of the normalised text and, if it is long enough, its band
    keys and signature; else they are null. One pass over the texts."""
    least = max(opts.least_chars, opts.chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            at = [i for i, (_, t) in enumerate(held) if len(t) >= least]
            keys, sig = [None] * len(held), [None] * len(held)
            if at:
                m = minima([held[i][1] for i in at], opts)
                kinds = np.array([ord(held[i][0][0]) for i in at], np.uint64)
                own = _mix64(band_keys(m, opts) + kinds[:, None] * np.uint64(0x2545F4914F6CDD1D))
                for i, k, g in zip(at, own, signatures(m, opts), strict=True):
                    keys[i], sig[i] = k.tobytes(), g.tobytes()
            codes = [hashlib.blake2b((r[0] + t).encode("utf-8", "surrogatepass"), digest_size=16).digest() for r, t in held]
            columns = [pa.array([r for r, _ in held], pa.string()), *(pa.array(c, pa.binary()) for c in (codes, keys, sig))]
            return pa.RecordBatch.from_arrays(columns, names=["rid", "code", "keys", "sig"])

        for batch in batches:
            for rid, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((rid, normalise(text)))
                size += len(text)
                if size > 8_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    some = records.where("rid <> '' AND text IS NOT NULL").select("rid", "text")
    return some.mapInArrow(run, "rid string, code binary, keys binary, sig binary")


# -- verification ---------------------------------------------------------------------------------
def verified(pairs: DataFrame, records: DataFrame, opts: MinHashOptions, bound: int = 2_000_000) -> DataFrame:
    """(rid_a, rid_b, similarity) of the candidate pairs whose sets reach the threshold.

    Only texts of candidates travel: up to ``bound`` candidate ids (16 MB) are broadcast to filter the
    scan; beyond that the join alone does it.
    """
    pairs = cut(pairs)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    texts = records.select(F.xxhash64("rid").alias("h"), "rid", "text")
    texts = stored(texts.join(F.broadcast(ids) if ids.count() <= bound else ids, "h", "left_semi"), "texts")
    side = lambda s: texts.select(F.col("h").alias(s), F.col("rid").alias(f"rid_{s}"), F.col("text").alias(f"text_{s}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("rid_a", "text_a", "rid_b", "text_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] = {}

        def gram_set(rid: str, text: str) -> np.ndarray:
            if rid not in kept:
                if len(kept) > 64:
                    kept.clear()
                kept[rid] = np.unique(grams([normalise(text)], opts.chars, wide=True)[0])
            return kept[rid]

        for batch in batches:
            out = []
            for ra, ta, rb, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ra == rb or ra[0] != rb[0]:
                    continue
                j = resemblance(gram_set(ra, ta), gram_set(rb, tb))
                if j >= opts.threshold:
                    out.append((min(ra, rb), max(ra, rb), j))
            cols = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())],
                names=["rid_a", "rid_b", "similarity"],
            )

    return joined.mapInArrow(check, "rid_a string, rid_b string, similarity double")


# -- the operator ---------------------------------------------------------------------------------
@dataclass
class NearDuplicates:
    """Links between records of different text, and the copies: (rid, member, n) of groups of equal text."""

    links: DataFrame
    copies: DataFrame
    records: DataFrame

    def pairs(self, bound: int = 1000) -> DataFrame:
        """All pairs (rid_a, rid_b), copies expanded.

        A group of more than ``bound`` copies stays in its compact exact form: each copy paired with the first of
        the group, and the first with the group's partners.
        """
        few = self.copies.where(F.col("n") <= bound).select("rid", "member")
        wide = self.links.select("rid_a", "rid_b")
        for side, other in (("rid_a", "rid_b"), ("rid_b", "rid_a")):
            wide = wide.join(few.select(F.col("rid").alias(side), "member"), side, "left").select(
                F.coalesce("member", side).alias(side), other
            )
        within = few.join(few.withColumnRenamed("member", "other"), "rid").where("member < other").select(
            F.col("member").alias("rid_a"), F.col("other").alias("rid_b")
        )
        large = self.copies.where((F.col("n") > bound) & (F.col("member") != F.col("rid"))).select(F.col("rid").alias("rid_a"), F.col("member").alias("rid_b"))
        every = wide.select("rid_a", "rid_b").unionByName(within).unionByName(large)
        return every.select(F.least("rid_a", "rid_b").alias("rid_a"), F.greatest("rid_a", "rid_b").alias("rid_b"))

    def classes(self) -> DataFrame:
        """(rid, class_id, links) of every record that has a near duplicate or copy; copies share a class and count as links,
        a record's own and those of its partners: ``links`` is the number of records it makes a pair with.
        """
        partners = self.links.select(F.col("rid_a").alias("rid"), F.col("rid_b").alias("other")).unionByName(
            self.links.select(F.col("rid_b").alias("rid"), F.col("rid_a").alias("other"))
        )
        held = self.copies.where("member = rid").select(F.col("rid").alias("other"), "n")
        ends = salted_left_join(partners, held, "other", F.col("rid")).groupBy("rid").agg(F.sum(F.coalesce("n", F.lit(1))).alias("near"))
        label = connected_components(self.links, "rid_a", "rid_b").select(F.col("node").alias("rid"), "component")
        sizes = self.copies.select("rid", "n").distinct()
        first = label.join(ends, "rid").join(sizes, "rid", "full").select(
            "rid", F.coalesce("component", "rid").alias("class_id"), (F.coalesce("near", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).alias("links")
        )
        members = self.copies.where("member <> rid").select("rid", "member").join(first, "rid").select(F.col("member").alias("rid"), "class_id", "links")
        return first.unionByName(members)


def near_duplicates(records: DataFrame, opts: MinHashOptions = MinHashOptions(), arrival: str = "arrived") -> NearDuplicates:
    """Near duplicates among (rid, text); the first character of ``rid`` is the kind, and only equal kinds meet."""
    signed = stored(signed_records(records, opts), "signed")
    clash = signed.groupBy("rid").agg(F.min("code").alias("a"), F.max("code").alias("b")).where("a <> b")
    if not clash.isEmpty():
        records = without_conflicts(records.where("rid IS NOT NULL AND text IS NOT NULL"), "rid", "text", arrival)
        signed = stored(signed_records(records, opts), "signed")
    long = signed.where("keys IS NOT NULL")
    copies = copy_groups_of(keyed_by(long.select("rid", "code"), "rid"), "rid")
    spare = copies.where("member <> rid").select(F.col("member").alias("rid"))
    few = spare.count() <= 500_000
    distinct = long.select("rid", "keys", "sig").join(F.broadcast(spare) if few else spare, "rid", "left_anti")
    links = verified(candidates(distinct, opts), records, opts).distinct()
    return NearDuplicates(cut(links), copies, records)
