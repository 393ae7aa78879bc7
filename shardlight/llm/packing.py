"""Filling containers of fixed capacity with items by bounded-space online best fit.

Items are spread over independent packers by a hash of their id and come to each in the order of that hash. A packer keeps a
fixed number of open containers in a bitset keyed by free space: the lowest bit at or above an item's size
is the best fit, and the lowest bit of all is the fullest container, which closes when a new one has to be opened.
The number of packers follows the total size, so that the containers still open at the end are a small part of each
packer's, and no packer holds more than a bounded size.

An item above the capacity is the only kind that is split: into full containers and one rest, which is packed like an item.
Items without tokens (null or empty text) take no space but are placed. Capacities that are null or below 1 are
ignored; with equal kinds the smallest capacity counts. Repeated rows are items of their own. The result depends on
the rows alone, so a task that runs again packs the same.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PackOptions:
    """``open_containers``: open at a time in a packer. ``containers_a_packer``: about that many containers each."""

    open_containers: int = 64
    containers_a_packer: int = 4000


def best_fit(sizes: list[int], capacity: int, open_containers: int) -> tuple[list[int], list[int]]:
    """Container number of each item (no item above the capacity), and the free space of each container."""
    placed, free = [], []
    held: dict[int, list[int]] = {}  # free space -> open containers
    bits, n_open = 0, 0
    for size in sizes:
        above = bits >> size
        if above:
            space = size + (above & -above).bit_length() - 1
            box = held[space].pop()
            if not held[space]:
                bits ^= 1 << space
        else:
            if n_open == open_containers:
                fullest = (bits & -bits).bit_length() - 1
                held[fullest].pop()
                if not held[fullest]:
                    bits ^= 1 << fullest
                n_open -= 1
            box, space = len(free), capacity
            free.append(capacity)
            n_open += 1
        space -= size
        free[box] = space
        placed.append(box)
        if space:
            held.setdefault(space, []).append(box)
            bits |= 1 << space
        else:
            n_open -= 1
    return placed, free


def pack(items: DataFrame, capacities: list[tuple[str, int]], opts: PackOptions = PackOptions(), key: str = "doc_id") -> DataFrame:
    """Rows (container_kind, container_id, key, piece, start_token, tokens, unused): every piece of every item.

    ``items`` has the key and ``tokens``. ``unused`` is the free space of the piece's container.
    """
    kinds: dict[str, int] = {}
    for kind, capacity in capacities:
        if kind is not None and capacity is not None and capacity >= 1:
            kinds[kind] = min(capacity, kinds.get(kind, capacity))
    key_type = items.schema[key].dataType.simpleString()
    schema = f"container_kind string, container_id long, `{key}` {key_type}, piece int, start_token long, tokens long, unused long"
    if not kinds:
        return items.sparkSession.createDataFrame([], schema)
    total = items.agg(F.sum("tokens")).first()[0] or 0
    packers = {k: max(1, total // (c * opts.containers_a_packer)) for k, c in kinds.items()}
    spread = F.xxhash64(F.col(key).cast("string"))
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(packers[k]).cast("long").alias("packers")) for k in sorted(kinds)]))
    placed = items.select(key, "tokens", spread.alias("_h"), wanted.alias("_w")).select(
        key, "tokens", "_h", F.col("_w.kind").alias("kind"), F.pmod("_h", "_w.packers").alias("packer")
    )

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kind, packer = group
        capacity = kinds[kind]
        pdf = pdf.sort_values(["_h", key, "tokens"], kind="stable", ignore_index=True)
        sizes = pdf["tokens"].to_numpy(np.int64)
        whole = np.where(sizes > capacity, (sizes - 1) // capacity, 0)  # full pieces of an oversize item before its rest
        row = np.repeat(np.arange(len(pdf)), whole + 1)
        piece = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(whole + 1)[:-1]], whole + 1)
        last = piece == whole[row]
        size = np.where(last, sizes[row] - whole[row] * capacity, capacity)
        box, free = best_fit(size[last].tolist(), capacity, opts.open_containers)
        number = np.empty(len(row), np.int64)
        number[last] = box
        number[~last] = len(free) + np.arange((~last).sum())
        unused = np.zeros(len(row), np.int64)
        unused[last] = np.array(free, np.int64)[np.array(box, np.int64)]
        return pd.DataFrame({
            "container_kind": kind, "container_id": (np.int64(packer) << 32) + number, key: pdf[key].to_numpy()[row], "piece": piece.astype(np.int32),
            "start_token": piece * capacity, "tokens": size, "unused": unused,
        })

    return placed.groupBy("kind", "packer").applyInPandas(run, schema)


def containers(packed: DataFrame) -> DataFrame:
    """One row a container: pieces in it, used and unused tokens."""
    return packed.groupBy("container_kind", "container_id").agg(
        F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("used"), F.max("unused").alias("unused")
    )


def report(packed: DataFrame) -> DataFrame:
    """One row a kind: containers, pieces, used and unused tokens and the share of space used."""
    one = containers(packed).groupBy("container_kind").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.sum("used").alias("used_tokens"), F.sum("unused").alias("unused_tokens")
    )
    return one.withColumn("fill", F.round(F.col("used_tokens") / (F.col("used_tokens") + F.col("unused_tokens")), 6))
