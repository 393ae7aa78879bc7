"""Connected components of a graph given as edges.

Each round hooks every node to its smallest neighbour, shortens the chains of hooks twice by pointer jumping, and contracts
the graph, so even long paths shrink geometrically; the node maps of the rounds are composed at the end. Minima are combined before the
shuffle, and the relabelling joins salt hubs. Each round is written to shared storage, so a lost executor
costs at most one round. Once at most ``local_edges`` edges are left (counted), one task joins what remains; that changes no component.
Nothing but counts reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardlight.operators.skew import salted_left_join
from shardlight.runtime import cut


def _joined_locally(rest: DataFrame) -> DataFrame:
    """(node, up): the components of a bounded number of edges in one task."""
    kind = rest.schema["u"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, at = np.unique(np.r_[pdf["u"].to_numpy(), pdf["v"].to_numpy()], return_inverse=True)
        u, v = at[: len(pdf)], at[len(pdf) :]
        of = np.arange(len(nodes))
        while len(u):
            a, b = of[u], of[v]
            differ = a != b
            u, v, a, b = u[differ], v[differ], a[differ], b[differ]
            np.minimum.at(of, np.maximum(a, b), np.minimum(a, b))
            while (of[of] != of).any():
                of = of[of]
        return pd.DataFrame({"node": nodes, "up": nodes[of]})

    return rest.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, f"node {kind}, up {kind}")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", local_edges: int = 1_000_000) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Self links make their node a component of its own; null ends are ignored; repeated edges and
    either direction count alike. No edges give an empty result.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    rest = cut(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    hooks = []
    while True:
        if rest.count() <= local_edges:
            hooks.append(cut(_joined_locally(rest)))
            break
        ends = rest.unionByName(rest.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = cut(ends.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("up")))
        for _ in range(2):
            above = hook.where("node <> up").select(F.col("node").alias("up"), F.col("up").alias("top"))
            chained = hook.where("node <> up").join(above, "up", "left_semi")
            if chained.isEmpty():
                break
            jumped = salted_left_join(hook, above, "up", F.col("node"))
            hook = cut(jumped.select("node", F.coalesce("top", "up").alias("up")))
        hooks.append(hook)
        left = salted_left_join(rest, hook.select(F.col("node").alias("u"), F.col("up").alias("cu")), "u", F.col("v"))
        both = salted_left_join(left, hook.select(F.col("node").alias("v"), F.col("up").alias("cv")), "v", F.col("u"))
        rest = cut(both.select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).where("u <> v").distinct())
        if rest.isEmpty():
            break
    label = hooks.pop()
    while hooks:
        lower = hooks.pop()
        upper = label.select(F.col("node").alias("up"), F.col("up").alias("top"))
        label = salted_left_join(lower, upper, "up", F.col("node")).select("node", F.coalesce("top", "up").alias("up"))
    return label.select("node", F.col("up").alias("component"))
