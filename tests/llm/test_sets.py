"""Sets and clusters from all links: a tight set stays whole, whichever form its size takes."""

import numpy as np
import pytest

from shardlight.llm import markov
from shardlight.llm import permutation_index as pix
from test_vectors import table, truth, world


@pytest.mark.parametrize("block_pairs", [4096 * 4096, 400])
def test_whole_sets(spark, block_pairs):
    rows = world(3)
    _, sets, _ = truth(rows)
    c = markov.markov_clusters(table(spark, rows), index=pix.IndexOptions(pivots=12), flow=markov.FlowOptions(block_pairs=block_pairs), whole=True)
    got = {(r["vector_idx"], r["grp"]) for r in c.with_copies(c.members, "grp", 3).collect()}
    assert len(got & sets) / len(sets) >= 0.97 and len(got & sets) / len(got) >= 0.97
    assert {200, 40, 30} <= {r["size"] for r in markov.describe(c).collect()}
    x = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i is not None and i < 9000}
    for r in markov.describe(c, label="grp", by="closeness", least=3).collect():
        members = [i for i, g in got if g == r["grp"]]
        assert len(members) == r["size"]
        if r["size"] == 200:
            total = sum(x[i] for i in members)
            assert r["typical"] == sorted(members, key=lambda i: -x[i] @ total)[:3]
