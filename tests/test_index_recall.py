"""Recall of the centroid index over a whole query set, against brute force."""

import numpy as np

from shardlight.operators import index, search


def test_recall_over_a_query_set(spark):
    x = np.random.default_rng(5).normal(size=(400, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    queries = df.where("id % 20 = 0").selectExpr("id AS query_id", "v")
    built = index.build_centroid_index(df, "id", "v")
    exact = search.top_k_batch(df, queries, "id", "v", 10)
    curve = {r["probes"]: (r["recall"], r["hit_rate"]) for r in built.recall_curve(queries, exact.select("query_id", "id")).collect()}
    assert sorted(curve) == list(range(1, 21)) and curve[20] == (1.0, 1.0)
    truth = {(r["query_id"], r["id"]) for r in exact.collect()}
    placed = df.join(built.assignments, "id")
    for probes in (3, min(p for p in curve if curve[p][0] >= 0.9)):
        got = search.top_k_batch(placed, queries, "id", "v", 10, bucket="bucket_id", probed=built.mask(probes))
        cut = search.top_k_batch(placed, queries, "id", "v", 10, query_block=6, row_block=90, bucket="bucket_id", probed=built.mask(probes))
        assert sorted(cut.collect()) == sorted(got.collect())
        assert abs(len({(r["query_id"], r["id"]) for r in got.collect()} & truth) / len(truth) - curve[probes][0]) < 1e-6
        for q in (0, 20, 40):  # the same rows as the search of a single query
            own = df.join(built.candidates(x[q].tolist(), probes), "id", "left_semi")
            assert [r["id"] for r in search.top_k(own, "id", "v", x[q].tolist(), 10).collect()] == [r["id"] for r in got.where(f"query_id = {q}").orderBy("rank").collect()]
