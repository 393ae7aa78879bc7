"""Number of links of near duplicates that have exact copies."""

import random
from collections import Counter

from shardlight.llm import minhash


def test_links_count_the_copies_of_partners(spark):
    rng = random.Random(4)
    words = [f"{w}{rng.randrange(900)}" for w in ("shard", "merge", "flush", "route", "index") * 16]
    near = lambda n: " ".join(["changed"] * n + words[n:])
    rows = [("d0", near(0))] + [(f"da{i}", near(1)) for i in range(7)] + [(f"db{i}", near(2)) for i in range(3)] + [("dz", "alone " * 60)]
    df = spark.createDataFrame([(r, t, None) for r, t in rows], "rid string, text string, arrived timestamp_ntz").repartition(3)
    found = minhash.near_duplicates(df)
    want = Counter(x for p in found.pairs().collect() for x in p)
    assert want["d0"] == 10 and want["da3"] == 10
    assert {r["rid"]: r["links"] for r in found.classes().collect()} == dict(want)
