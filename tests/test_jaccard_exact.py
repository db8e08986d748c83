import random

import pytest

from ledgerloom.operators import entities


@pytest.mark.parametrize("hot", [1_000, 5])
def test_pairs_of_common_tokens_are_found(spark, hot):
    rng = random.Random(5)
    words = ["harbor", "north", "clinic", "arts", "youth", "water", "trust", "supply", "house", "labor"]
    names = [" ".join(rng.sample(words, rng.randrange(1, 6))) for _ in range(240)]
    df = spark.createDataFrame([(i, rng.choice(["org", "person"]), n, "k", 3) for i, n in enumerate(names)], "entity_id long, entity_type string, canonical_name string, norm_key string, n_mentions long")
    kind = {r["entity_id"]: r["entity_type"] for r in df.collect()}
    sets = [set(n.split()) for n in names]
    want = {(i, j): round(len(sets[i] & sets[j]) / len(sets[i] | sets[j]), 3) for i in range(240) for j in range(i + 1, 240) if kind[i] == kind[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.6}
    rows = entities.all_token_candidates(df, hot=hot, salts=4).collect()
    assert {(r[0], r[1]): r["score"] for r in rows} == want and len(rows) == len(want)
    assert len(want) > entities.token_candidates(df).count()
