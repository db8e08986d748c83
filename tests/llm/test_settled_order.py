import random

import pytest

from ledgerloom.llm import rankwalk


def _settled(rows, damping=0.85, rounds=400):
    items = sorted({r[0] for r in rows})
    lists = {}
    for i, n, s in rows:
        lists.setdefault(n, {})[i] = s
    mass = dict.fromkeys(items, 1 / len(items))
    for _ in range(rounds):
        new = dict.fromkeys(items, (1 - damping) / len(items))
        for i in items:
            own = [x for x in lists.values() if i in x]
            for x in own:
                up = [j for j in x if x[j] > x[i]] or [i]
                for j in up:
                    new[j] += damping * mass[i] / len(own) / len(up)
        mass = new
    return mass


def _rows():
    rng = random.Random(11)
    return [(f"r{i}", n, float(rng.randrange(40)) * scale) for n, scale in (("dollars", 1e6), ("share", 0.01), ("days", 1.0), ("hops", 1.0)) for i in rng.sample(range(80), 50)]


def test_the_default_walk_ends_in_the_settled_order(spark):
    rows = _rows()
    want = _settled(rows)
    got = {r["item"]: r for r in rankwalk.rank_walk(spark.createDataFrame(rows, "item string, list string, score double")).collect()}
    assert set(got) == set(want) and all(abs(got[i]["mass"] / want[i] - 1) < 1e-7 for i in want)
    order = sorted(want, key=lambda i: got[i]["position"])
    assert all(want[a] > want[b] * (1 - 1e-7) for a, b in zip(order, order[1:]))


def test_an_order_that_is_not_settled_is_an_error(spark):
    with pytest.raises(RuntimeError):
        rankwalk.rank_walk(spark.createDataFrame(_rows(), "item string, list string, score double"), most_rounds=3)
