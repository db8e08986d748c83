import json
import random

import pytest

from ledgerloom.functions import deep
from ledgerloom.operators import drift, profile, shred
from ledgerloom.sources import corpus


def _value(rng, depth=0):
    kind = rng.randrange(8 if depth < 5 else 6)
    if kind == 6:
        return [_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    if kind == 7:
        return {rng.choice('ab"é\\'): _value(rng, depth + 1) for _ in range(rng.randrange(4))}
    return [None, True, -12, 2.5e-7, 'q"\\\n é', ""][kind]


def test_own_parser_equals_the_library():
    rng = random.Random(3)
    for _ in range(300):
        v = _value(rng)
        for text in (json.dumps(v), json.dumps(v, indent=1, ensure_ascii=False)):
            assert deep._loads(text, float) == v
        cut = json.dumps(v)[: rng.randrange(1, 30)]
        try:
            want = json.loads(cut)
        except ValueError:
            with pytest.raises(ValueError):
                deep._loads(cut, float)
        else:
            assert deep._loads(cut, float) == want
    for bad in ("", "[1,]", '{"a":}', '{"a"}', "[1 2]", "{,}", "[}", "1 2", '{"a":1,}', "nul", "]", '{1:2}', "[,1]"):
        with pytest.raises(ValueError):
            deep._loads(bad, float)


def test_records_of_any_depth_give_their_rows(spark, tmp_path):
    n = 10_000
    nested = '{"a":' * n + "1" + "}" * n
    lists = '{"id":"x","l":[{"k":' + "[" * n + "]" * n + "}]}"
    assert deep.loads(lists)["id"] == "x" and deep.dumps(deep.loads(lists)) == lists and deep.dumps(deep.loads(nested), sort_keys=True) == nested
    df = spark.createDataFrame([(1, "g", "d/1.jsonl", nested), (2, "g", "d/1.jsonl", lists), (3, "g", "d/1.jsonl", nested[:-5])], "ord long, source_group string, source_file string, raw_json string")
    assert [tuple(r) for r in shred.child_objects(df).collect()] == [(2, "l[]", "0")]
    assert sorted(r["ord"] for r in shred.shred(df, values=False).select("ord").collect()) == [1, 2, 2]
    assert drift.catalogue(df, shred.find_repeating(df)).where("path = ''").first()["n"] == 2
    assert profile.flatten(df.select("source_group", "raw_json")).where("kind = 'integer'").count() == 1
    (tmp_path / "1.jsonl").write_text(lists + "\n" + nested)
    assert corpus.read_corpus(spark, str(tmp_path)).count() == 2
    assert corpus.hash_of_records(df).count() == 2
