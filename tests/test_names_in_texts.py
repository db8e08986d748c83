"""Names that stand in texts: what is shuffled grows with what is found, and all of it is found."""

import json
import random

import pytest

from ledgerloom.operators import dossier


@pytest.fixture
def as_large(spark):
    """Nothing is broadcast for its size, as with large tables."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def _shuffled(spark):
    """Bytes that all tasks so far have shuffled."""
    spark.range(1).repartition(1).count()  # figures are brought up to date as tasks end
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    executors = sc.statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_names_that_begin_alike_are_not_paired_with_every_text(spark, as_large):
    n = 3000
    people = spark.createDataFrame([(i, f"South Harbour {i:05d} Trust") for i in range(n)], "entity_id long, canonical_name string")
    leads = spark.createDataFrame([(i, f"Files list SOUTH HARBOUR {i:05d} TRUST beside south hall") for i in range(n)], "lead_id long, claim string")
    before = _shuffled(spark)
    got = {tuple(r) for r in dossier.backlinks(leads, people).collect()}
    assert got == {(i, i) for i in range(n)}
    moved = _shuffled(spark) - before
    assert moved < 2_000_000  # every name with every text would be nine million rows


def test_names_quoted_in_evidence_are_not_paired_with_every_text(spark, as_large):
    n = 3000
    people = spark.createDataFrame([(i, f"South Harbour {i:05d} Trust") for i in range(n)], "entity_id long, canonical_name string")
    quoted = lambda i: json.dumps([{"values": {"payee": f"south harbour {i:05d} trust", "score": 71523.34}}, {"value": f"SOUTH HARBOUR {n - 1 - i:05d} TRUST"}])
    leads = spark.createDataFrame([(i, "Files list South Harbour", quoted(i)) for i in range(n)], "lead_id long, claim string, evidence string")
    before = _shuffled(spark)
    got = {tuple(r) for r in dossier.entity_scan(leads, people).collect()}
    assert got == {(i, j) for i in range(n) for j in (i, n - 1 - i)}
    assert _shuffled(spark) - before < 2_000_000


def test_every_name_is_found_wherever_it_stands(spark):
    pick = random.Random(5)
    word = lambda: "".join(pick.choice("abÀé日𝄞 1") for _ in range(pick.randint(1, 9)))
    names = [word() + word() for _ in range(400)] + ["Harbour Trust", "harbour trust", "Harbour", "bour ", "日本東京都", "é" * 40, "abcd", None, "", "71523.34"]
    texts = [word() + pick.choice(names[:400]).swapcase() + word() for _ in range(300)] + ["", None, "HARBOUR TRUST", "harbou", "x日本東京都", "日本東京", "é" * 39, "é" * 41]
    people = [(i, x) for i, x in enumerate(names)] + [(0, names[1]), (0, names[1]), (None, "Harbour Trust")]
    claims = [(i, x, None) for i, x in enumerate(texts)] + [(1, texts[0], None), (1, texts[1], None), (None, "a harbour", None), (900, None, '[{"values": {"score": 71523.34, "who": "THE HARBOUR TRUST"}}]')]
    entities = spark.createDataFrame(people, "entity_id long, canonical_name string")
    leads = spark.createDataFrame(claims, "lead_id long, claim string, evidence string")
    want = {(e, i) for e, x in people if x is not None and len(x) >= 5 for i, t, _ in claims if t is not None and x.lower() in t.lower()}
    got = [tuple(r) for r in dossier.backlinks(leads, entities).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    got = [tuple(r) for r in dossier.entity_scan(leads, entities).collect()]
    assert len(got) == len(set(got)) and set(got) == want | {(e, 900) for e, x in people if x in ("Harbour Trust", "harbour trust", "Harbour", "bour ", "71523.34")}
    assert dossier.entity_scan(leads, entities.where("entity_id < 0")).count() == 0


def test_a_text_longer_than_what_is_looked_at_in_one_go(spark):
    people = spark.createDataFrame([(i, f"Quay {i:05d} Trüst") for i in range(20_000)], "entity_id long, canonical_name string")
    leads = spark.createDataFrame([(1, "".join(f"QUAY {i:05d} TRÜST" for i in range(20_000)))], "lead_id long, claim string")
    assert {tuple(r) for r in dossier.backlinks(leads, people).collect()} == {(i, 1) for i in range(20_000)}


def test_pairs_are_not_shuffled_because_some_entity_has_several_rows(spark, as_large):
    n = 1000
    people = [(i, "South Harbour Trust") for i in range(n)] + [(0, "SOUTH HARBOUR TRUST"), (1, "South Harbour")]
    leads = [(i, "Files list South Harbour Trust", '[{"values": {"payee": "south harbour"}}]') for i in range(n)]
    entities = spark.createDataFrame(people, "entity_id long, canonical_name string")
    leads = spark.createDataFrame(leads, "lead_id long, claim string, evidence string")
    before = _shuffled(spark)
    pairs = dossier.entity_scan(leads, entities).toArrow()
    assert _shuffled(spark) - before < 500_000  # a million pairs come out
    got = set(zip(*(pairs[c].to_pylist() for c in ("entity_id", "lead_id"))))
    assert pairs.num_rows == n * n and got == {(e, i) for e in range(n) for i in range(n)}


def test_entities_of_several_rows_come_once_with_each_lead(spark):
    pick = random.Random(3)
    words = ["harbour trust", "harbour", "east quay", "quay house", "north pier"]
    rows = [(pick.choice([None, *range(40)]), pick.choice(words).title()) for _ in range(150)]
    rows += rows[:30] + [(e, x.upper()) for e, x in rows[30:60]]
    claims = [(pick.choice([None, *range(25)]), " ".join(pick.sample(words, pick.randint(0, 3))), json.dumps([{"value": pick.choice(words).upper()}])) for _ in range(60)]
    entities = spark.createDataFrame(rows, "entity_id long, canonical_name string")
    leads = spark.createDataFrame(claims, "lead_id long, claim string, evidence string")
    for scan, texts in ((dossier.backlinks, lambda t, v: [t]), (dossier.entity_scan, lambda t, v: [t, json.loads(v)[0]["value"]])):
        got = [tuple(r) for r in scan(leads, entities).collect()]
        want = {(e, i) for e, x in rows for i, t, v in claims if any(x.lower() in s.lower() for s in texts(t, v))}
        assert len(got) == len(set(got)) and set(got) == want
