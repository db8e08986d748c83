import json
import random
from decimal import Decimal

import pytest

from ledgerloom.llm import components, copies, names, rankwalk


def _groups(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {(find(x), x) for x in parent if find(x) != x}


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_hash_to_min_equals_union_find(spark, shape):
    rng = random.Random(shape)
    pairs = {"chain": [(i, i + 1) for i in range(1, 150)], "star": [(7, i) for i in range(8, 300)] + [(1, 299)], "random": [(rng.randrange(1, 400), rng.randrange(1, 400)) for _ in range(250)]}[shape]
    pairs = [(min(p), max(p)) for p in pairs if p[0] != p[1]]
    df = spark.createDataFrame(pairs, "a long, b long").distinct()
    got = {(r["group_id"], r["id"]) for r in components.connected(df, hot=50).collect()}
    assert got == _groups(pairs)


def test_accepted_pairs(spark):
    rows = [(2, 1, " Confirmed\n"), (1, 2, "pending"), (3, 4, "APPLIED"), (4, 4, "applied"), (None, 5, "applied"), (5, None, "confirmed"), (6, 7, None), (6, 8, "unconfirmed"), (4, 3, "applied")]
    df = spark.createDataFrame(rows, "entity_id_a long, entity_id_b long, status string").selectExpr("*", "1 AS a", "2 AS group_id")
    assert {(r["a"], r["b"]) for r in components.accepted_pairs(df).collect()} == {(1, 2), (3, 4)}
    assert {(r["group_id"], r["entity_id"]) for r in components.entity_groups(df).collect()} == {(1, 2), (3, 4)}
    assert components.entity_groups(df.limit(0)).count() == 0


SAME = [
    ({"a": "L.L.C. Straße", "b": [1, {"c": None}]}, '{"b":[1.0,{"c":null}],"a":"llc STRASSE "}'),
    ({"a": "$1,234.50"}, '{"a": "1234.5"}'), ({"a": "1,110.06"}, '{"a":1110.06}'), ({"a": "−5"}, '{"a":"-5.00"}'), ({"a": "été"}, '{"a":"e\\u0301te\\u0301"}'),
    ({"a": "“CELL”"}, '{"a":"cell."}'), ({"a": "2013-02-12"}, '{"a":"2013 02 12"}'), ({"a": "ﬁne"}, '{"a":"FINE"}'), ({"a": ""}, '{"a":" - "}'), ({"a": "007"}, '{"a":7}'),
    ({"a": "1e3"}, '{"a":1000}'), ({"a": "1E3"}, '{"a":1e3}'), ({"a": "-2.50e-1"}, '{"a":-0.25}'), ({"a": "1e500"}, '{"a":10e499}'),
]
OTHER = [
    ({"a": "-5.00"}, {"a": "5.00"}), ({"a": "1.5"}, {"a": "15"}), ({"a": None}, {}), ({"a": None}, {"a": ""}), ({"a": True}, {"a": "true"}), ({"a": [1, 2]}, {"a": [2, 1]}), ({"a": "e"}, {"a": "é"}), ({"A": 1}, {"a": 1}), ({"a": "1" * 40}, {"a": "1" * 39 + "2"}), ({"a": "1." + "3" * 500}, {"a": "1." + "3" * 499 + "4"}),
]


def test_what_counts_as_a_copy(spark):
    for a, b in SAME:
        assert copies.canonical(a) == copies.canonical(json.loads(b, parse_float=Decimal)), (a, b)
    for a, b in OTHER:
        assert copies.canonical(a) != copies.canonical(b), (a, b)


def test_copies(spark):
    rows = [(5, '{"x":1,"y":"A b"}'), (3, '{"y":"ab","x":1}'), (9, '{"y":"AB!","x":"1"}'), (4, '{"x":2}'), (6, '{"x":'), (7, None), (8, ""), (None, '{"x":2}'), (11, '["' + "z" * 400_000 + '"]'), (12, ' [ "' + "Z" * 400_000 + '" ]')]
    df = spark.createDataFrame(rows, "ord long, raw_json string").selectExpr("*", "1 AS h", "2 AS c", "3 AS id", "4 AS k")
    assert {(r[0], r[1]) for r in copies.further_copies(df).collect()} == {(3, 5), (3, 9), (11, 12)}
    deep_ = [(1, '{"a":' * 9000 + '"X y"' + "}" * 9000), (2, '{"a":' * 9000 + '"xy"' + " }" * 9000)]
    assert [tuple(r) for r in copies.further_copies(spark.createDataFrame(deep_, "ord long, raw_json string")).collect()] == [(1, 2)]
    assert sorted(r["copies"] for r in copies.count_copies(copies.hash_records(df)).collect()) == [1, 2, 3]
    assert copies.further_copies(df.limit(0)).count() == 0


def test_names_read_alike():
    same = [
        ("person", "Dr. Vicky Kribubruvi", "Victoria N. Kribubruvi"), ("person", "HEPEZIGRO Hattie", "Harriet E. Hepezigro"), ("person", "Trastipltohi, Jaqueline", "Jacqueline Trast-iplothi CPA"),
        ("person", "D. Fidroketho", "Deborah Fidroketho"), ("person", "Bjoern Ploslu'Nupo", "Ploslu'Nuppo, Bjorn "), ("person", "Moharnmed Pamatrebi", "Mohammed Pamatrebi"), ("person", "Md. Kudrofure", "Mohammed B Kudrofure"),
        ("org", "Senior Support Services of Metropolitan Porbrimhorhan", "Metro Porbrimhorhan Senior Support Srvcs. Corp"), ("org", "Corbranpornel Water & Mgmt", "corbranpornél water management district (main office)"),
        ("person", "Dr.  Larry Thetritrife.", "Lawrnece Thetritrife"), ("person", "Frncisco Nusevoplo", "Paco Nusevoplo"), ("person", "Robert Li", "Li, Bob"), ("person", "Robert Wu", "Bobby Wu"),
        ("person", "Иван Петров", "ПЕТРОВ, Иван"), ("person", "José Diaz", "Jose Dias"), ("org", "Ромашка ООО", "ромашка, ооо"),
        ("org", "Int'l Welbelpanbrus Health Netwk & Co.", "International Welbelpanbrus Health Network Ltd"), ("org", "St. Treltimnimwel Workforce Instit.", "Saint Treltinnimwel Workforce Institute LLC"), ("org", "Canflellanzirn Childcare Co-op", "Canflellanzim Childcare Cooperative"),
    ]
    other = [
        ("person", "Beatriz Catremadro Jr.", "Beatriz Catremadro Sr."), ("person", "Katherine Boneku-Bu", "Jacqueline Boneku-Bu"), ("person", "James Luvithetri", "Kwame Luvithetri"),
        ("person", "Robert Li", "Robert Lu"), ("person", "Ann Lee", "Ann Lea"), ("person", "王伟", "王芳"),
        ("org", "First Horzelcantan Paving Contractors Post 47", "First Horzelcantan Paving Contractors Post 48"), ("org", "Metropolitan Brorcandrorkel Public Safety Foundation", "Brorcandrorkel Senior Support Services"),
        ("org", "North Dorzusluszor Youth Alliance", "South Dorzusluszor Youth Alliance"), ("org", "Gimsheltelcim Public Safety Foundation", "Gimsheltelcim Water Management District"),
    ]
    for kind, a, b in same:
        assert names.same_party(kind, names.sign(kind, a)[0], names.sign(kind, b)[0]), (a, b)
        assert set(names.sign(kind, a)[1]) & set(names.sign(kind, b)[1]), (a, b)
    for kind, a, b in other:
        assert not names.same_party(kind, names.sign(kind, a)[0], names.sign(kind, b)[0]), (a, b)


def _entities(spark, rows):
    full = [(i, t, n, None if n is None else "k", 1, c) for i, t, n, c in rows]
    return spark.createDataFrame(full, "entity_id long, entity_type string, canonical_name string, norm_key string, n_mentions long, is_intermediary_composite int")


def test_party_pairs(spark):
    rows = [
        (1, "person", "Victoria Kribubruvi", 0), (2, "person", "Vicky Kribubruvi", 0), (3, "person", "Victoria Kribubrvi", 0), (4, "person", "Yusuf Slolakrohu Jr.", 0), (5, "person", "Yusuf Slolakrohu Sr.", 0),
        (6, "person", "J. Luvithetri", 0), (7, "person", "James Luvithetri", 0), (8, "person", "Jacqueline Luvithetri", 0), (9, "org", "Arts Collective of South Dimluscimvel", 0), (10, "org", "South Dimluscimvel Arts Collective Co", 0),
        (11, "org", "South Dimluscimvel Arts Collective", 1), (12, "code", "V-1", 0), (13, "person", None, 0), (2, "person", "Vicky Kribubruvi", 0), (14, "person", "Yusuf Slolakrohu", 0),
    ]
    aliases = spark.createDataFrame([(7, "Jim Luvithetri"), (99, "Victoria Kribubruvi"), (1, None)], "entity_id long, raw_name string")
    got = {tuple(r) for r in names.party_pairs(_entities(spark, rows), aliases).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (9, 10)}
    more = [(21, "person", "T. Cugrupletro", 0), (22, "person", "CUGRUPLETRO  Ted", 0), (23, "person", "Theodore Cugrupletro", 0), (24, "person", "E. Savu", 0), (25, "person", "Edward Savu", 0), (26, "person", "Emily Savu", 0)]
    assert {tuple(r) for r in names.party_pairs(_entities(spark, more), aliases.limit(0)).collect()} == {(21, 22), (21, 23), (22, 23)}
    assert names.party_pairs(_entities(spark, rows).limit(0), aliases.limit(0)).count() == 0


def _walk(rows, damping=0.85, rounds=200):
    items = sorted({r[0] for r in rows})
    lists = {}
    for i, n, s in rows:
        lists.setdefault(n, {})[i] = s
    mass = {i: 1 / len(items) for i in items}
    for _ in range(rounds):
        new = {i: (1 - damping) / len(items) for i in items}
        for i in items:
            own = [x for x in lists.values() if i in x]
            for x in own:
                up = [j for j in x if x[j] > x[i]] or [i]
                for j in up:
                    new[j] += damping * mass[i] / len(own) / len(up)
        mass = new
    return mass


def test_rank_walk_equals_the_plain_chain(spark):
    rng = random.Random(4)
    rows = [(f"r{i}", n, float(rng.randrange(12)) * scale) for n, scale in (("dollars", 1e6), ("share", 0.01), ("days", 1.0)) for i in rng.sample(range(60), 40)]
    want = _walk(rows)
    got = rankwalk.rank_walk(spark.createDataFrame(rows, "item string, list string, score double"), tolerance=1e-9, most_rounds=120).collect()
    assert len(got) == len(want) and all(abs(r["mass"] - want[r["item"]]) < 1e-6 for r in got)
    assert [r["item"] for r in sorted(got, key=lambda r: r["position"])] == sorted(want, key=lambda i: (-round(want[i] * len(want), 6), i))
    assert sorted(r["position"] for r in got) == list(range(1, len(want) + 1))


def test_no_unit_dominates(spark):
    rows = [("a", "dollars", 1e9), ("b", "dollars", 2.0), ("c", "dollars", 1.0), ("b", "days", 9.0), ("a", "days", 1.0), ("c", "days", 2.0), ("b", "share", 0.9), ("a", "share", 0.1), ("c", "share", 0.2)]
    got = rankwalk.rank_walk(spark.createDataFrame(rows, "item string, list string, score double")).collect()
    assert min(got, key=lambda r: r["position"])["item"] == "b"


def test_score_lists_leave_out_what_is_no_score(spark):
    e = lambda i: json.dumps([{"locators": [{"source_group": "g", "native_id": i}]}])
    rows = [(1, "d", 5.0, None, "r1", e("x")), (1, "d", 5.0, None, "r1", e("x")), (2, "d", 9.0, 0.5, "r1", e("x")), (3, "d", float("nan"), 50.0, "r2", e("y")), (4, "d", -1.0, None, "r1", e("z")), (5, "d", 999999999.0, None, "r1", e("z")), (6, "d", 1.0, None, "r1", None), (7, "d", None, None, None, "no json"), (8, None, 3.0, None, "r1", e("y"))]
    df = spark.createDataFrame(rows, "lead_id long, detector_id string, score double, rank_score double, created_run string, evidence string")
    assert {tuple(r) for r in rankwalk.score_lists(df).collect()} == {("g::x", "score:d", 9.0), ("g::x", "rank:r1", 0.5), ("g::y", "rank:r2", 50.0)}
    assert rankwalk.rank_walk(rankwalk.score_lists(df.limit(0))).count() == 0
