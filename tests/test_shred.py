import json

from ledgerloom.operators.shred import child_objects, flat_table, shred

G = ".jsonl::g/#.jsonl"


def _df(spark, records):
    return spark.createDataFrame([(i, g, t if isinstance(t, (str, type(None))) else json.dumps(t)) for i, (g, t) in enumerate(records, 1)], "ord long, source_group string, raw_json string")


def _found(spark, records):
    return sorted((r["ord"], r["child_path"], r["elem_pos"]) for r in child_objects(_df(spark, records)).collect())


def test_every_carrier_counts_alike(spark):
    listed = {"c": [{"p": [{"k": 1}, {"k": 2}]}, None, 5, {"p": {"k": 3}}]}
    got = _found(spark, [(G, listed), (G, {"c": {"p": []}}), (G, {"c": {"1": {"p": None}, "0": {}}}), (G, {"c": json.dumps([{"p": json.dumps([{"k": 9}])}])}), (G, {"c": ""}), (G, {"c": [1, 2]}), (G, '{"c": [{"p": 1}')])
    assert got == [
        (1, "c[]", "0"), (1, "c[]", "3"), (1, "c[].p[]", "0.0"), (1, "c[].p[]", "0.1"), (1, "c[].p[]", "3.0"),
        (2, "c[]", "0"), (3, "c[]", "0"), (3, "c[]", "1"), (4, "c[]", "0"), (4, "c[].p[]", "0.0"),
    ]


def test_repeating_is_a_matter_of_the_group(spark):
    assert _found(spark, [("a", {"x": {"y": {"k": 1}}}), ("b", {"x": {"y": [{"k": 1}]}})]) == [(2, "x.y[]", "0")]


def test_nulls_empties_and_repeats(spark):
    assert _found(spark, []) == []
    assert _found(spark, [(G, None), (G, ""), (G, "7"), (None, {"c": [{}]}), (G, "[" * 5000)]) == []
    df = _df(spark, [(G, {"c": [{}]})])
    assert child_objects(df.union(df)).count() == 2


def test_tables_link_child_to_parent(spark):
    long = "x" * 300_000
    df = _df(spark, [(G, {"id": "1", "a": {"b": True}, "c": [{"name": long, "p": [{"n": 1.5, "tags": ["u", None]}]}]})])
    rows = {(r["child_path"], r["elem_pos"]): r for r in shred(df).collect()}
    assert set(rows) == {("", ""), ("c[]", "0"), ("c[].p[]", "0.0")}
    assert rows["", ""]["fields"] == {"id": "1", "a.b": "true"}
    assert (rows["c[].p[]", "0.0"]["parent_path"], rows["c[].p[]", "0.0"]["parent_pos"]) == ("c[]", "0")
    assert rows["c[].p[]", "0.0"]["fields"] == {"n": "1.5", "tags": '["u",null]'} and len(rows["c[]", "0"]["fields"]["name"]) == 300_000
    assert flat_table(shred(df), "c[].p[]", ["n", "absent"]).first().asDict() == {"ord": 1, "elem_pos": "0.0", "parent_path": "c[]", "parent_pos": "0", "n": "1.5", "absent": None}


def test_extra_columns_do_not_disturb(spark):
    df = _df(spark, [(G, {"c": [{}]})]).selectExpr("*", "1 AS paths", "2 AS g", "3 AS child_path", "4 AS _t")
    assert child_objects(df).count() == 1
