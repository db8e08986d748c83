import json

from ledgerloom.operators.drift import alias_table, changes, unified


def _df(spark, files):
    rows, i = [], 0
    for name, records in files.items():
        for r in records:
            i += 1
            rows.append((i, ".jsonl::d/#.jsonl", name, r if isinstance(r, (str, type(None))) else json.dumps(r)))
    return spark.createDataFrame(rows, "ord long, source_group string, source_file string, raw_json string")


def _changes(spark, files):
    return sorted((r["source_file"], r["change_kind"], r["field_path"], r["new_path"]) for r in changes(_df(spark, files)).collect())


def _people(n, key):
    return [{"id": f"R-{i}", key: f"Ann Bo{'abcdefgh'[i % 8]}e", "k": 1} for i in range(n)]


def test_added_removed_retyped_renamed(spark):
    files = {
        "d/1.jsonl": [{"id": "a", "n": 1, "who": "Ann Lee", "p": {"x": "u", "y": "v"}, "c": [{"role": "chair"}]}] * 5,
        "d/2.jsonl": [{"id": "b", "n": "2", "name_of": "Bob Ray", "p": "text", "c": {"position": "chair"}, "on": True}] * 5,
    }
    assert _changes(spark, files) == [
        ("d/2.jsonl", "added", "on", ""),
        ("d/2.jsonl", "renamed", "c[].role", "c[].position"),
        ("d/2.jsonl", "renamed", "who", "name_of"),
        ("d/2.jsonl", "retyped", "n", ""),
        ("d/2.jsonl", "retyped", "p", ""),
    ]


def test_fields_that_live_side_by_side_are_no_rename(spark):
    files = {"d/1.jsonl": [{"a": "Ann Lee", "k": 1}], "d/2.jsonl": [{"b": "Ann Lee", "k": 1}], "d/3.jsonl": [{"a": "Ann Lee", "b": "Ann Lee", "k": 1}]}
    kinds = {x[1] for x in _changes(spark, files)}
    assert "renamed" not in kinds and {"added", "removed"} == kinds


def test_moved_to_another_parent_and_back(spark):
    a, b = [{"id": "q", "district": i, "to": {"z": "w"}} for i in range(9)], [{"id": "q", "to": {"z": "w", "district": i}} for i in range(9)]
    assert _changes(spark, {"d/1.jsonl": a, "d/2.jsonl": b, "d/3.jsonl": a}) == [("d/2.jsonl", "renamed", "district", "to.district"), ("d/3.jsonl", "renamed", "to.district", "district")]


def test_carrier_is_no_change_and_empty_is_no_value(spark):
    files = {"d/1.jsonl": [{"c": [{"x": "1"}]}], "d/2.jsonl": [{"c": {"x": "1"}, "e": "", "f": None}], "d/3.jsonl": [{"c": json.dumps([{"x": "1"}])}], "d/4.jsonl": [{"c": {"0": {"x": "1"}}}]}
    assert _changes(spark, files) == []


def test_series_edges(spark):
    assert _changes(spark, {}) == []
    assert _changes(spark, {"d/1.jsonl": [{"a": 1}]}) == []
    assert _changes(spark, {"d/1.jsonl": [{"a": 1}], "d/2.xml": [{"b": 1}], "e/3.jsonl": [{"z": "t"}]}) == []
    assert _changes(spark, {"d/1.jsonl": [{"a": 1}], "d/2.jsonl": ['{"b":', None, "", "5"], "d/3.jsonl": [{"a": 2}]}) == []


def test_alias_chain_and_unified_table(spark):
    files = {"d/1.jsonl": _people(8, "a"), "d/2.jsonl": _people(8, "b"), "d/3.jsonl": _people(8, "c")}
    df = _df(spark, files)
    alias = {(r["name"], r["canonical"]) for r in alias_table(changes(df)).collect()}
    assert alias == {("a", "c"), ("b", "c")}
    rows = unified(df).collect()
    assert {r["field"] for r in rows} == {"id", "k", "c"} and sum(r["field"] == "c" for r in rows) == 24
    assert all(r["number"] == 1.0 for r in rows if r["field"] == "k")
