import json

from ledgerloom.operators.drift import _last_name, renamed_path, unified, unified_table


def _df(spark, files):
    rows = [(name, json.dumps(r)) for name, records in files.items() for r in records]
    return spark.createDataFrame([(i, f".{n.rpartition('.')[2]}::{n.partition('/')[0]}/#", n, r) for i, (n, r) in enumerate(rows)], "ord long, source_group string, source_file string, raw_json string")


def test_xml_files_are_in_the_one_table(spark):
    files = {"d/1.jsonl": [{"id": "a"}] * 3, "v/1.xml": [{"VENDOR": {"reg_no": "7", "officers": [{"name": "Ann"}, {"name": "Bob"}]}}], "d/2.XML": [{"id": "x"}]}
    got = {(r["source_file"], r["field"], r["row"], r["text"]) for r in unified(_df(spark, files)).collect()}
    assert got == {("d/1.jsonl", "id", "", "a"), ("v/1.xml", "VENDOR.reg_no", "", "7"), ("v/1.xml", "VENDOR.officers[].name", "0", "Ann"), ("v/1.xml", "VENDOR.officers[].name", "1", "Bob"), ("d/2.XML", "id", "", "x")}


def test_fields_of_renamed_objects_and_lists_share_one_name(spark):
    old = [{"id": f"R-{i}", "program": {"title": f"Arts {i}", "code": f"A{i}"}, "amendments": [{"on": "2020-01-02", "delta": i}, {"on": "2020-02-03", "delta": 1}]} for i in range(8)]
    new = [{"id": f"R-{i}", "programme": {"title": f"Arts {i}", "code": f"A{i}"}, "changes": [{"on": "2020-01-02", "delta": i}, {"on": "2020-02-03", "delta": 1}]} for i in range(8)]
    last = [{"id": f"R-{i}", "programme": {"headline": f"Arts {i}", "code": f"A{i}"}, "changes": [{"on": "2020-01-02", "delta": i}, {"on": "2020-02-03", "delta": 1}]} for i in range(8)]
    rows = unified(_df(spark, {"d/1.jsonl": old, "d/2.jsonl": new, "d/3.jsonl": last, "e/1.jsonl": old})).collect()
    n = {}
    for r in rows:
        n[r["source_file"][0], r["field"]] = n.get((r["source_file"][0], r["field"]), 0) + 1
    assert {k: v for k, v in n.items() if k[0] == "d"} == {("d", "id"): 24, ("d", "programme.headline"): 24, ("d", "programme.code"): 24, ("d", "changes[].on"): 48, ("d", "changes[].delta"): 48}
    assert {k[1] for k in n if k[0] == "e"} == {"id", "program.title", "program.code", "amendments[].on", "amendments[].delta"}


def test_prefixes_are_whole_names_and_cycles_end(spark):
    rows = [("a.x", [("a", "b.a"), ("b", "c")], "c.a.x"), ("ab.x", [("a", "z")], "ab.x"), ("a", [("a", "b"), ("b", "a")], "a"), ("a[].x", [("a[]", "l[]")], "l[].x"), ("a.b.c", [("a", "p"), ("a.b", "q")], "q.c"), ("k", None, "k")]
    entries = [(p, None if a is None else sorted((-len(x), x, y) for x, y in a), w) for p, a, w in rows]
    df = spark.createDataFrame(entries, "path string, aliases array<struct<order:int,name:string,canonical:string>>, want string")
    assert all(renamed_path(p, sorted(a, key=lambda x: -len(x[0]))) == w for p, a, w in rows if a)
    assert all(r["got"] == r["want"] for r in df.withColumn("got", _last_name(df["path"], df["aliases"])).collect())


def test_one_typed_column_per_field(spark):
    old = [{"id": f"R-{i}", "who": f"Ann Bo{'abcdefgh'[i % 8]}e", "n": i, "ok": True, "to": {"zip": f"{i}"}} for i in range(8)]
    new = [{"id": f"R-{i}", "name_of": f"Ann Bo{'abcdefgh'[i % 8]}e", "n": f"${i},000", "ok": "N" if i else "maybe", "to": {"zip": f"{i}"}} for i in range(7)]
    rows = unified_table(_df(spark, {"d/1.jsonl": old, "d/2.jsonl": new, "v/1.xml": [{"VENDOR": {"@rev": "2"}}]}))
    assert rows.columns == ["ord", "source_group", "source_file", "VENDOR_rev", "id", "n", "name_of", "ok", "to_zip", "uncast"]
    assert dict(rows.dtypes)["n"] == "double" and dict(rows.dtypes)["ok"] == "boolean" and dict(rows.dtypes)["to_zip"] == "string"
    got = rows.orderBy("ord").collect()
    assert len(got) == 16 and all(r["name_of"] for r in got[:15]) and [r["n"] for r in got[8:10]] == [0.0, 1000.0] and got[15]["VENDOR_rev"] == "2"
    assert json.loads(got[8]["uncast"]) == {"ok": "maybe"} and got[8]["ok"] is None and got[9]["ok"] is False and got[0]["uncast"] == "{}"
    assert unified_table(_df(spark, {})).count() == 0


def test_texts_that_stand_where_objects_were_are_kept(spark):
    files = {"d/1.jsonl": [{"id": "a", "program": {"title": "Arts", "code": "A1"}}] * 5, "d/2.jsonl": [{"id": "b", "program": "Arts (A1)", "tags": ["x", "y"]}] * 2}
    rows = unified_table(_df(spark, files))
    assert {"program", "program_title", "program_code", "tags"} <= set(rows.columns)
    assert {(r["program"], r["program_title"], r["tags"]) for r in rows.collect()} == {(None, "Arts", None), ("Arts (A1)", None, '["x","y"]')}
