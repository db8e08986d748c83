import json
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import coerce, text
from ledgerloom.operators import detectors as D
from ledgerloom.operators import dossier, entities, mentions, normalise, profile, semantic, skew
from ledgerloom.plans import packs


def _col(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", f(F.col("v"))).orderBy("i").collect()]


def test_coercions(spark):
    assert _col(spark, coerce.to_money, ["$1,000", "12750.00", "", "abc", "true", "5d", "1_000", " 7.005 ", None, "1e3", "-$2.5", "1.005"]) == [1000.0, 12750.0, None, None, 1.0, None, 1000.0, pytest.approx(7.0, abs=0.011), None, 1000.0, -2.5, 1.0]
    assert _col(spark, coerce.to_int, ["1,234", "5.9", "-5.9", "x", "", None, "inf", "1e3"]) == [1234, 5, -5, None, None, None, None, 1000]
    assert [None if v is None else v.isoformat() for v in _col(spark, coerce.to_date, ["2024-01-02T03:04", "1/2/2024", "13/2/2024", "2024", "2024-02-30", "2024/3/4 x", "20240102", "", None])] == ["2024-01-02", "2024-01-02", "2024-02-13", None, None, "2024-03-04", "2024-01-02", None, None]
    assert _col(spark, coerce.to_datetime, ["2024-01-02T03:04", "2024-01-02 03:04:05Z", "1/2/2024", "x", None]) == ["2024-01-02T03:04:00", "2024-01-02T03:04:05+00:00", "2024-01-02", None, None]
    assert _col(spark, coerce.to_text, [" a ", "", "  ", None]) == ["a", None, None, None]


def test_names_and_paths(spark):
    assert _col(spark, text.norm_aggressive, ["ACME LLC", "Acme, L.L.C.", "The Acme Company", None]) == ["acme", "acme", "acme", None]
    assert _col(spark, text.norm_light, ["ACME L.L.C."]) == ["acmellc"]
    assert _col(spark, text.phrase_of_name, ["The Acme Corp. Inc", "The The Co", "Corporation", "A & B Co.", None, "Inc Works Ltd"]) == ["Acme", None, None, "A B", None, "Inc Works"]
    assert _col(spark, text.source_group, ["grants/2024/05-1.JSONL", "a.csv"]) == [".jsonl::grants/#/#-#.JSONL", ".csv::a.csv"]
    assert _col(spark, text.slug, ["Ärger & Café -- 12!", None, "a" * 99]) == ["rger-caf-12", "untitled", "a" * 60]
    assert [len(x) <= 89 for x in _col(spark, text.safe_id, ["https://x/y?z", "", "ok-1", "q" * 200])] == [True] * 4
    loc = spark.createDataFrame([(".json::a/b::id-7",)], "l string").select(*text.locator_parts(F.col("l"))).first()
    assert tuple(loc) == (".json::a/b", "id-7")


def _side(spark, rows, cols="k string, v double, g string"):
    return spark.createDataFrame([(*r, "grp", f"n{i}") for i, r in enumerate(rows)], cols + ", source_group string, native_id string")


def test_contradiction_and_gap(spark):
    left, right = _side(spark, [("a", 10.0, "x"), ("b", 10.0, "x"), (None, 1.0, "x"), ("c", None, "x"), ("d", 5.0, "x")]), _side(spark, [("a", 20.0, " X "), ("b", 10.5, "x"), (None, 99.0, "x"), ("c", 3.0, "x"), ("a", 30.0, "y")])
    hits = D.contradiction(left, right, [("k", "k")], "v", "v", 0.5)
    assert sorted(r["diff"] for r in hits.collect()) == [10.0, 20.0]
    assert D.contradiction(right, left, [("k", "k")], "v", "v", 0.5).count() == 2
    assert [r["r_v"] for r in D.contradiction(left, right, [("k", "k")], "v", "v", 0.5, [("g", "g")]).collect()] == [20.0]
    assert tuple(D.contradiction_report(left, right, [("k", "k")], "v", "v", [("g", "g")]).first()) == (4, 1, 1)
    missing = D.gap(left, right, [("k", "k")], score="v")
    assert {(r["k"], r["gap_score"]) for r in missing.collect()} == {(None, 1.0), ("d", 5.0)}
    semi = left.join(right.select("k").distinct(), "k", "left_semi").count()
    assert missing.count() + semi == left.count()
    assert D.gap(left.limit(0), right, [("k", "k")]).count() == 0 and D.gap(left, right.limit(0), [("k", "k")]).count() == 5


def test_outliers_ties_and_nulls(spark):
    df = _side(spark, [("a", 5.0, "x"), ("b", 5.0, "x"), ("c", None, "x"), ("d", 9.0, "y")])
    assert [r["k"] for r in D.outlier_top(df, "v", ["k"], 2).collect()] == ["d", "a"]
    assert D.outlier_top(df, "v", []).first()["total"] == 19.0
    many = _side(spark, [("q", float(i % 3), "x") for i in range(60)] + [("q", 100.0, "x")])
    assert [r["v"] for r in D.outlier_sigma(many, "v", ["g"]).collect()] == [100.0]
    assert tuple(D.grain(df, ["g"]).first()) == (4, 2, 2.0)


def test_intermediary_and_overlap(spark):
    names = spark.createDataFrame([("X Co on behalf of Y Inc", "g", "1"), ("A as fiscal sponsor for B", "g", "2"), ("plain", "g", "3"), (None, "g", "4"), ("X Co on behalf of  ", "g", "5")], "name string, source_group string, native_id string")
    got = {(r["intermediary"], r["principal"]) for r in D.intermediary(names, "name", [r"^(?P<intermediary>.+?)\s+on behalf of\s+(?P<principal>.+)$", r"^(?P<intermediary>.+?) as fiscal sponsor for (?P<principal>.+)$"]).collect()}
    assert got == {("X Co", "Y Inc"), ("A", "B")}
    l = spark.createDataFrame([("e", "2024-01-01"), ("e", "2024-03-01"), ("f", None)], "k string, d string").withColumn("d", F.to_date("d"))
    r = spark.createDataFrame([("e", "2024-01-31"), ("e", "2024-04-01"), ("f", "2024-01-01")], "k string, d string").withColumn("d", F.to_date("d"))
    assert sorted(x["days_apart"] for x in D.overlap(l, r, [("k", "k")], "d", "d", 30).collect()) == [30.0, 30.0]
    assert sorted(x["days_apart"] for x in D.overlap(l, r, [("k", "k")], "d", "d", 31).collect()) == [30.0, 30.0, 31.0]


def test_pack_run_is_repeatable_and_explains_skips(spark, tmp_path):
    left, right = _side(spark, [("a", 10.0, "x")]), _side(spark, [("a", 20.0, "x"), ("z", 1.0, "x")])
    pack = {"detectors": [
        {"id": "c", "template": "contradiction", "params": {"left": {"table": "l", "value_col": "v"}, "right": {"table": "r", "value_col": "v"}, "join_on": [["k", "k"]], "tolerance": 1, "label_cols": ["k"]}, "innocent_explanations": ["rounding"]},
        {"id": "g", "template": "gap", "params": {"left": {"table": "r"}, "right": {"table": "l"}, "join_on": [["k", "k"]]}, "innocent_explanations": ["late"]},
        {"id": "o", "template": "outlier", "params": {"table": "r", "value_col": "v", "group_cols": ["g"]}, "innocent_explanations": ["big"]},
        {"id": "all", "template": "outlier", "params": {"table": "r", "value_col": "v"}, "innocent_explanations": ["big"]},
        {"id": "s", "template": "outlier", "params": {"table": "r", "value_col": "v", "method": "sigma", "group_cols": ["g"]}, "innocent_explanations": ["big"]},
        {"id": "i", "template": "intermediary", "params": {"table": "r", "name_col": "k", "patterns": ["(?P<principal>z)"]}, "innocent_explanations": ["x"]},
        {"id": "bad1", "template": "gap", "params": {"left": {"table": "nope"}, "right": {"table": "l"}, "join_on": [["k", "k"]]}, "innocent_explanations": ["x"]},
        {"id": "bad2", "template": "outlier", "params": {"table": "r", "value_col": "v", "method": "magic"}, "innocent_explanations": ["x"]},
        {"id": "bad3", "template": "contradiction", "params": {"left": {"table": "l", "value_col": "g"}, "right": {"table": "r", "value_col": "v"}, "join_on": [["k", "k"]]}, "innocent_explanations": ["x"]},
    ]}
    (tmp_path / "d.json").write_text(json.dumps(pack))
    found = packs.load_detectors(tmp_path / "d.json")
    store = str(tmp_path / "leads")
    for _ in range(2):
        skipped = D.run_pack(spark, found, {"l": left, "r": right}, "run-1", store)
        assert sorted(s.split(":")[0] for s in skipped) == ["bad1", "bad2", "bad3"]
        leads = spark.read.parquet(store)
        assert {r["detector_id"]: r["count"] for r in leads.groupBy("detector_id").count().collect()} == {"c": 1, "g": 1, "o": 1, "all": 1, "i": 1}
    rows = dossier.evidence_rows(leads.where("detector_id = 'c'").withColumn("lead_id", F.lit(1)))
    assert {(r["source_group"], r["native_id"]) for r in rows.collect()} == {("grp", "n0")}
    with pytest.raises(packs.PackError):
        (tmp_path / "e.json").write_text('{"detectors": [{"id": "x", "template": "gap", "params": {}}]}')
        packs.load_detectors(tmp_path / "e.json")


def test_status_log_and_rank(spark):
    leads = spark.createDataFrame([(1, "d", 5.0, None, "new"), (2, "d", 10.0, 0.7, "new"), (3, "d", None, None, "new")], "lead_id long, detector_id string, score double, rank_score double, status string")
    events = spark.createDataFrame([(1, "verified", 1), (1, "killed", 2), (2, "weird", 3)], "lead_id long, status string, at int")
    assert {r["lead_id"]: r["status"] for r in D.apply_status_events(leads, events).collect()} == {1: "killed", 2: "new", 3: "new"}
    assert {r["lead_id"]: r["rank_score"] for r in D.rank_leads(leads).collect()} == {1: 0.5, 2: 0.7, 3: None}


def _walk(record, path):
    """The documented path rule, plainly: first element of lists at ``[]``, containers are nothing."""
    for seg in path.split("."):
        record = record.get(seg.removesuffix("[]")) if isinstance(record, dict) else None
        if seg.endswith("[]") and isinstance(record, list):
            record = record[0] if record else None
    return None if isinstance(record, (dict, list)) or record is None else record


def test_paths_and_explosion(spark):
    records = [{"a": [{"b": "x"}, {"b": "y"}]}, {"a": {"b": "z"}}, {"a": []}, {"a": None}, {"a": "s"}, {"c.d": 1}, {"a": [{"b": {"q": 1}}]}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "i int, j string")
    for path in ("a[].b", "a.b", "a[]", "a"):
        got = [r[1] for r in df.select("i", normalise.json_at(F.col("j"), path)).orderBy("i").collect()]
        assert got == [None if _walk(r, path) is None else str(_walk(r, path)) for r in records], path
    n = {r["i"]: r["n"] for r in df.select("i", F.size(normalise.elements_at(F.col("j"), "a[]")).alias("n")).collect()}
    assert [n[i] for i in range(7)] == [2, 1, 0, 0, 1, 0, 1]


def test_mapping_to_table(spark, tmp_path):
    pack = {
        "tables": {"officers": {"sources": [{"group": "V", "explode": "VENDOR.officers.officer[]", "paths": {"name": "name", "vendor": "^.VENDOR.legal_name", "pay": "pay"}, "const": {"source": "registry"}}, {"group": "W", "paths": {"name": "who"}, "const": {"source": "other"}}], "types": {"pay": "money"}}},
        "post_sql": ["CREATE INDEX i ON norm_officers(name)", "ALTER TABLE norm_officers ADD COLUMN big", "UPDATE norm_officers SET big = 'y' WHERE pay > 100"],
    }
    (tmp_path / "m.json").write_text(json.dumps(pack))
    mapping = packs.load_mapping(tmp_path / "m.json")[0]
    raw = spark.createDataFrame([("V", "1", "h", json.dumps({"VENDOR": {"legal_name": " Acme ", "officers": {"officer": [{"name": "A", "pay": "$200"}, {"name": " "}]}}})), ("V", "2", "h", json.dumps({"VENDOR": {"officers": {"officer": {"name": "B", "pay": "x"}}}})), ("V", "3", "h", "{}"), ("W", "4", "h", '{"who": "C"}')], "source_group string, native_id string, content_hash string, raw_json string")
    rows = {(r["native_id"], r["elem_index"]): r for r in normalise.normalise_table(raw, mapping).collect()}
    assert set(rows) == {("1", 0), ("1", 1), ("2", 0), ("4", None)}
    assert (rows["1", 0]["name"], rows["1", 0]["vendor"], rows["1", 0]["pay"], rows["1", 0]["big"], rows["1", 0]["source"]) == ("A", "Acme", 200.0, "y", "registry")
    assert (rows["1", 1]["name"], rows["2", 0]["pay"], rows["4", None]["vendor"], rows["4", None]["source"]) == (None, None, None, "other")
    with pytest.raises(ValueError):
        normalise.derive_from_sql("DELETE FROM norm_other", {"norm_officers": mapping})
    with pytest.raises(ValueError):
        normalise.derive_from_sql("INSERT INTO norm_officers VALUES (1)", {"norm_officers": mapping})


def test_statements_of_a_pack(spark, tmp_path):
    pack = {
        "tables": {"t": {"sources": [{"group": "G", "paths": {"a": "a", "b": "x.b", "c": "x.l[].c", "d": "x"}}], "types": {"a": "int"}}, "u": {"sources": [{"group": "H", "paths": {"k": "k"}}]}},
        "post_sql": ["UPDATE norm_t SET a = a + 1, b = CASE WHEN a = 1 THEN 'one, (two' ELSE b END, n = 'where' WHERE a < 3", "DELETE FROM norm_t WHERE c = 'gone'", "CREATE VIEW v AS SELECT b, count(*) AS n FROM norm_t GROUP BY b;"],
    }
    (tmp_path / "m.json").write_text(json.dumps(pack))
    with pytest.raises(ValueError):
        packs.load_mapping(tmp_path / "m.json")
    views: list = []
    tables = packs.load_mapping(tmp_path / "m.json", views)
    records = [{"a": 1, "x": {"b": "q", "l": [{"c": "y"}]}}, {"a": "5", "x": {"b": "q", "l": {"c": "gone"}}}, {"a": 7, "x": "text"}, {"x": None}, "{broken", None]
    raw = spark.createDataFrame([("G", str(i), "h", r if r is None or isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)], "source_group string, native_id string, content_hash string, raw_json string")
    assert normalise.write_tables(raw, tables, str(tmp_path / "out"), views=views) == {"norm_t": 3, "norm_u": 0, "v": 2}
    rows = {r["native_id"]: (r["a"], r["b"], r["c"], r["d"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out/norm_t")).collect()}
    assert rows == {"0": (2, "one, (two", "y", None, "where"), "2": (7, None, None, "text", None), "3": (None, None, None, None, None)}
    assert normalise.write_tables(raw, tables, str(tmp_path / "one"), only="u", views=views) == {"norm_u": 0}


def test_profile_sink_and_name_joins(spark, tmp_path):
    raw = spark.createDataFrame([("g", json.dumps({"id": f"K{i}", "name": f"Acme {i % 9} LLC", "l": [i] * 7})) for i in range(40)], "source_group string, raw_json string")
    stats = profile.field_stats(profile.flatten(raw), raw)
    names = spark.createDataFrame([(g, "name", f"{n} {i}{x}") for g, n, x in (("a", "Acme", " LLC"), ("b", "ACME", ", Inc."), ("c", "Other", "")) for i in range(12)], "grp string, field string, value string")
    joins = profile.name_joins(names)
    assert {(r["group_a"], r["group_b"], r["containment"]) for r in joins.collect()} == {("a", "b", 1.0), ("b", "a", 1.0)}
    out = profile.write_profile(stats, joins, tmp_path)
    assert out["groups"]["g"]["id_candidates"] == ["id"] and "name" in out["groups"]["g"]["name_candidates"] and len(out["groups"]["g"]["fields"]["id"]["examples"]) == 4
    assert json.loads((tmp_path / "profile.json").read_text()) == out and "Identifiers: id." in (tmp_path / "PROFILE_REPORT.md").read_text()
    short = profile.flatten(raw, max_list=5).where("path LIKE 'l%'").groupBy("path", "kind").agg(F.count("*").alias("n"), F.max("value").alias("v"))
    assert {(r["path"], r["kind"], r["n"]) for r in short.collect()} == {("l[]", "list", 40), ("l[]", "integer", 200)}


def test_entities_end_to_end(spark):
    t = spark.createDataFrame([(n,) for n in ["ACMEX LLC", "Acmex, L.L.C.", "Acmex LLC", "Acmex LLC", " ", None, "X on behalf of Y", "Ab", "Zed Works Hall", "Zed Works Hal"]], "n string")
    m = entities.mention_counts([(t, "t", "n", "org")])
    e = entities.with_ids(entities.cluster(m))
    rows = {r["canonical_name"]: r for r in e.collect()}
    assert rows["Acmex LLC"]["n_mentions"] == 4 and rows["X on behalf of Y"]["norm_key"] is None and rows["Ab"]["norm_key"] is None
    assert sorted(r["entity_id"] for r in e.collect()) == list(range(1, len(rows) + 1))
    a = entities.aliases(m, e)
    assert {r["raw_name"] for r in a.where(F.col("entity_id") == rows["Acmex LLC"]["entity_id"]).collect()} == {"ACMEX LLC", "Acmex, L.L.C.", "Acmex LLC"}
    z = sorted(rows[x]["entity_id"] for x in ("Zed Works Hall", "Zed Works Hal"))
    pairs = entities.token_candidates(e, least_mentions=1, least=0.5)
    assert {tuple(sorted((r["entity_id_a"], r["entity_id_b"]))) for r in pairs.collect()} == {tuple(z)}
    done = pairs.withColumn("status", F.lit("confirmed"))
    kept, moved, marked = entities.apply_confirmed(e, a, done)
    assert kept.where(F.col("entity_id") == z[0]).first()["n_mentions"] == 2 and kept.count() == e.count() - 1
    assert moved.where(F.col("entity_id") == z[1]).count() == 0 and marked.first()["status"] == "applied"


def test_survivors_follow_chains(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7)], "a long, b long")
    assert {tuple(r) for r in entities.survivors(df).collect()} == {(i, 1) for i in range(2, 61)} | {(101, 100)}
    assert entities.survivors(df.limit(0)).count() == 0


def test_profile_statistics(spark):
    raw = spark.createDataFrame([("g", json.dumps({"id": f"K{i}", "name": "A", "l": [{"x": i}, {"x": None}]})) for i in range(30)] + [("g", "{bad"), ("g", None)], "source_group string, raw_json string")
    rows = {r["path"]: r for r in profile.field_stats(profile.flatten(raw), raw).withColumns({"idc": profile.is_id_candidate(), "nc": profile.is_name_candidate()}).collect()}
    assert set(rows) == {"id", "name", "l[].x"}
    assert rows["id"]["n_distinct"] == 30 and rows["id"]["idc"] and rows["name"]["nc"] and not rows["name"]["idc"]
    assert rows["l[].x"]["types"] == {"empty": 30, "integer": 30}
    assert {(r["path"], r["kind"]): r["n"] for r in profile.loose_types(profile.flatten(raw)).collect()} == {("id", "str"): 30, ("name", "str"): 30, ("l[].x", "int"): 30, ("l[].x", "empty"): 30}
    assert {(r["field"], r["value"]) for r in profile.exact_values(raw, ["name", "l[].x"]).where("field = 'name' OR value = '3'").collect()} == {("name", "A"), ("l[].x", "3")}
    assert profile.name_beside(profile.field_stats(profile.flatten(raw), raw)).first()["name_path"] == "name"
    assert "## g" in profile.report([r.asDict() for r in rows.values()], [])
    sample = profile.spread_sample(spark.range(100).select(F.lit("a").alias("g"), "id"), "g", "id", 10)
    assert sorted(r["id"] for r in sample.collect()) == list(range(0, 100, 10))
    assert profile.spread_sample(spark.range(7).select(F.lit(None).cast("string").alias("g"), "id"), "g", "id", 10).count() == 7


def test_mentions_equal_a_plain_scan(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    people = spark.read.parquet(f"{data}/entities.parquet").where("entity_type = 'person'")
    names = mentions.scannable(people, "canonical_name")
    got = {(r["entity_name"], r["doc_id"]) for r in mentions.mentions(docs, "text", ["doc_id"], names).collect()}
    bare = lambda s: "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))
    split = lambda s: [w for w in re.split(r"[\W_]+", bare(s)) if w]
    want = set()
    for n in names.collect():
        w = split(n["matched_phrase"])
        for d in docs.where("text IS NOT NULL").collect():
            t = split(d["text"])
            if any(t[i : i + len(w)] == w for i in range(len(t))):
                want.add((n["entity_name"], d["doc_id"]))
    assert got == want and want


def test_chunks_follow_the_window_rule(spark):
    texts = ["a  b", " ".join(f"w{i}" for i in range(170)), " ".join(f"w{i}" for i in range(171)), " ".join(f"w{i}" for i in range(300)), "", "x y " * 900]
    got = _col(spark, semantic.chunks, texts)
    for t, g in zip(texts, got):
        w = t.split()
        want = [t] if len(w) <= 170 else []
        for i in range(0, len(w) if not want else 0, 130):
            want.append(" ".join(w[i : i + 170]))
            if i + 170 >= len(w):
                break
        assert g == want


def test_search_equals_numpy(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, e array<float>")
    scores = semantic.query_scores(df, "id", "e", df.where("id < 3"), "id", "e", block=2)
    assert scores.count() == 180
    top = semantic.top_k(semantic.query_scores(df, "id", "e", df.where("id < 3"), "id", "e", k=4, block=2), 4).collect()
    full = v.astype(np.float64) @ v[:3].T.astype(np.float64)
    assert {(r["query_id"], r["row_id"]) for r in top} == {(q, int(i)) for q in range(3) for i in np.argsort(-full[:, q], kind="stable")[:4]}
    best = {r["row_id"]: r["query_id"] for r in semantic.best_seed(scores).collect()}
    assert all(best[i] == int(np.argmax(full[i])) for i in range(60))
    assert semantic.query_scores(df.limit(0), "id", "e", df, "id", "e").count() == 0 == semantic.query_scores(df, "id", "e", df.limit(0), "id", "e").count()
    a, b = df.where("id < 30"), df.where("id >= 30")
    sims = np.einsum("ij,ij->i", v[:30].astype(float), v[30:].astype(float))
    assert semantic.noise_floor(a, b, "e", "id") == pytest.approx(np.percentile(sims, 99.5))
    assert len(semantic.hash_embedding(F.col("t")).__class__.__name__) > 0


def test_rank_cap_and_fusion(spark):
    scored = spark.createDataFrame([("m", "C", i, 0, 0.5 + i / 100, 0.1, 1.0) for i in range(6)] + [("m", "D", 9, 0, 0.2, 0.1, 1.0)], "member string, client string, press_chunk int, description_chunk int, sim double, margin double, strength double")
    income = spark.createDataFrame([("c", 1000.0)], "client string, income double")
    assert [r["press_chunk"] for r in semantic.rank_and_cap(scored, income, 3, 10).collect()] == [5, 4, 3, 9]
    one, two = (spark.createDataFrame(x, "row_id int, rank int") for x in ([(1, 1), (2, 2)], [(2, 1), (3, 2)]))
    assert semantic.fuse_ranks([one, two]).orderBy(F.desc("fused")).first()["row_id"] == 2


def test_dossier_is_repeatable(spark, tmp_path):
    ev = json.dumps([{"table": "t", "locators": [{"source_group": "g", "native_id": "1"}], "values": {"v": "9"}}])
    leads = spark.createDataFrame([(1, "d", "sig", "Claim about Acme Works", 5.0, None, "new", 0, "none", ev, "[]"), (2, "d", "sig", "<b>", 7.0, None, "new", 0, "none", '[{"locator": {"source_group": null, "native_id": "2"}}]', "[]"), (3, "d", "sig", None, None, 1.0, "new", 0, "none", None, "[]")], "lead_id long, detector_id string, signal_type string, claim string, score double, rank_score double, status string, legal_flag int, defamation_tier string, evidence string, innocent_explanations string")
    raw = spark.createDataFrame([("g", "f", "1", "h", "{}"), ("q", "f", "2", "h2", "{}"), ("q", "f", "3", "h3", "{}")], "source_group string, source_file string, native_id string, content_hash string, raw_json string")
    ents = spark.createDataFrame([(1, "acme works"), (2, "abc")], "entity_id long, canonical_name string")
    assert [r["lead_id"] for r in dossier.top_leads(leads).collect()] == [3, 2, 1]
    assert {r["native_id"] for r in dossier.bundle_records(leads, raw).collect()} == {"1", "2"}
    assert {tuple(r) for r in dossier.backlinks(leads, ents).collect()} == {(1, 1)}
    for k in ("a", "b"):
        dossier.write_vault(leads, raw, tmp_path / k, entities=ents)
        dossier.write_csv(leads, tmp_path / f"{k}.csv")
        dossier.write_html(leads, tmp_path / f"{k}.html")
    files = lambda k: {p.relative_to(tmp_path / k): p.read_bytes() for p in (tmp_path / k).rglob("*.md")}
    assert files("a") == files("b") and len(files("a")) >= 6
    assert (tmp_path / "a.csv").read_bytes() == (tmp_path / "b.csv").read_bytes() and b"&lt;b&gt;" in (tmp_path / "a.html").read_bytes()
    dossier.write_bundle(leads, ents, spark.createDataFrame([(1, "x")], "entity_id long, raw_name string"), raw, str(tmp_path / "bundle"))
    assert {r["key"]: r["value"] for r in spark.read.parquet(str(tmp_path / "bundle/bundle_manifest")).collect()}["raw_records"] == "2"


def test_hot_key_join(spark):
    big = spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("k"), "id")
    groups = big.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    got = skew.join_on_hot_key(big, groups, "k", "n", "id", hot=100, salts=8)
    assert got.count() == 5000 and got.where("k = 1 AND first = 0").count() == 4000
