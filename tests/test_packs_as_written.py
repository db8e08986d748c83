"""Packs in the documented form: parameter names, aliases in fragments, null groups, part days, and the lifecycle."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import detectors as D
from ledgerloom.operators import dossier


def _table(spark, rows, cols):
    return spark.createDataFrame([(*r, "grp", f"n{i}") for i, r in enumerate(rows)], cols + ", source_group string, native_id string")


def _leads(spark, template, params, tables, **kw):
    d = D.Detector("d", template, params, ["x"], **kw)
    assert D.preflight(d, tables) == []
    return D.run_detector(d, tables, "r").collect()


def test_guards_and_fragments(spark):
    l = _table(spark, [("a", 10.0, "x", "Natl. Bank"), ("a", 50.0, "y", "it's"), ("b", None, "x", None)], "k string, v double, g string, name string")
    r = _table(spark, [("a", 100.0, " X ", "q"), ("b", 1.0, "x", "q")], "k string, v double, g string, name string")
    p = {"left": {"table": "l", "value_col": "v"}, "right": {"table": "r", "value_col": "v"}, "join_on": [["k", "k"]], "guard_cols": [["g", "g"]], "tolerance": 1, "label_cols": ["name"], "_comment": "free"}
    assert [x["score"] for x in _leads(spark, "contradiction", p, {"l": l, "r": r})] == [90.0]
    assert _leads(spark, "contradiction", p | {"left_where": "AND l.name <> 'Natl. Bank'", "right_where": 'AND r."name" = \'q\''}, {"l": l, "r": r}) == []
    report = {x["measure"]: x["value"] for x in D.detector_report(D.Detector("d", "contradiction", p), {"l": l, "r": r}).collect()}
    assert report == {"one_side_null": 1.0, "guard_excluded": 1.0}
    claim = _leads(spark, "contradiction", p, {"l": l, "r": r})[0]["claim"]
    assert claim == "Records show two disclosures of the same engagement (Natl. Bank) report different values: 10.0 vs 100.0 (difference 90.0, tolerance 1). The records do not establish intent or causation."
    g = {"left": {"table": "l"}, "right": {"table": "r"}, "join_on": [["k", "k"]], "guard_cols": [["g", "g"]], "left_where": "AND l.v >= 20", "score_col": "v"}
    assert [x["score"] for x in _leads(spark, "gap", g, {"l": l, "r": r})] == [50.0]


def test_unknown_parameters_and_bad_fragments_are_refused(spark):
    l = _table(spark, [("a", 1.0)], "k string, v double")
    p = {"left": {"table": "l"}, "right": {"table": "l"}, "join_on": [["k", "k"]]}
    for bad in (p | {"guards": [["k", "k"]]}, p | {"left": {"table": "l", "value_col": "v"}}, p | {"left_where": "AND l.nope = 1"}, p | {"score_col": "k"}):
        assert D.preflight(D.Detector("d", "gap", bad), {"l": l})
    assert D.preflight(D.Detector("d", "gap", p), {"l": l}) == []


def test_null_groups_are_groups(spark):
    t = _table(spark, [(None, float(i % 3)) for i in range(100)] + [(None, 1e6), ("a", 5.0)], "g string, v double")
    top = _leads(spark, "outlier", {"table": "t", "value_col": "v", "group_cols": ["g"]}, {"t": t})
    assert len(top) == 2 and all('"native_id"' in x["evidence"] for x in top)
    far = _leads(spark, "outlier", {"table": "t", "value_col": "v", "group_cols": ["g"], "method": "sigma", "threshold": 4}, {"t": t})
    assert len(far) == 1 and "n100" in far[0]["evidence"]
    assert len(_leads(spark, "outlier", {"table": "t", "value_col": "v", "method": "sigma"}, {"t": t})) == 1


def test_overlap_counts_parts_of_days(spark):
    l = _table(spark, [("e", "2024-01-01 00:00:00", 7.0), ("e", "2024-01-01 12:00:00", None), ("e", None, 9.0), (None, "2024-01-01", 9.0)], "who string, at string, paid double")
    r = _table(spark, [("e", "2024-03-31 23:00:00"), (None, "2024-01-01")], "whom string, seen string").withColumn("seen", F.to_timestamp("seen"))
    p = {"left": {"table": "l", "entity_col": "who", "date_col": "at"}, "right": {"table": "r", "entity_col": "whom", "date_col": "seen"}, "window_days": 90}
    assert _leads(spark, "overlap", p, {"l": l, "r": r}) == []
    assert [x["score"] for x in _leads(spark, "overlap", p | {"window_days": 90.5}, {"l": l, "r": r})] == [1.0]
    assert len(_leads(spark, "overlap", p | {"window_days": 91}, {"l": l, "r": r})) == 2
    paid = p | {"left": p["left"] | {"amount_col": "paid"}, "window_days": 91, "min_amount": 5}
    assert [x["score"] for x in _leads(spark, "overlap", paid, {"l": l, "r": r})] == [7.0]
    assert {x["signal_type"] for x in _leads(spark, "overlap", paid, {"l": l, "r": r})} == {"timing_overlap"}


def test_intermediaries_name_their_records(spark):
    t = _table(spark, [("X on behalf of Y",), ("X on behalf of Y",), ("plain",)], "name string")
    rows = _leads(spark, "intermediary", {"table": "t", "name_col": "name", "patterns": [r"^(?P<intermediary>.+) on behalf of (?P<principal>.+)$"]}, {"t": t}, legal_flag=True)
    assert [(x["score"], x["legal_flag"]) for x in rows] == [(2.0, 1)]
    assert [r["native_id"] for r in dossier.evidence_rows(spark.createDataFrame([(1, rows[0]["evidence"])], "lead_id long, evidence string")).collect()] == ["n0"]


@pytest.mark.parametrize("status, events, want", [
    ("new", [("published", 1)], "new"), ("new", [("verified", 2), ("promoted", 1)], "verified"), ("new", [("verified", 1), ("promoted", 2), ("published", 3), ("killed", 4)], "published"),
    ("new", [("killed", 1), ("verified", 2), ("published", 9)], "killed"), ("killed", [("verified", 1)], "killed"), ("promoted", [("verified", 1), ("published", 2)], "published"),
    ("new", [("verified", 1), ("promoted", 1), ("weird", 3)], "promoted"), ("verified", [("promoted", 5), ("killed", 6)], "killed"), ("published", [("killed", 1)], "published"), (None, [("verified", 1)], "verified"),
])
def test_lifecycle(spark, status, events, want):
    leads = spark.createDataFrame([(1, status), (2, "verified")], "lead_id long, status string")
    log = spark.createDataFrame([(1, s, at) for s, at in events] + [(None, "killed", 1)], "lead_id long, status string, at int")
    assert {r["lead_id"]: r["status"] for r in D.apply_status_events(leads, log).collect()} == {1: want, 2: "verified"}
