"""A semantic pack from tables to leads, with the encoder that needs no model and with another one."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import semantic, skew
from ledgerloom.plans import packs


def _pack(tmp_path, **bridge):
    pack = {
        "model": "m", "spaces": [
            {"name": "press", "table": "releases", "text_col": "text", "id_cols": ["native_id"], "carry_cols": ["member_bioguide", "pub_date", "source_group"], "dedupe": True},
            {"name": "desc", "table": "filings", "text_col": "what", "id_cols": ["native_id"], "carry_cols": ["client_name", "filing_year", "period_norm"], "chunk": True, "where": "what <> 'no'"},
        ],
        "bridge": {"press_space": "press", "desc_space": "desc", "anchors": [{"name": "ok", "sql": "SELECT member, client FROM ties", "strength": 2.0}, {"name": "bad", "sql": "SELECT x FROM nowhere"}], "null_percentile": 0, "min_floor": 0.1, "min_margin_over_centroid": -1, "income_sql": "SELECT client_name, 1000.0 FROM filings"} | bridge,
    }
    (tmp_path / "s.json").write_text(json.dumps(pack))
    return packs.load_semantic(tmp_path / "s.json")


def _tables(spark):
    releases = [("p1", "m1", "2024-02-03", "Harbor dredging money for Port Arden", "g"), ("p2", "m1", "2024-02-03", "Harbor dredging money for Port Arden", "g"), ("p3", "m1", "2024-08-01", "Harbor dredging again at Port Arden", "g"), ("p4", "m2", "2024-02-01", "bees", "g"), ("p5", None, "2024-02-01", "Harbor dredging", "g"), ("p6", "m1", None, "  ", "g")]
    filings = [("f1", "Arden Port Co", 2024, "first_quarter", "money for Harbor dredging Port Arden"), ("f2", " arden port co", 2024, "first_quarter", "general support"), ("f3", "Arden Port Co", 2024, "third_quarter", "Bees and Honey"), ("f4", None, 2024, "first_quarter", "Harbor"), ("f5", "Arden Port Co", 2024, "first_quarter", "no")]
    return {
        "releases": spark.createDataFrame(releases, "native_id string, member_bioguide string, pub_date string, text string, source_group string"),
        "filings": spark.createDataFrame(filings, "native_id string, client_name string, filing_year int, period_norm string, what string"),
        "ties": spark.createDataFrame([("m1", "Arden Port co "), ("m2", None), ("m9", "Z")], "member string, client string"),
    }


def test_spaces_and_bridge(spark, tmp_path):
    pack, tables = _pack(tmp_path), _tables(spark)
    assert semantic.build_spaces(pack, tables, str(tmp_path / "i")) == {"press": 4, "desc": 4}
    rows, about = semantic.read_space(spark, str(tmp_path / "i"), "press")
    assert about["dims"] == 256 and about["n_vectors"] == 4 and about["deduped"] is True and [r["native_id"] for r in rows.orderBy("row_id").collect()] == ["p1", "p3", "p4", "p5"]
    assert all(abs(np.linalg.norm(r["embedding"]) - 1) < 1e-5 for r in rows.collect())
    leads, skipped = semantic.bridge(spark, pack, tables, str(tmp_path / "i"), "r1")
    assert len(skipped) == 1 and skipped[0].startswith("bad:")
    got = leads.collect()
    assert len(got) == 1 and '"p1"' in got[0]["evidence"] and '"f1"' in got[0]["evidence"] and got[0]["signal_type"] == "semantic_overlap"
    loose, _ = semantic.bridge(spark, _pack(tmp_path, same_quarter=False), tables, str(tmp_path / "i"), "r1")
    assert loose.count() == 1
    none, _ = semantic.bridge(spark, _pack(tmp_path, exclude_clients=["arden port CO"]), tables, str(tmp_path / "i"), "r1")
    assert none.count() == 0


def test_limit_comes_before_copies_and_any_encoder_fits(spark, tmp_path):
    t = spark.createDataFrame([(3, "b"), (1, "a"), (2, "a"), (4, "c")], "id int, t string")
    assert {r["text"] for r in semantic.space(t, "t", ["id"], limit=2).collect()} == {"a"}
    assert semantic.space(t, "t", ["id"], dedupe=False, chunk=False).count() == 4
    length = lambda c: F.array(F.length(c).cast("float"), F.lit(3.0).cast("float"))
    rows = semantic.write_space(semantic.space(t, "t", ["id"]), ["id"], str(tmp_path), "x", length)
    assert [round(x, 3) for x in rows.first()["embedding"]] == [0.316, 0.949]


def test_hashed_words_tell_texts_apart(spark):
    df = spark.createDataFrame([("Harbor money",), ("money harbor!",), ("bees",), ("",), (None,)], "t string")
    v = [np.array(r[0]) for r in df.select(semantic.hash_embedding(F.col("t"))).collect()]
    assert v[0] @ v[1] == pytest.approx(1, abs=1e-6) and abs(v[0] @ v[2]) < 0.5 and not v[3].any() and not v[4].any()


def test_specific_by_own_rules(spark):
    df = spark.createDataFrame([("services related to NASA",), ("General support, miscellaneous 12",), ("plain",), (None,)], "t string")
    rule = semantic.is_specific(F.col("t"), [r"\b[A-Z]{2,}\b", "General"], ["general support", "miscellaneous"])
    assert [r[0] for r in df.select(rule).collect()] == [True, False, False, None]


def test_semantic_packs_are_checked(tmp_path):
    for change in ({"press_space": "x"}, {"anchors": []}):
        with pytest.raises(packs.PackError):
            _pack(tmp_path, **change)


def test_pairs_of_hot_keys_are_all_there(spark):
    left = spark.range(60).select(F.when(F.col("id") < 50, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    right = spark.range(40).select(F.when(F.col("id") < 30, 1).otherwise(F.col("id") + 20).alias("k"), F.col("id").alias("b"))
    got = {(r["k"], r["a"], r["b"]) for r in skew.join_pairs(left, right, ["k"], "a", work=100, most=8).collect()}
    assert got == {(r["k"], r["a"], r["b"]) for r in left.join(right, "k").collect()} and len(got) > 1500
