"""Queries over whole tables against plain Python: texts and names in any letters, amounts and scores that cannot be read."""

import re

import pytest

import __spark_entry__ as entry

SUFFIX = re.compile(r"\b(l\.?l\.?c|l\.?l\.?p|inc|incorporated|corp|corporation|co|company|ltd|limited|lp|pllc|pc|the)\b", re.IGNORECASE)
BILL = re.compile(r"\b[HS]\.?\s?[RJ]?\.?\s?\d{1,5}\b")
CAPITALS = re.compile(r"\b[A-Z][A-Za-z0-9&.\-]{2,}\b")
COMMON = {"The", "This", "Act", "Bill", "Issues", "House", "Senate", "Congress", "Federal", "United", "States", "General", "All"}
NAMES = ["Café Éco Co", "Société The Ltd", "Écoco Inc", "Muñoz LLC", "Muñoz, L.L.C.", "ÑCo Works", "Acme Works", "acme works inc", "Straße Co", "Śląsk the Hall", "Ünal on behalf of Éva"]


def _run(spark, folder, name, **tables):
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
    return entry.queries()[name](spark, str(folder)).collect()


@pytest.fixture
def aliases(spark):
    return spark.createDataFrame([(i, n, "org", 3) for i, n in enumerate(NAMES)], "entity_id long, raw_name string, entity_type string, n_mentions long")


def _norm(s):
    return re.sub("[^a-z0-9]+", "", SUFFIX.sub(" ", s.lower()))


def test_texts_in_any_letters(spark, tmp_path):
    texts = ["año ÉCOLE", "El S. 12", "ÉS 12 más", "niño\u00a0Acme", " ".join(f"ñ{i}" for i in range(400)), "\u2003".join(f"é{i}" for i in range(171)), "a\x1cb\x85ü " * 90, "The Act é", "H.R.\u00a0٣٤", "ÁCME Ácme", "x&-. ÑAB", None, "日本 Federal 東京"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in _run(spark, tmp_path, "chunker", documents=docs):
        got.setdefault(r["doc_id"], {})[r["chunk_index"]] = r["chunk"]
    assert set(got) == {i for i, t in enumerate(texts) if t is not None}
    for i, t in enumerate(texts):
        if t is not None:
            w, want = t.split(), []
            for at in range(0, len(w), 130):
                want.append(" ".join(w[at : at + 170]))
                if at + 170 >= len(w):
                    break
            assert [got[i][k] for k in sorted(got[i])] == ([t] if len(w) <= 170 else want), t
    judged = {r["doc_id"]: r["specific"] for r in _run(spark, tmp_path, "specificity", documents=docs)}
    assert judged == {i: bool(BILL.search(t)) or any(m not in COMMON for m in CAPITALS.findall(t)) for i, t in enumerate(texts) if t is not None}


def test_names_in_any_letters(spark, tmp_path, aliases):
    got = {r["raw_name"]: (r["norm_key"], r["light"]) for r in _run(spark, tmp_path, "norm_key", aliases=aliases)}
    assert got == {n: (_norm(n), re.sub("[^a-z0-9]+", "", n.lower())) for n in NAMES}
    clusters = {}
    for n in NAMES:
        if len(_norm(n)) >= 5 and "on behalf of" not in n:
            clusters.setdefault(_norm(n), []).append(n)
    got = {(r["norm_key"], r["canonical_name"], r["n_mentions"]) for r in _run(spark, tmp_path, "entity_clusters", aliases=aliases)}
    alone = {(None, n, 3) for n in NAMES if len(_norm(n)) < 5 or "on behalf of" in n}
    assert got == {(k, min(v), 3 * len(v)) for k, v in clusters.items()} | alone
    people = aliases.selectExpr("entity_id", "entity_type", "raw_name AS canonical_name", "'k' AS norm_key", "n_mentions")
    found = {(r["name"], r["entity_id"]) for r in _run(spark, tmp_path, "entity_lookup", entities=people, aliases=aliases)}
    assert found == {(n, i) for i, n in enumerate(NAMES)}
    leads = spark.createDataFrame([(1, "para CAFÉ ÉCO CO y otros"), (2, "le Śląsk THE Hall"), (3, "nada"), (4, None)], "lead_id long, claim string")
    assert {tuple(r) for r in _run(spark, tmp_path, "backlinks", leads=leads, entities=people)} == {(0, 1), (9, 2)}
    tokens = [frozenset(t for t in re.split("[^a-z0-9]+", SUFFIX.sub(" ", n.lower())) if len(t) > 2) for n in NAMES]
    want = {(i, j) for i in range(len(NAMES)) for j in range(i + 1, len(NAMES)) if tokens[i] & tokens[j] and len(tokens[i] & tokens[j]) / len(tokens[i] | tokens[j]) >= 0.6}
    assert {(r[0], r[1]) for r in _run(spark, tmp_path, "jaccard", entities=people)} == want and (6, 7) in want


def test_amounts_and_scores_that_cannot_be_read(spark, tmp_path):
    written = {"a": "abc", "b": "9d", "c": "$1,200.50", "d": "", "e": "1e3", "f": "-7"}
    raw = spark.createDataFrame([(i, ".csv::payments/#/#-#.csv", f'{{"id": "{k}", "amount": "{v}"}}') for i, (k, v) in enumerate(written.items())], "ord long, source_group string, raw_json string")
    got = {r["payment_id"]: r["amount"] for r in _run(spark, tmp_path, "to_money", raw_records=raw)}
    assert got == {"a": None, "b": None, "c": 1200.5, "d": None, "e": 1000.0, "f": -7.0}
    nan = float("nan")
    leads = spark.createDataFrame([(1, "d", nan, None, "one"), (2, "d", 5.0, None, "two"), (3, "d", 10.0, 0.7, "three"), (4, "d", nan, 0.1, "four"), (5, "e", nan, nan, "five"), (6, "d", 1.0, nan, "six")], "lead_id long, detector_id string, score double, rank_score double, claim string")
    assert {r["lead_id"]: r["rank_score"] for r in _run(spark, tmp_path, "rank_leads", leads=leads)} == {1: None, 2: 0.5, 3: 0.7, 4: 0.1, 5: None, 6: 0.1}
    assert [r["lead_id"] for r in _run(spark, tmp_path, "top_leads", leads=leads)] == [3, 4, 2, 6, 1, 5]
