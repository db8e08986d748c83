"""The queries of the part: rows as SQL gives them where there is SQL, the columns asked for, and a run of every other."""

import glob
import os

import pytest

from ledgerloom.llm.queries import ORACLE, QUERIES

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def _rows(frame):
    plain = lambda x: "" if x is None or x != x else f"{x:.6f}" if isinstance(x, float) else str(x)
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(plain(x) for x in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, data, con, name):
    assert _rows(QUERIES[name](spark, data).toPandas()) == _rows(con.sql(ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


def test_found_queries_have_the_columns_asked_for(spark, data):
    want = {
        "p4_found": "group_id bigint, entity_id bigint", "p6_found": "keep_ord bigint, copy_ord bigint", "p7_found": "entity_id_a bigint, entity_id_b bigint",
        "p9_found": "doc_id bigint, item_id bigint", "p10_found": "doc_id bigint",
    }
    for name, columns in want.items():
        assert ", ".join(f"{c} {t}" for c, t in QUERIES[name](spark, data).dtypes) == columns
