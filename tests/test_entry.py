"""Every query that has SQL gives the same rows in DuckDB; every other one runs and has a stable schema."""

import glob
import os

import pytest

import __spark_entry__ as entry
from ledgerloom.plans import fixtures, prep

OWN = fixtures.QUERIES | prep.QUERIES  # the optional part has its own tests
ORACLE = fixtures.ORACLE | prep.ORACLE

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def _rows(frame):
    def plain(x):
        if x is None or x != x:
            return ""
        if isinstance(x, float):
            return f"{x:.5f}"
        return str(x)[:10] if "Timestamp" in type(x).__name__ or "date" in type(x).__name__ else str(x)

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(plain(x) for x in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, data, con, name):
    assert _rows(OWN[name](spark, data).toPandas()) == _rows(con.sql(ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(OWN) - set(ORACLE)))
def test_runs(spark, data, name):
    df = OWN[name](spark, data)
    assert df.columns and df.count() >= 0


def test_smoke(spark):
    assert entry.entry(spark).count() > 0
    assert set(OWN) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_found_queries_have_the_columns_asked_for(spark, data):
    want = {
        "p1_found": "release_id bigint, utc_micros bigint", "p2_found": "ord bigint, child_path string, elem_pos string",
        "p3_found": "source_group string, source_file string, change_kind string, field_path string, new_path string",
    }
    for name, columns in want.items():
        assert ", ".join(f"{c} {t}" for c, t in OWN[name](spark, data).dtypes) == columns
