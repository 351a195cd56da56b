"""Every registered repair query against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import pytest

from lexmend.plans.queries import ORACLES, QUERIES

TABLES = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not TABLES.is_dir(), reason="no test tables")


def test_entry_works(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 200


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, str(TABLES))
    columns = sorted(frame.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in frame.collect())
    if name not in ORACLES:
        assert got
        return
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(str(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
