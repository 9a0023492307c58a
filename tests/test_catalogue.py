"""Every registered query of the core against its SQL in DuckDB, over the smallest tables."""

import os

import duckdb
import pytest
from strataframe.plans import catalogue

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DIR)
    rows = [tuple(r) for r in got.collect()]
    if name not in catalogue.ORACLES:
        assert rows
        return
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(rows, got.columns) == plain(want.fetchall(), want.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_sketches_grow_with_their_values(spark, duck, tmp_path):
    """Fixed sizes (2^16 and 2^20 bits) would be full here and let non-members pass."""
    duck.sql(f"COPY (SELECT i AS event_id, i AS user_id, 0.5 AS value FROM range(90000) r(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    duck.sql(f"COPY (SELECT 'part ' || i AS p_name FROM range(300000) r(i)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    for name in ("events", "part"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    for name in ("bloom_nonmembers", "bloom_segment_no_match", "bloom_string_nonmembers"):
        got, want = catalogue.QUERIES[name](spark, str(tmp_path)), con.sql(catalogue.ORACLES[name])
        assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns), name
