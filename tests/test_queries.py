"""Every query with SQL gives the rows that DuckDB gives, over the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        return int(v) if v == int(v) else float(v)
    return round(v, 9) if isinstance(v, float) else v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


def _core():
    from pagemill.plans import registry

    return registry


@pytest.mark.parametrize("name", sorted(_core().oracle_sql()))
def test_same_rows(spark, sql, name):
    got, want = entry.queries()[name](spark, DATA), sql.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = sorted(repr([plain(r[c]) for c in order]) for r in got.collect())
    assert rows == sorted(repr([plain(r[want.columns.index(c)]) for c in order]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(_core().queries()) - set(_core().oracle_sql())))
def test_runs(spark, name):
    assert entry.queries()[name](spark, DATA).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() == 50


def test_zip_export_archives_large_ids(spark, tmp_path):
    docs = spark.range(190, 260).selectExpr("id AS doc_id", "'s' AS source", "concat('text ', id) AS text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["zip_export"](spark, str(tmp_path)).collect()
    assert sum(r.entries for r in got) == 70 and max(r.entries for r in got) == 25
