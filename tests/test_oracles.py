"""Every registered query that SQL can express against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from lexdrift.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    rows = QUERIES[name](spark, DATA)
    columns = sorted(rows.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in rows.collect())
    answer = db.execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(x[names.index(c)]) for c in columns) for x in answer.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    rows = QUERIES[name](spark, DATA)
    assert rows.columns
    rows.write.format("noop").mode("overwrite").save()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["communities_by_slice", "word_landscape"])
def test_every_word_of_every_slice_is_there(spark, name):
    from lexdrift.plans import fixtures as fx

    want = {(r.slice, r.word) for r in fx.slice_vectors(spark, DATA).select("slice", "word").collect()}
    assert {(r.slice, r.word) for r in QUERIES[name](spark, DATA).select("slice", "word").collect()} == want
