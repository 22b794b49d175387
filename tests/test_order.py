"""Results do not depend on how rows are dealt or ordered."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lexdrift.functions import ranks
from lexdrift.plans.registry import ORACLES, QUERIES
from test_oracles import plain

# Means whose seventh lies at a threshold or not, depending on which value is added first.
AT_A_TENTH, AT_ONE = (0.01, 0.01, 2.08), (0.08, 0.34, 20.58)


def events(folder, turned: bool) -> str:
    """Two users' days; ``turned``: the rows in the opposite order."""
    rows = []
    for user, values in ((1, AT_A_TENTH), (2, AT_ONE)):
        for day in range(1, 7):
            rows += [(0, datetime.datetime(2024, 1, day), user, "view", x, "{}") for x in values]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    columns = list(zip(*(rows[::-1] if turned else rows)))
    names = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    folder.mkdir()
    pq.write_table(pa.table(dict(zip(names, map(pa.array, map(list, columns))))), folder / "events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["classifier_sweep", "monosemy_summary", "dip_archetypes", "monosemy_pages", "summary_table"])
def test_rows_in_any_order(spark, tmp_path, name):
    asked = [events(tmp_path / f"{t}", t) for t in (False, True)]
    found = []
    for folder in asked:
        rows = QUERIES[name](spark, folder)
        columns = sorted(rows.columns)
        found.append(sorted(tuple(plain(r[c]) for c in columns) for r in rows.collect()))
    db = duckdb.connect()
    db.sql(f"create view events as select * from '{asked[0]}/events.parquet'")
    answer = db.execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    assert found[0] == found[1] == sorted(tuple(plain(x[names.index(c)]) for c in columns) for x in answer.fetchall())


def test_sums_in_order(spark):
    rows = [("a", 2, 1e16), ("a", 1, 1.0), ("a", 3, -1e16), ("a", 4, None), ("b", 1, None)]
    df = spark.createDataFrame(rows, "k string, i int, x double")
    found = {r.k: (r.s, r.m) for r in df.groupBy("k").agg(ranks.sum_in_order(df.x, "i").alias("s"), ranks.mean_in_order(df.x, "i").alias("m")).collect()}
    assert found == {"a": (0.0, 0.0), "b": (None, None)}
