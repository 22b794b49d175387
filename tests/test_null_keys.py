"""Events without a day or a user count as SQL counts them."""

import datetime
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lexdrift.plans.registry import ORACLES, QUERIES
from test_oracles import plain


def events(folder, missing: str) -> str:
    draw = random.Random(3)
    rows = []
    for k in range(3000):
        row = {"event_id": k, "ts": datetime.datetime(2024, 1, draw.randint(1, 9)), "user_id": draw.randint(1, 30), "event_type": "view", "value": round(draw.uniform(0, 90), 2), "props": "{}"}
        if k % 10 == 0:
            row[missing] = None
        rows.append(row)
    types = {"event_id": "int64", "ts": "timestamp[us]", "user_id": "int64", "event_type": "string", "value": "float64", "props": "string"}
    kinds = {n: pa.timestamp("us") if t.startswith("timestamp") else pa.type_for_alias(t) for n, t in types.items()}
    pq.write_table(pa.table({n: pa.array([r[n] for r in rows], t) for n, t in kinds.items()}), folder / "events.parquet")
    return str(folder)


@pytest.mark.parametrize("missing", ["ts", "user_id"])
@pytest.mark.parametrize("name", ["classifier_sweep", "monosemy_pages", "summary_table"])
def test_events_without_a_key(spark, tmp_path, name, missing):
    folder = events(tmp_path, missing)
    rows = QUERIES[name](spark, folder)
    columns = sorted(rows.columns)
    db = duckdb.connect()
    db.sql(f"create view events as select * from '{folder}/events.parquet'")
    answer = db.execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows.collect()) == sorted(tuple(plain(x[names.index(c)]) for c in columns) for x in answer.fetchall())
