"""The whole of a directional shift: words nearest to its direction, slices that lack neighbours or the word."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lexdrift.operators import drift
from lexdrift.plans.registry import ORACLES, QUERIES
from test_oracles import plain

X = np.random.default_rng(8).standard_normal((2, 12, 6))


def test_words_nearest_to_the_direction(spark):
    names = [f"w{i:02d}" for i in range(12)]
    vecs = spark.createDataFrame([(f"s{t}", n, X[t, i].tolist()) for t in (0, 1) for i, n in enumerate(names)], "slice string, word string, vec array<double>")
    row = drift.directional_shift(vecs, "w03", "s0", "s1", 4).first()
    u = X / np.linalg.norm(X, axis=2, keepdims=True)
    old, new = ([i for i in np.argsort(-u[t] @ u[t, 3]) if i != 3][:4] for t in (0, 1))
    direction = X[1, new].mean(0) - X[1, old].mean(0)
    assert np.allclose(row.direction, direction) and row.magnitude == pytest.approx(np.linalg.norm(direction))
    assert row.nearest == [names[i] for i in np.argsort(-u[1] @ direction)[:5]]


@pytest.mark.parametrize("ids", [[*range(400)], [24, 25, *(k for k in range(80) if k % 8 != 1)], [25, *range(32, 80)], [24, 25], []])
def test_slices_that_lack_words(spark, tmp_path, ids):
    x = np.random.default_rng(5).standard_normal((len(ids), 64)).astype("f4")
    columns = {"vec_id": pa.array(ids, "int64"), "label": pa.array([0] * len(ids), "int64"), "embedding": pa.array(list(map(list, x)), pa.list_(pa.float32()))}
    pq.write_table(pa.table(columns), tmp_path / "embeddings.parquet")
    rows = QUERIES["directional_shift"](spark, str(tmp_path))
    columns = sorted(rows.columns)
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    answer = db.execute(ORACLES["directional_shift"])
    names = [d[0] for d in answer.description]
    assert "nearest" in names
    assert [tuple(plain(r[c]) for c in columns) for r in rows.collect()] == [tuple(plain(x[names.index(c)]) for c in columns) for x in answer.fetchall()]
