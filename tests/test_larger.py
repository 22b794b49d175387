"""Queries against SQL where tables are large in one respect: names of more digits than SQL keeps, cells of many usages."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lexdrift.plans.registry import ORACLES, QUERIES
from test_oracles import plain


def embeddings(folder, ids: list[int], labels: int) -> str:
    rng = np.random.default_rng(5)
    x = rng.standard_normal((len(ids), 64)).astype("f4") + 0.5
    columns = {"vec_id": pa.array(ids, "int64"), "label": pa.array([int(rng.integers(labels)) for _ in ids], "int64"), "embedding": pa.array(list(map(list, x)), pa.list_(pa.float32()))}
    pq.write_table(pa.table(columns), folder / "embeddings.parquet")
    return str(folder)


def same(spark, name: str, folder: str) -> None:
    rows = QUERIES[name](spark, folder)
    columns = sorted(rows.columns)
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    answer = db.execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows.collect()) == sorted(tuple(plain(x[names.index(c)]) for c in columns) for x in answer.fetchall())


@pytest.mark.parametrize("name", ["community_events", "directional_shift", "neighbourhood_sizes", "nearest_words", "pairwise_shifts", "dispersion", "domain_coherence", "knn_graph", "neighbour_snapshot"])
def test_words_that_share_a_name(spark, tmp_path, name):
    words = [*range(8), 1000, 1001, *range(10000, 10004), *range(10010, 10013)]
    same(spark, name, embeddings(tmp_path, [w * 8 + y for w in words for y in range(8)], 3))


def test_cells_of_many_usages(spark, tmp_path):
    same(spark, "cross_period_moments", embeddings(tmp_path, list(range(5600)), 2))
