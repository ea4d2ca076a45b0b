"""Queries that once asked for every hundredth id only."""

import duckdb
import numpy as np
import pytest

from tastemill.plans import registry as reg
from tastemill.plans.oracles import ORACLES


@pytest.fixture
def tables(spark, tmp_path):
    """A folder with some order lines of customers 1 to 9 and stored vectors of parts 1 to 30."""
    rng = np.random.default_rng(6)
    size = reg.STORED_VECTOR_SIZE
    vectors = [(i, rng.normal(size=size).astype(np.float32).tolist()) for i in range(1, 31)]
    orders = [(o, 1 + o % 9) for o in range(40)]
    lines = [(o, int(rng.integers(1, 31)), 1, n, float(rng.integers(1, 51)), 10.0, "2024-01-02") for o in range(40) for n in range(3)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, d string"
    frame = spark.createDataFrame(lines, columns).selectExpr("* except (d)", "cast(d as timestamp_ntz) as l_shipdate")
    frame.write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_stored_vectors_topk_answers_every_user(spark, tables):
    found = {(r.userId, r["rank"]): (r.movieId, r.score) for r in reg.stored_vectors_topk(spark, tables).collect()}
    assert {user for user, _ in found} == set(range(1, 10)) and len(found) == 90
    with duckdb.connect() as db:
        for name in ("orders", "lineitem", "embeddings"):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet/*.parquet'")
        expected = {row[:2]: row[2:] for row in db.execute(ORACLES["stored_vectors_topk"]).fetchall()}
    assert found.keys() == expected.keys()
    assert all(found[key][0] == expected[key][0] and abs(found[key][1] - expected[key][1]) < 2e-4 for key in found)


def test_two_tower_topk_answers_every_user(spark, monkeypatch):
    rng = np.random.default_rng(7)
    users, items = ([(i, rng.normal(size=8).tolist()) for i in range(1, n + 1)] for n in (7, 40))
    made = [spark.createDataFrame(rows, "item long, vector array<double>") for rows in (items, users)]
    monkeypatch.setattr(reg, "two_tower_vectors", lambda spark, folder: tuple(made))
    found = {(r.userId, r["rank"]): r.movieId for r in reg.two_tower_topk(spark, "").collect()}
    for user, vector in users:
        best = sorted((-float(np.dot(vector, v)), i) for i, v in items)[:10]
        assert [found[user, rank] for rank in range(1, 11)] == [i for _, i in best]
    assert len(found) == 70


def test_training_samples_are_kept_compressed(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(reg, "shared_dir", lambda spark: str(tmp_path))
    rows = reg.training_samples_csv(spark, folder)
    [path] = tmp_path.iterdir()
    parts = [p for p in path.iterdir() if p.name.startswith("part-")]
    assert parts and all(p.name.endswith(".csv.gz") for p in parts)
    assert rows.count() == reg.line_samples(spark, folder).count()
