"""Summed normal equations, vectors from joint occurrences, the index by cells and bucketed walk edges."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tastemill.operators import als_sums, pmi_vectors, vector_index, walks
from tastemill.operators import collaborative as cf
from tastemill.operators.neighbours import similar_items_batch
from tastemill.plans.registry import _als_rows

VECTORS = "item long, vector array<double>"


def test_half_step_equals_that_of_spark(spark, folder):
    rows = _als_rows(spark, folder).persist()
    model = cf.fit_als(rows, iterations=3)
    # Spark's last step finds the users' factors from the items'.
    expected = {r.item: r.vector for r in cf.factors(model, "users").collect()}
    for hot_rows in (10**6, 50):
        found = {r.item: r.vector for r in als_sums.half_step(rows, cf.factors(model, "items"), cf.USER, cf.ITEM, hot_rows=hot_rows).collect()}
        assert set(found) == set(expected)
        assert all(np.allclose(found[u], expected[u], atol=1e-4) for u in expected)
    rows.unpersist()


def test_hot_items_are_summed_in_their_tasks(spark):
    random.seed(4)
    # One item has a third of all ratings; ids are beyond 32 bits, users are words.
    rows = [(f"u{random.randrange(200)}", (1 << 40) if random.random() < 0.33 else random.randrange(60)) for _ in range(6_000)]
    side = {f"u{i}": random.gauss(0, 1) for i in range(200)} | {1 << 40: 1.5} | {i: random.gauss(0, 1) for i in range(60)}
    frame = spark.createDataFrame([(u, i, side[u] * side[i]) for u, i in rows], "user string, item long, rating double").repartition(8)
    frame = frame.persist()
    users = als_sums.first_vectors(frame, "user", 3, 1)
    # Before anything moves there is at most one partial sum of the item in each task.
    plan = als_sums.normal_equations(frame, users, "item", "user", "rating", 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_sum") > plan.index("Exchange hashpartitioning(item")
    model = als_sums.fit_als_sums(frame, "user", "item", "rating", rank=3, iterations=6)
    error = model.score(frame, "user", "item").agg(F.sqrt(F.avg((F.col("prediction") - F.col("rating")) ** 2))).first()[0]
    assert error < 0.1 and model.items.count() == frame.select("item").distinct().count()
    assert model.score(frame, "user", "item").columns == [*frame.columns, "prediction"]
    odd = frame.limit(5).unionByName(spark.createDataFrame([(None, 1, 1.0), ("u1", None, 1.0), ("u1", 5, None)], frame.schema))
    assert als_sums.fit_als_sums(odd, "user", "item", "rating", rank=2, iterations=1).users.count() <= 5
    empty = als_sums.fit_als_sums(frame.limit(0), "user", "item", "rating", rank=2, iterations=1)
    assert empty.users.count() == empty.items.count() == 0
    frame.unpersist()


@pytest.mark.parametrize(
    "key, broadcast, hot_rows", [("long", True, 10**6), ("string", False, 10**6), ("long", False, 40), ("double", True, 10**6)]
)
def test_ratings_are_summed_where_they_meet(spark, monkeypatch, key, broadcast, hot_rows):
    random.seed(5)
    rows = [(random.randrange(70) // random.randrange(1, 4), random.randrange(30), random.random()) for _ in range(1_500)]
    frame = spark.createDataFrame(rows, "user long, item long, rating double").withColumn("user", F.col("user").cast(key))
    frame = frame.unionByName(frame.where("item = 3")).persist()
    step, asked = als_sums.half_step, []
    users, items = als_sums.first_vectors(frame, "user", 3, 42).checkpoint(), None
    for _ in range(2):
        items = step(frame, users, "item", "user", "rating", rank=3).checkpoint()
        users = step(frame, items, "user", "item", "rating", rank=3).checkpoint()
    monkeypatch.setattr(als_sums, "fits_broadcast", lambda table: broadcast)
    monkeypatch.setattr(als_sums, "half_step", lambda *a, **o: asked.append(a[3]) or step(*a, **o))
    model = als_sums.fit_als_sums(frame, "user", "item", "rating", rank=3, iterations=2, hot_rows=hot_rows)
    for found, expected in ((model.users, users), (model.items, items)):
        found, expected = ({r.item: r.vector for r in t.collect()} for t in (found, expected))
        assert found.keys() == expected.keys() and all(np.allclose(found[k], expected[k]) for k in expected)
    # Sums are moved for hot ids only, or where ids can't be told apart in tasks.
    assert bool(asked) == (hot_rows == 40 or key == "double")
    frame.unpersist()


def test_rows_of_one_id_in_several_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    rows = spark.range(40).select((F.col("id") % 3).alias("user"), (F.col("id") % 5 + 1.0).alias("rating"),
                                  F.array(F.col("id") % 7 + 0.5, F.col("id") % 2 + 0.0).alias("__v"))
    found = {r.item: r.vector for r in als_sums.solved_in_place(rows, "user", "rating", 2, 0.01).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    held = rows.collect()
    for user in range(3):
        v = np.array([r["__v"] for r in held if r.user == user])
        y = np.array([r.rating for r in held if r.user == user])
        assert np.allclose(found[user], np.linalg.solve(v.T @ v + 0.01 * len(v) * np.eye(2), v.T @ y))


def brute_information(lists, window):
    counts = {}
    for items in lists:
        for i, a in enumerate(items):
            for b in items[i + 1 : i + 1 + window]:
                for pair in ((a, b), (b, a)):
                    counts[pair] = counts.get(pair, 0) + 1
    of, total = {}, sum(counts.values())
    for (a, _), n in counts.items():
        of[a] = of.get(a, 0) + n
    ratios = {(a, b): n * total / (of[a] * of[b]) for (a, b), n in counts.items()}
    return {pair: math.log(x) for pair, x in ratios.items() if x > 1}


def test_information_equals_brute_force(spark):
    random.seed(5)
    lists = [[random.choice([1, 1, 1, *range(12)]) for _ in range(random.randrange(0, 30))] for _ in range(40)]
    frame = spark.createDataFrame([(x,) for x in [*lists, None]], "movieIds array<long>")
    expected = brute_information(lists, 3)
    for hot_rows in (10**6, 5):
        entries = pmi_vectors.positive_information(pmi_vectors.co_occurrences(frame, window=3), hot_rows=hot_rows)
        found = {(r.a, r.b): r.weight for r in entries.collect()}
        assert set(found) == set(expected) and all(abs(found[p] - expected[p]) < 1e-9 for p in found)
    # The eigenvalues and the vectors' products are those of the dense matrix.
    vectors, values = pmi_vectors.leading_vectors(entries, 3, steps=60)
    names = sorted({a for a, _ in expected})
    dense = np.array([[expected.get((a, b), 0.0) for b in names] for a in names])
    exact, basis = np.linalg.eigh(dense)
    largest = np.argsort(-np.abs(exact))[:3]
    assert np.allclose(sorted(values), sorted(exact[largest]), atol=1e-3)
    made = {r.item: r.vector for r in vectors.collect()}
    made = np.array([made[a] for a in names])
    positive = [i for i in largest if exact[i] > 0]
    wanted = sum(exact[i] * np.outer(basis[:, i], basis[:, i]) for i in positive)
    assert np.allclose(made @ made.T, wanted, atol=2e-2)
    none = pmi_vectors.pmi_vectors(frame.limit(0))
    assert none.count() == 0 and none.columns == ["item", "vector"]


def test_planted_clusters_are_neighbours(spark):
    random.seed(6)
    lists = []
    for _ in range(300):
        cluster = random.randrange(4)
        lists.append(([random.randrange(10) + 10 * cluster for _ in range(12)],))
    # A rare item, seen twice, has a vector too.
    lists += [([100, 31, 32],), ([33, 100, 34],)]
    vectors = pmi_vectors.pmi_vectors(spark.createDataFrame(lists, "movieIds array<long>"), size=4).persist()
    assert vectors.count() == 41
    found = similar_items_batch(vectors, vectors, 5).collect()
    assert all(min(r.query, 39) // 10 == min(r.item, 39) // 10 for r in found)
    vectors.unpersist()


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 8))
    rows = [(i, (centres[i % 30] + 0.25 * rng.normal(size=8)).tolist()) for i in range(1_500)]
    # A third of all vectors are nearly the same, some are exact copies.
    rows += [(2_000 + i, (centres[0] + 0.01 * rng.normal(size=8)).tolist()) for i in range(700)]
    rows += [(3_000 + i, rows[5][1]) for i in range(3)] + [(4_000, [0.0] * 8), (4_001, None)]
    return spark.createDataFrame(rows, VECTORS).repartition(5).cache()


def test_all_cells_are_the_exact_search(spark, clustered):
    index = vector_index.fit_index(clustered)
    asked = clustered.where("item % 100 = 0")
    exact = {(r.query, r.item): r.similarity for r in similar_items_batch(asked, clustered, 10).collect()}
    for piece_rows in (10_000, 37):
        found = vector_index.search(index, asked, 10, probes=len(index.centres), piece_rows=piece_rows).collect()
        assert {(r.query, r.item) for r in found} == set(exact)
        assert all(abs(r.similarity - exact[r.query, r.item]) < 1e-9 for r in found)
        assert sorted({r["rank"] for r in found}) == list(range(1, 11))


def test_queries_travel_once_to_a_bundle_of_cells(spark, clustered):
    """A vector repeated for every cell that is looked into took all of a task's memory."""
    index = vector_index.fit_index(clustered)
    probes = len(index.centres) - 1
    assert probes > 20
    few = vector_index._with_cells(index.table.select("item", "vector"), index.centres, probes)
    assert few.count() == probes * index.table.count()
    batch = pa.record_batch([pa.array(range(1_000))], ["item"])
    assert [b.num_rows for b in vector_index._slices([batch], vector_index.SLICE_BYTES // 400)] == [400, 400, 200]
    found = vector_index.search(index, clustered, 3, probes=probes)
    lines = found._jdf.queryExecution().executedPlan().toString()
    assert "cells" in lines and "place" not in lines
    assert vector_index._bundles({0: 5, 1: 4, 2: 30, 3: 2, 5: 9}, 10) == {0: [0], 1: [0], 2: [1, 2, 3], 3: [4], 5: [5]}


def test_few_cells_find_most(spark, clustered):
    index = vector_index.fit_index(clustered, sample_rows=800)
    assert index.table.count() == 1_500 + 700 + 3
    probes = vector_index.measured_probes(index, 10)
    assert probes < len(index.centres) / 3
    asked = clustered.where("item % 100 = 0")
    measured = vector_index.recall_table(vector_index.search(index, asked, 10, probes=probes), similar_items_batch(asked, clustered, 10)).first()
    assert measured.recall >= 0.9 and measured.queries == asked.where("item < 4000").count()
    assert vector_index.search(index, clustered, 10, probes=probes).where("rank = 1").count() == index.table.count()
    assert vector_index.fit_index(clustered.limit(0)) is None
    one = vector_index.fit_index(clustered.where("item = 7"))
    assert vector_index.measured_probes(one) == 1 and vector_index.search(one, asked, 3, probes=1).count() == asked.where("item < 4000").count()


def test_walks_move_and_edges_stay(spark):
    pairs = spark.createDataFrame([(a, (a * 3 + b) % 50, 1 + b) for a in range(50) for b in range(4)], "src long, dst long, cnt long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    usual = sorted(map(str, walks.walk_paths(pairs, walks=200, length=6).collect()))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        paths = walks.walk_paths(pairs, walks=200, length=6)
        lines = paths._jdf.queryExecution().executedPlan().toString().splitlines()
        scans = [i for i, line in enumerate(lines) if "walk_steps_" in line]
        assert len(scans) == 5
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        for i in scans:
            # On the way from a scan up to its join there is no exchange.
            while "Join" not in lines[i]:
                assert "Exchange" not in lines[i]
                i = next(j for j in range(i - 1, -1, -1) if depth(lines[j]) < depth(lines[i]))
        assert sorted(map(str, paths.collect())) == usual
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
