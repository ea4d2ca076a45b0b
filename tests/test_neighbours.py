import numpy as np
import pytest

from tastemill.operators.embeddings import similar_items
from tastemill.operators.neighbours import best_matches, pruned_matches, similar_items_batch

SCHEMA = "item long, vector array<double>"


def table(spark, n, seed):
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(seed).normal(size=(n, 5)))]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("options", [{}, {"block_queries": 2}, {"block_queries": 3, "pass_bytes": 200}])
def test_best_matches_equal_brute_force(spark, options):
    rows, vectors = table(spark, 80, 3)
    asked, queries = table(spark, 11, 4)
    found = {}
    for r in sorted(best_matches(queries, vectors, 6, **options).collect(), key=lambda r: (r.query, r.rank)):
        found.setdefault(r.query, []).append(r.item)
    for query, vector in asked:
        scores = sorted((-float(np.dot(vector, v)), i) for i, v in rows)
        assert found[query] == [i for _, i in scores[:6]]
    assert len(found) == len(asked)


def test_batch_equals_the_single_search(spark):
    _, vectors = table(spark, 60, 5)
    batch = similar_items_batch(vectors.where("item % 20 = 0"), vectors, 7).collect()
    for query in (0, 20, 40):
        single = [(r.item, round(r.similarity, 9)) for r in similar_items(vectors, query, 7).collect()]
        assert sorted(single) == sorted((r.item, round(r.similarity, 9)) for r in batch if r.query == query)


def test_ties_copies_nulls_and_empty_tables(spark):
    rows = [(i, [1.0, 2.0]) for i in range(9)] + [(50, [0.0, 0.0]), (51, None)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    found = sorted((r.query, r.item) for r in similar_items_batch(vectors.where("item in (3, 50, 51)"), vectors, 4).collect())
    assert found == [(3, 0), (3, 1), (3, 2), (3, 4)]
    # A copy with a larger id than k others is not among its own best.
    found = sorted(r.item for r in similar_items_batch(vectors.where("item = 8"), vectors, 4).collect())
    assert found == [0, 1, 2, 3]
    empty = spark.createDataFrame([], SCHEMA)
    assert similar_items_batch(empty, vectors).count() == 0 and similar_items_batch(vectors, empty).count() == 0


@pytest.mark.parametrize("options", [{}, {"block_vectors": 7}, {"block_vectors": 5, "pass_bytes": 2000}])
def test_pruned_matches_equal_brute_force(spark, options):
    rng = np.random.default_rng(9)
    # A few long vectors, many short ones, ties, a zero vector and null ones.
    rows = [(i, (v * 3.0 ** (-(i % 40) / 4)).tolist()) for i, v in enumerate(rng.normal(size=(400, 5)))]
    rows += [(400 + i, rows[0][1]) for i in range(3)] + [(500, [0.0] * 5), (501, None), (502, [None] * 5)]
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(3)
    asked = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(12, 5)))] + [(50, [0.0] * 5), (51, None)]
    found = pruned_matches(spark.createDataFrame(asked, SCHEMA), vectors, 6, **options).collect()
    whole = [(i, v) for i, v in rows if v is not None and v[0] is not None]
    for query, vector in asked[:-1]:
        scores = sorted((-sum(x * y for x, y in zip(vector, v)), i) for i, v in whole)
        assert [r.item for r in sorted(found, key=lambda r: r.rank) if r.query == query] == [i for _, i in scores[:6]]
    assert {r.query for r in found} == {i for i, _ in asked[:-1]}
    if options:
        assert max(r.scored for r in found if r.query != 50) < len(whole)
    empty = spark.createDataFrame([], SCHEMA)
    assert pruned_matches(empty, vectors, 3).count() == 0 and pruned_matches(vectors, empty, 3).count() == 0


def test_pruned_lists_equal_those_of_als(spark, folder):
    from tastemill.operators import collaborative as cf
    from tastemill.plans.registry import _als_rows

    model = cf.fit_als(_als_rows(spark, folder), iterations=3)
    for side, lists in (("items", cf.recommend_items(model)), ("users", cf.recommend_users(model))):
        expected = {(r.id, r["rank"]): r.score for r in cf.ranked(lists).collect()}
        found = {(r.id, r["rank"]): r.score for r in cf.pruned_lists(model, side).collect()}
        assert set(found) == set(expected)
        assert all(abs(found[key] - expected[key]) < 1e-4 for key in expected)


def test_equal_vectors_have_equal_scores_in_any_block():
    from tastemill.operators.neighbours import exact_dots, top_matches

    rng = np.random.default_rng(2)
    queries, vectors = rng.normal(size=(300, 7)), rng.normal(size=(5_000, 7))
    vectors[[3, 900, 4_999]] = 3 * vectors[0]
    places, scores, met = top_matches(queries, vectors, 8, block_vectors=64)
    whole = np.stack([exact_dots(np.tile(q, (5_000, 1)), vectors) for q in queries])
    expected = np.argsort(-whole, axis=1, kind="stable")[:, :8]
    assert (places == expected).all() and (scores == np.take_along_axis(whole, expected, axis=1)).all()
    assert met.max() < 5_000


def test_lists_are_joined_by_blocks(spark):
    """Rows that meet one by one took most of the time of large searches."""
    _, vectors = table(spark, 40, 5)
    for found in (best_matches(vectors, vectors, 3), pruned_matches(vectors, vectors, 3)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_zero_queries_and_many_copies_take_the_first_items():
    from tastemill.operators.neighbours import top_matches

    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(3_000, 4))
    vectors[1_000:] = vectors[7]
    places, scores, met = top_matches(np.array([[0.0] * 4, vectors[7]]), vectors, 3, block_vectors=64)
    longer = np.flatnonzero(vectors[:1_000] @ vectors[7] > vectors[7] @ vectors[7] + 1e-9)
    assert places[0].tolist() == [0, 1, 2] and scores[0].tolist() == [0.0] * 3
    best = longer[np.argsort(-(vectors[longer] @ vectors[7]))].tolist() + [7, 1_000, 1_001]
    assert places[1].tolist() == best[:3]
