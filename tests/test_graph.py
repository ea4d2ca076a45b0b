from collections import Counter

from pyspark.sql import functions as F

from tastemill.columns import RatingColumns
from tastemill.operators import embeddings as emb
from tastemill.operators import sequences as seq
from tastemill.operators import walks

SCHEMA = "userId long, movieId long, rating double, timestamp long"


def liked(spark, *paths):
    rows = [(u, m, 5.0, t) for u, path in enumerate(paths) for t, m in enumerate(path)]
    return spark.createDataFrame(rows, SCHEMA)


def test_sequences_keep_likes_in_time_order(spark):
    ratings = spark.createDataFrame([(1, 7, 5.0, 3), (1, 8, 3.0, 2), (1, 9, 3.5, 1)], SCHEMA)
    found = seq.user_sequences(ratings).collect()
    assert [(r.userId, r.segment, r.movieIds) for r in found] == [(1, 0, [9, 7])]
    assert seq.sequence_text(seq.user_sequences(ratings)).first().movieIdStr == "9 7"


def test_long_sequences_are_segmented_but_whole(spark):
    ratings = liked(spark, range(100), range(7))
    for hot_rows in (10**6, 15):
        found = seq.user_sequences(ratings, segment_items=30, hot_rows=hot_rows).orderBy("userId", "segment").collect()
        assert [len(r.movieIds) for r in found] == [30, 30, 30, 10, 7]
        assert sum((r.movieIds for r in found if r.userId == 0), []) == list(range(100))


def test_pairs_of_hot_users(spark):
    ratings = liked(spark, [i * 7 % 11 for i in range(200)], [1, 2, 3])
    cols = RatingColumns(ties=("movieId",))
    plain = sorted(map(tuple, seq.item_pairs(ratings, cols).collect()))
    assert plain == sorted(map(tuple, seq.item_pairs(ratings, cols, hot_rows=9).collect()))
    assert sum(p[2] for p in plain) == 199 + 2


def test_probabilities_sum_to_one(spark):
    pairs = seq.item_pairs(liked(spark, [1, 2, 1, 3, 1, 2], [2, 3, 2, 1]))
    sums = Counter()
    for r in seq.transition_probs(pairs).collect():
        sums[r.src] += r.prob
    assert all(abs(s - 1) < 1e-12 for s in sums.values()) and set(sums) == {1, 2, 3}
    assert abs(sum(r.prob for r in seq.item_distribution(pairs).collect()) - 1) < 1e-12


def test_walks_follow_edges(spark):
    pairs = seq.item_pairs(liked(spark, [1, 2, 1, 3, 1, 2, 4, 5], [2, 3, 2, 1, 4])).persist()
    edges = {(r.src, r.dst) for r in pairs.collect()}
    found = walks.walk_paths(pairs, walks=300, length=25).collect()
    assert len(found) == 300 and {r.walk_id for r in found} == set(range(1, 301))
    for r in found:
        assert all(step in edges for step in zip(r.path, r.path[1:]))
        # A walk is short only where it ended at an item without successors.
        assert len(r.path) == 25 or r.path[-1] == 5
    again = walks.walk_paths(pairs.repartition(5), walks=300, length=25).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_walk_with_one_successor_takes_it(spark):
    pairs = seq.item_pairs(liked(spark, [1, 2, 3]))
    for r in walks.walk_paths(pairs, walks=20, length=5).collect():
        assert r.path in ([1, 2, 3], [2, 3])


def test_steps_are_drawn_in_proportion(spark):
    pairs = spark.createDataFrame([(0, 1, 9), (0, 2, 1), (1, 0, 9), (2, 0, 1)], "src long, dst long, cnt long")
    drawn = Counter()
    for r in walks.walk_paths(pairs, walks=4000, length=2).collect():
        if r.path[0] == 0:
            drawn[r.path[1]] += 1
    assert 0.87 < drawn[1] / sum(drawn.values()) < 0.93


def test_popular_edges_and_small_ones_share_a_source(spark):
    rows = [(0, d, 1) for d in range(1, 200)] + [(0, 500, 5000)] + [(d, 0, 1) for d in range(1, 200)] + [(500, 0, 5000)]
    pairs = spark.createDataFrame(rows, "src long, dst long, cnt long")
    found = walks.walk_paths(pairs, walks=500, length=4).collect()
    edges = {(a, b) for a, b, _ in rows}
    assert all(len(r.path) == 4 and all(s in edges for s in zip(r.path, r.path[1:])) for r in found)


def test_user_vectors_shuffle_ratings_once_and_no_sums(spark):
    ratings = spark.range(60).select((F.col("id") % 7).alias("userId"), (F.col("id") % 5).alias("movieId"))
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (3, [0.5, -1.0])], "item long, vector array<double>")
    summed, cut = (emb.user_vectors(ratings, vectors, 2, hot_rows=n) for n in (1_000, 5))
    plan = summed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert {r.userId: r.vector for r in summed.collect()} == {r.userId: r.vector for r in cut.collect()}


def test_user_vectors_sum_and_default_to_zero(spark):
    ratings = spark.createDataFrame([(1, 10, 1.0, 1), (1, 10, 5.0, 2), (1, 11, 2.0, 3), (2, 99, 5.0, 1)], SCHEMA)
    vectors = spark.createDataFrame([(10, [1.0, 2.0]), (11, [0.5, -1.0])], "item long, vector array<double>")
    found = {r.userId: r.vector for r in emb.user_vectors(ratings, vectors, 2).collect()}
    assert found == {1: [2.5, 3.0], 2: [0.0, 0.0]}


def test_similar_items(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 1.0]), (5, [0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "item long, vector array<double>")
    found = emb.similar_items(vectors, 1, 2).collect()
    assert [r.item for r in found] == [2, 4] and abs(found[0].similarity - 1) < 1e-12
    assert emb.similar_items(vectors, 77).count() == 0


def test_item2vec_is_repeatable_and_excludes_the_query(spark):
    paths = [[i % 6, (i + 1) % 6, (i + 2) % 6, i % 3] for i in range(60)]
    ratings = liked(spark, *paths)
    a, b = (emb.item2vec(ratings, partitions=1, iterations=2) for _ in range(2))
    assert sorted(map(str, emb.model_vectors(a).collect())) == sorted(map(str, emb.model_vectors(b).collect()))
    found = [r.item for r in emb.synonyms(a, 1, 20).collect()]
    assert len(found) == 5 and "1" not in found
    # The trained model's own search gives the same neighbours.
    assert found == [r.word for r in a.findSynonyms("1", 20).orderBy("similarity", ascending=False).collect()]


def test_deepwalk_trains_on_walks(spark):
    ratings = liked(spark, *[[i % 6, (i + 1) % 6, (i + 3) % 6] for i in range(30)])
    model = emb.deepwalk(ratings, walks=50, length=5, iterations=1, size=4)
    found = emb.model_vectors(model).collect()
    assert {len(r.vector) for r in found} == {4} and len(found) == 6
