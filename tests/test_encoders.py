import pytest
from pyspark.sql import functions as F

from tastemill.operators import ctr_features as ctr
from tastemill.operators import encoders as enc


def test_one_hot_size_is_largest_id_plus_one(spark):
    df = enc.one_hot(spark.createDataFrame([(1,), (4,)], "movieId long"))
    assert [(r.movieIdVector.size, list(r.movieIdVector.indices)) for r in df.orderBy("movieId").collect()] == [
        (5, [1]),
        (5, [4]),
    ]


def test_one_hot_of_large_null_and_negative_ids(spark):
    df = enc.one_hot(spark.createDataFrame([(7,), (10_000_000,), (None,)], "movieId long"))
    assert df.schema["movieIdVector"].metadata == {"ml_attr": {"num_attrs": 10_000_001}}
    found = {r.movieId: r.movieIdVector for r in df.collect()}
    assert found[None] is None and found[7].size == 10_000_001
    assert list(found[10_000_000].indices) == [10_000_000] and list(found[7].values) == [1.0]
    with pytest.raises(Exception, match="negative movieId"):
        enc.one_hot(spark.createDataFrame([(-1,), (3,)], "movieId long")).collect()
    assert enc.one_hot(spark.createDataFrame([], "movieId long")).collect() == []


def test_multi_hot(spark):
    items = [(1, "A|B"), (2, "B"), (3, "C|B|B"), (4, None)]
    df = enc.multi_hot(spark.createDataFrame(items, "movieId long, genres string"))
    found = {r.movieId: (r.genreIndexes, r.indexSize, list(r.vector.indices), list(r.vector.values)) for r in df.collect()}
    assert found == {
        1: ([0, 1], 3, [0, 1], [1.0, 1.0]),
        2: ([0], 3, [0], [1.0]),
        3: ([0, 2], 3, [0, 2], [1.0, 1.0]),
    }


def test_label_index_paths_agree(spark, monkeypatch):
    df = spark.range(300).select(F.concat(F.lit("g"), (F.col("id") * F.col("id") % 23).cast("string")).alias("g"))
    a = sorted(map(str, enc.string_index(df, "g", "i").collect()))
    monkeypatch.setattr(enc, "MODEL_LABELS", 3)
    b = sorted(map(str, enc.string_index(df, "g", "i", hot_rows=4).collect()))
    assert a == b and len(a) == 300


def test_constant_column_scales_to_one_half(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 3.0)], "k int, x double")
    assert {r.y[0] for r in enc.fit_min_max(df, "x", "y").transform(df).collect()} == {0.5}


def test_count_quantiles_match_a_sorted_list(spark):
    values = sorted((i * i) % 37 + 1 for i in range(501))
    df = spark.createDataFrame([(v,) for v in values], "n long")
    expected = {values[-(-i * len(values) // 100) - 1] for i in range(1, 100)}
    assert enc.count_quantiles(df, "n", 100) == sorted(map(float, expected))
    exact = enc.fit_quantile_buckets(df, "n", "b", relative_error=0.0)
    assert list(exact.getSplits())[1:-1] == sorted(map(float, expected))


def test_scalar_to_vector(spark):
    df = enc.to_vector(spark.createDataFrame([(2.5,)], "x double"), "x", "v")
    assert list(df.first().v) == [2.5]


def test_genre_outside_the_vocabulary_is_all_zero(spark):
    df = spark.createDataFrame([("Drama",), ("Polka",), (None,)], "g string")
    found = {r.g: (int(r.gIndex), r.gIndexVec.size, list(r.gIndexVec.indices)) for r in ctr.genre_indicators(df, ["g"]).collect()}
    assert found == {"Drama": (2, 20, [2]), "Polka": (20, 20, []), None: (20, 20, [])}


def test_id_bucket(spark):
    df = spark.createDataFrame([(5,), (12,), (-1,)], "k long")
    assert [r[0] for r in df.select(ctr.id_bucket("k", 10, default=0)).collect()] == [5, 0, 0]
    with pytest.raises(Exception, match="outside"):
        df.select(ctr.id_bucket("k", 10)).collect()


def test_id_indicator_has_a_fixed_size(spark):
    df = ctr.id_indicator(spark.createDataFrame([(3,)], "k long"), "k", 8)
    assert (df.first().kVec.size, list(df.first().kVec.indices)) == (8, [3])


def test_hashed_cross_is_stable_and_bounded(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (1, None)], "a long, b long")
    found = [r[0] for r in df.select(ctr.hashed_cross(["a", "b"], 1000)).collect()]
    assert found[0] == found[1] != found[2] and all(0 <= x < 1000 for x in found)


def test_genre_vectors_are_means(spark):
    items = spark.createDataFrame([(1, "A|B"), (2, "A"), (3, "A")], "movieId long, genres string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 4.0])], "item long, vector array<double>")
    found = {r.item: r.vector for r in ctr.genre_vectors(items, vectors, 2).collect()}
    assert found == {"A": [0.5, 2.0], "B": [1.0, 0.0]}


def test_ties_of_numbers_are_ordered_as_text(spark):
    df = spark.createDataFrame([(i,) for i in (2, 9, 10, 100)], "k long")
    assert {r.k: r.i for r in enc.string_index(df, "k", "i").collect()} == {10: 0, 100: 1, 2: 2, 9: 3}


def test_multi_hot_beyond_the_model(spark, monkeypatch):
    items = spark.createDataFrame([(1, "b|a"), (2, "a"), (3, "c|a|b"), (4, "a|a")], "movieId long, genres string")
    few = sorted(map(str, enc.multi_hot(items).collect()))
    monkeypatch.setattr(enc, "MODEL_LABELS", 2)
    assert sorted(map(str, enc.multi_hot(items).collect())) == few


def test_exact_quantiles_read_the_table_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(100, numPartitions=4).select(F.col("id").cast("double").alias("x")).mapInArrow(counted, "x double")
    assert enc.exact_quantiles(rows, "x", 4) == [24.0, 49.0, 74.0]
    assert seen.value == 100


def test_exact_quantiles_of_any_number(spark):
    from tastemill.operators import encoders as enc

    values = [(i * 7919 % 1009 - 500) * 10.0 ** (i % 40 - 20) for i in range(900)]
    values += [0.0, -0.0, 5e-324, -5e-324, 1.7e308, float("inf"), float("-inf")] + [3.25] * 300
    frame = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "x double")
    ordered, n = sorted(values), len(values)
    for buckets in (2, 7, 100):
        expected = sorted({ordered[-(-i * n // buckets) - 1] for i in range(1, buckets)})
        assert enc.exact_quantiles(frame, "x", buckets) == expected
    assert enc.exact_quantiles(frame.limit(0), "x", 10) == []
    made = enc.fit_exact_buckets(frame, "x", "b", 10).transform(frame).where("x = 3.25").select("b").distinct().collect()
    cuts = [v for v in enc.exact_quantiles(frame, "x", 10) if v <= 3.25]
    assert [r.b for r in made] == [len(cuts)]
