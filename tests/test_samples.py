import pytest

from tastemill.columns import RatingColumns
from tastemill.functions.scalars import two_digits
from tastemill.operators import history, samples, snapshots
from tastemill.plans.jobs import model_samples, write_split_samples
from tastemill.sources import files

COLS = RatingColumns()
SCHEMA = "userId long, movieId long, rating double, timestamp long"
ITEMS = "movieId long, title string, genres string"


def build(spark, ratings, items, **options):
    r = spark.createDataFrame(ratings, SCHEMA)
    i = spark.createDataFrame(items, ITEMS)
    return {(x.userId, x.movieId): x for x in model_samples(r, i, COLS, **options).collect()}


def test_columns_are_the_27_of_a_sample(spark):
    df = model_samples(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], ITEMS))
    assert df.columns == files.SAMPLE_COLUMNS and len(df.columns) == 27


def test_warm_up_and_short_users(spark):
    ratings = [(1, 10, 4.0, 1), (2, 10, 4.0, 1), (2, 11, 4.0, 2), (3, 10, 4.0, 1), (3, 11, 2.0, 2), (3, 12, 5.0, 3)]
    found = build(spark, ratings, [(10, "A (2000)", "X|Y"), (11, "B (2002)", "Y")])
    assert set(found) == {(3, 12)}
    row = found[(3, 12)]
    assert (row.userRatingCount, row.userRatedMovie1, row.userRatedMovie2) == (2, 10, None)
    assert (row.releaseYear, row.movieGenre1, row.userGenre1, row.userGenre2) == (1990, None, "X", "Y")
    assert (row.userAvgReleaseYear, row.userAvgRating, row.userRatingStddev) == (2001, 3.0, 1.41)


def test_item_with_one_rating_has_no_deviation(spark):
    ratings = spark.createDataFrame([(1, 10, 4.0, 1), (1, 11, 3.0, 2), (2, 11, 4.0, 2)], SCHEMA)
    found = {r.movieId: r for r in samples.item_model_stats(ratings).collect()}
    assert (found[10].movieRatingStddev, found[11].movieRatingStddev) == (0.0, 0.71)


def test_history_is_bounded_and_excludes_the_current_row(spark):
    ratings = [(1, m, 4.0, m) for m in range(150)]
    found = build(spark, ratings, [])
    assert found[(1, 149)].userRatingCount == 100
    assert found[(1, 50)].userRatingCount == 50
    assert [found[(1, 149)][f"userRatedMovie{i}"] for i in range(1, 6)] == [148, 147, 146, 145, 144]


def test_history_without_likes_is_null(spark):
    ratings = [(1, m, 1.0, m) for m in range(4)]
    row = build(spark, ratings, [(m, "T (2000)", "A") for m in range(4)])[(1, 3)]
    assert row.userRatedMovie1 is None and row.userGenre1 is None


def test_time_is_compared_as_a_number(spark):
    ratings = [(1, 1, 5.0, 1464982703), (1, 2, 5.0, 964982703), (1, 3, 5.0, 1564982703)]
    row = build(spark, ratings, [])[(1, 3)]
    assert (row.userRatedMovie1, row.userRatedMovie2) == (1, 2)


def test_equal_times_follow_the_tie_columns(spark):
    ratings = [(1, m, 5.0, 7) for m in (3, 1, 2)]
    row = build(spark, ratings, [])[(1, 3)]
    assert (row.userRatedMovie1, row.userRatedMovie2) == (2, 1)


def test_hot_users_and_items_give_the_same_samples(spark):
    ratings = [(1 if i % 3 else 2 + i % 7, i % 5, (i * 7 % 10 + 1) / 2, i // 2) for i in range(900)]
    ratings = [(u, m, r, t) for u, m, r, t in dict.fromkeys(ratings)]
    cols = RatingColumns(ties=("movieId", "rating"))
    r = spark.createDataFrame(ratings, SCHEMA)
    i = spark.createDataFrame([(m, f"T ({1990 + m})", "A|B" if m % 2 else "B|C") for m in range(5)], ITEMS)
    for rows in (3, 100):
        plain = sorted(map(str, model_samples(r, i, cols, rows=rows).collect()))
        split = sorted(map(str, model_samples(r, i, cols, rows=rows, hot_rows=25).collect()))
        assert plain == split and len(plain) > 500


def test_chunks_smaller_than_the_window(spark):
    ratings = spark.createDataFrame([(1, i, 4.0, i) for i in range(60)], SCHEMA)
    split = samples.label_ratings(ratings).withColumns({"genres": two_digits("rating").cast("string")})
    split = split.withColumn("releaseYear", split.movieId.cast("int"))
    a = history.user_features(split, rows=40).orderBy("movieId").collect()
    b = history.user_features(split, rows=40, hot_rows=2).orderBy("movieId").collect()
    assert a == b and len(a) == 58


def test_snapshots_take_the_latest_row(spark):
    ratings = [(u, m, 4.0, 10 * u + m) for u in (1, 2) for m in range(5)]
    df = model_samples(spark.createDataFrame(ratings, SCHEMA), spark.createDataFrame([], ITEMS))
    users = {r.userId: r for r in snapshots.user_snapshot(df).collect()}
    assert (users[1].userRatedMovie1, users[1].userRatingCount, users[1].userGenre1) == (3, 4, "")
    items = {r.movieId: r for r in snapshots.item_snapshot(df).collect()}
    # Items 0 and 1 occur in warm-up rows only.
    assert set(items) == {2, 3, 4} and items[2].movieGenre1 == "" and items[2].releaseYear == 1990


def test_hash_split_is_disjoint_complete_and_stable(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    once = {r.k: r.split for r in samples.hash_split(df, ["k"]).collect()}
    again = {r.k: r.split for r in samples.hash_split(df.repartition(7), ["k"]).collect()}
    share = sum(v == "train" for v in once.values()) / 5000
    assert once == again and len(once) == 5000 and 0.77 < share < 0.83


def test_random_split_keeps_every_row(spark):
    train, test = samples.random_split(spark.range(100))
    assert train.count() + test.count() == 100 and train.intersect(test).isEmpty()


def test_bad_text_ids_become_null(spark):
    df = spark.createDataFrame([("1", "x", "4.5")], "userId string, movieId string, rating string")
    row = samples.typed_ratings(df).first()
    assert (row.userIdInt, row.movieIdInt, row.ratingFloat) == (1, None, 4.5)


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "items.csv").write_text('movieId,title,genres\n1,"Heat, ""The"" (1995)",Action|Crime\n', "utf-8")
    row = files.read_items(spark, str(tmp_path / "items.csv")).first()
    assert tuple(row) == (1, 'Heat, "The" (1995)', "Action|Crime")


def test_read_samples_fills_and_skips(spark, tmp_path):
    schema = files.T.StructType([files.SAMPLES_SCHEMA[c] for c in ("movieId", "rating", "movieGenre1")])
    (tmp_path / "s.csv").write_text("movieId,rating,movieGenre1\n1,,0\n2,4.5,\nx,1.0,Drama\n3,0,War\n", "utf-8")
    found = files.read_samples(spark, str(tmp_path / "s.csv"), schema=schema).orderBy("movieId").collect()
    assert [tuple(r) for r in found] == [(1, 0.0, ""), (2, 4.5, ""), (3, 0.0, "War")]
    again = files.read_samples(spark, str(tmp_path / "s.csv"), schema=schema)
    assert again.count() == 3 and len(again.select("rating").collect()) == 3


def test_write_split_samples(spark, tmp_path):
    df = spark.range(100).withColumnRenamed("id", "k")
    write_split_samples(df, str(tmp_path / "out"), ["k"])
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and {r.split for r in back.select("split").distinct().collect()} == {"train", "test"}
    files.write_samples(df, str(tmp_path / "one"), "csv", single_file=True)
    assert len(list((tmp_path / "one").glob("part-*.csv"))) == 1


def test_shuffle_is_a_reproducible_permutation(spark):
    df = spark.range(50)
    once = [r.id for r in files.shuffle_rows(df, ["id"], 3).collect()]
    again = [r.id for r in files.shuffle_rows(df.repartition(5), ["id"], 3).collect()]
    other = [r.id for r in files.shuffle_rows(df, ["id"], 4).collect()]
    assert once == again != other and sorted(once) == list(range(50)) and once != list(range(50))


@pytest.mark.parametrize("path", ["label", "rating"])
def test_label_threshold(spark, path):
    df = samples.label_ratings(spark.createDataFrame([(1, 1, 3.5, 1), (1, 2, 3.0, 2)], SCHEMA))
    assert [r[path] for r in df.orderBy("movieId").collect()] == ([1, 0] if path == "label" else [3.5, 3.0])


def test_item_stats_before_across_cuts(spark):
    import statistics

    # Item 1 and the null item hold most rows; large values show cancellation.
    rows = [(u, [1, 1, 1, None, 2][u % 5], 1e6 + (u * 37 % 11) / 2 if u % 7 else None, u * 13 % 101) for u in range(400)]
    frame = spark.createDataFrame(rows, SCHEMA)
    expected, past = {}, {}
    for u, m, r, t in sorted(rows, key=lambda x: (x[3], x[2] is not None, x[2] or 0, x[0])):
        seen = past.setdefault(m, [])
        known = [x for x in seen if x is not None]
        mean, sd = sum(known) / len(known) if known else 0, statistics.stdev(known) if len(known) > 1 else 0
        expected[u] = (len(seen), mean, sd)
        seen.append(r)
    for hot_rows in (10**6, 30):
        found = samples.item_stats_before(frame, COLS, hot_rows=hot_rows).collect()
        assert len(found) == 400
        for x in found:
            n, mean, sd = expected[x.userId]
            assert x.movieRatingCount == n
            assert abs(x.movieAvgRating - mean) < 0.0051 and abs(x.movieRatingStddev - sd) < 0.0051
    plan = samples.item_stats_before(frame, COLS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert samples.item_stats_before(frame.limit(0), COLS).count() == 0


def test_point_in_time_samples(spark):
    ratings = [(u, m, 1.0 + u % 4, 10 * m + u) for u in range(6) for m in range(5)]
    items = [(m, f"T ({2000 + m})", "A|B") for m in range(4)]
    whole, past = build(spark, ratings, items), build(spark, ratings, items, point_in_time=True)
    assert set(whole) == set(past)
    assert all(whole[k].movieRatingCount == 6 and past[k].movieRatingCount == k[0] for k in whole)
    assert all(whole[k].releaseYear == past[k].releaseYear and whole[k].userGenre1 == past[k].userGenre1 for k in whole)
