import math

import pytest
from pyspark.sql import functions as F

from tastemill.operators import collaborative as cf
from tastemill.operators import ctr_models as models
from tastemill.operators import samples
from tastemill.plans import registry as reg


@pytest.fixture(scope="module")
def ratings(spark):
    rows = [(u, i, float((u * i) % 5 + 1), u * 100 + i) for u in range(30) for i in range(20) if (u + i) % 3]
    return spark.createDataFrame(rows, "userId long, movieId long, rating double, timestamp long").persist()


@pytest.fixture(scope="module")
def model(ratings):
    return cf.fit_als(cf.als_input(ratings))


def test_als_beats_the_mean_on_training_rows(ratings, model):
    error = cf.rmse(model.transform(cf.als_input(ratings)))
    spread = ratings.agg(F.stddev_pop("rating")).first()[0]
    assert math.isfinite(error) and error < spread


def test_rmse_forms_agree(ratings, model):
    scored = model.transform(cf.als_input(ratings))
    assert abs(cf.rmse(scored) - cf.rmse_table(scored).first().rmse) < 1e-9


def test_unknown_users_are_dropped(spark, model):
    unseen = spark.createDataFrame([(999, 1, 3.0), (1, 1, 3.0)], "userIdInt int, movieIdInt int, ratingFloat double")
    assert [r.userIdInt for r in model.transform(unseen).collect()] == [1]


@pytest.mark.parametrize("side", ["items", "users"])
def test_top_k_lists(ratings, model, side):
    recommend = cf.recommend_items if side == "items" else cf.recommend_users
    found = cf.ranked(recommend(model, 10)).collect()
    per_id = {}
    for r in sorted(found, key=lambda r: (r.id, r["rank"])):
        per_id.setdefault(r.id, []).append(r)
    assert len(per_id) == (30 if side == "items" else 20)
    for entries in per_id.values():
        scores = [r.score for r in entries]
        assert len(entries) == 10 == len({r.recommended for r in entries}) and scores == sorted(scores, reverse=True)


def test_subset_lists_are_those_of_the_full_run(ratings, model):
    some = cf.first_ids(cf.als_input(ratings), cf.USER)
    assert [r[0] for r in some.collect()] == [0, 1, 2]
    subset = cf.ranked(cf.recommend_items(model, 5, some))
    full = cf.ranked(cf.recommend_items(model, 5)).where("id < 3")
    def key(df):
        return sorted((r.id, r["rank"], r.recommended) for r in df.collect())

    assert key(subset) == key(full) and len(key(subset)) == 15


def test_factor_tables(model):
    assert {len(r.vector) for r in cf.factors(model, "users").collect()} == {10}
    assert cf.factors(model, "items").count() == 20


def test_cross_validation_has_a_finite_error_per_fold(spark, ratings):
    once = spark.createDataFrame([(500, 3, 4.0, 1)], ratings.schema)
    data = cf.als_input(ratings.union(once))
    found = cf.cross_validate(data, [cf.USER, cf.ITEM], folds=3, iterations=2).collect()
    assert [r.fold for r in found] == [0, 1, 2] and all(math.isfinite(r.rmse) for r in found)


def test_evaluation_forms_agree(spark):
    rows = [(1, 0.9, 1), (0, 0.2, 0), (1, 0.4, 0), (0, 0.6, 1)]
    scored = spark.createDataFrame(rows, "label int, score double, prediction int")
    found, table = models.evaluate(scored), models.evaluation_table(scored).first()
    assert abs(found["loss"] - table.loss) < 1e-9 and found["accuracy"] == table.accuracy == 0.5


@pytest.mark.parametrize("name", ["ctr_mlp", "wide_deep", "fm", "two_tower"])
def test_click_models_learn_what_there_is_to_learn(spark, folder, name):
    train, test = (
        df.withColumn("label", (F.col("movieAvgRating") >= 2.75).cast("int"))
        for df in reg.training_frames(spark, folder)
    )
    scored = reg.CLICK_MODELS[name](spark, folder, train).score(test, reg.LINE_KEYS).persist()
    assert scored.count() == test.count()
    share = scored.agg(F.avg("label")).first()[0]
    assert models.evaluate(scored)["accuracy"] > max(share, 1 - share) + 0.05
    scored.unpersist()


def test_first_order_terms_come_from_all_training_rows(spark, folder):
    train, test = reg.training_frames(spark, folder)
    # One user likes everything and occurs only in rows that the output layer is not fitted on.
    held = samples.split_bucket([*reg.LINE_KEYS, "label"]) < 20
    fan = train.agg(F.min("userId")).first()[0]
    rows = train.withColumn("label", F.when(F.col("userId") == fan, 1).otherwise(F.col("label")))
    rows = rows.where((F.col("userId") != fan) | ~held)
    vectors = reg.word_vectors(spark, folder, rows)
    model = models.fit_deep_fm(rows, vectors, reg.LINE_KEYS, reg.PART_GENRES, epochs=4)
    asked = test.limit(20)
    seen = model.transform(asked.withColumn("userId", F.lit(fan))).agg(F.avg("firstScore")).first()[0]
    unseen = model.transform(asked.withColumn("userId", F.lit(-5).cast("long"))).agg(F.avg("firstScore")).first()[0]
    assert seen > unseen + 0.01


def test_cross_validation_picks_the_better_setting(ratings):
    data = cf.als_input(ratings)
    grid = [{"regularization": 50.0}, {"regularization": 0.01}]
    errors = cf.cross_validate(data, [cf.USER, cf.ITEM], folds=2, grid=grid, iterations=2)
    assert sorted((r.setting, r.fold) for r in errors.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    best = cf.fit_best(data, errors, grid, iterations=2)
    plain = cf.fit_als(data, iterations=2)
    assert abs(cf.rmse(best.transform(data)) - cf.rmse(plain.transform(data))) < 1e-6


def test_ids_beyond_32_bits_are_kept(spark):
    far = 2**40
    rows = [(far + u, far + i, float((u + i) % 5), u) for u in range(6) for i in range(5)]
    ratings = spark.createDataFrame(rows, "userId long, movieId long, rating double, timestamp long")
    with pytest.raises(Exception, match="beyond 32 bits"):
        cf.als_input(ratings).collect()
    numbered, users = cf.dense_ids(ratings, "userId")
    numbered, items = cf.dense_ids(numbered, "movieId")
    data = cf.als_input(numbered)
    assert data.count() == len(rows)
    model = cf.fit_als(data, rank=2, iterations=2)
    top = cf.ranked(cf.recommend_items(model, 2))
    found = cf.original_ids(cf.original_ids(top, "id", users), "recommended", items).collect()
    assert {r.id for r in found} == {r[0] for r in rows} and len(found) == 12
    assert {r.recommended for r in found} <= {r[1] for r in rows}


def test_folds_keep_what_models_read_and_als_clears_its_files(ratings, monkeypatch):
    data = cf.als_input(ratings, keep=("timestamp",))
    rows, intervals = [], []
    fit, als = cf.fit_als, cf.ALS
    monkeypatch.setattr(cf, "fit_als", lambda df, **options: rows.append(set(df.columns)) or fit(df, **options))
    monkeypatch.setattr(cf, "ALS", lambda **options: intervals.append(options.get("checkpointInterval")) or als(**options))
    assert cf.cross_validate(data, [cf.USER, cf.ITEM], folds=2, iterations=2).count() == 2
    assert rows == [{cf.USER, cf.ITEM, cf.RATING, "__fold"}] * 2 and intervals == [1, 1]
