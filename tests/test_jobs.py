from tastemill.plans import jobs
from tastemill.sources.files import SAMPLE_COLUMNS

SCHEMA = "userId int, movieId int, rating double, timestamp long"
ITEMS = "movieId int, title string, genres string"


def tables(spark):
    ratings = [(u, (u * 3 + i * 5) % 12, float(i % 5 + 1), 1000 * u + i) for u in range(20) for i in range(12)]
    items = [(m, f"T{m} ({1990 + m})", "Action|Drama" if m % 2 else "Comedy") for m in range(12)]
    return spark.createDataFrame(ratings, SCHEMA), spark.createDataFrame(items, ITEMS)


def test_samples_job(spark, tmp_path):
    ratings, items = tables(spark)
    jobs.samples_job(spark, ratings, items, str(tmp_path))
    samples = spark.read.parquet(str(tmp_path / "modelSamples"))
    assert samples.columns == [*SAMPLE_COLUMNS, "split"] and samples.count() == 20 * 10
    assert spark.read.parquet(str(tmp_path / "userFeatures")).count() == 20
    assert spark.read.parquet(str(tmp_path / "itemFeatures")).count() == 12


def test_features_job(spark):
    ratings, items = tables(spark)
    found = jobs.features_job(ratings, items)
    assert {name: df.count() for name, df in found.items()} == {"oneHot": 12, "multiHot": 12, "ratingFeatures": 12}


def test_embedding_job(spark):
    ratings, _ = tables(spark)
    found = jobs.embedding_job(ratings, 3, walks=40, length=4, iterations=1, size=5)
    assert {len(r.vector) for r in found["userVectors"].collect()} == {5}
    assert found["itemVectors"].schema["item"].dataType.simpleString() == "int"
    assert found["similarItems"].where("item = '3'").isEmpty()
    assert found["graphVectors"].count() > 0 and found["graphSimilarItems"].count() > 0


def test_collaborative_job(spark):
    ratings, _ = tables(spark)
    found = jobs.collaborative_job(ratings, folds=2)
    assert found["itemsForUsers"].count() == 20 and found["usersForItems"].count() == 12
    assert found["itemsForSomeUsers"].count() == 3 and found["usersForSomeItems"].count() == 3
    assert found["rmse"].first().rmse >= 0 and found["crossValidation"].count() == 2
