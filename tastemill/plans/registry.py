"""Every operator as a named query over the TPC-H-like tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALSModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tastemill.operators import collaborative as cf
from tastemill.operators import ctr_features as ctr
from tastemill.operators import ctr_models as models
from tastemill.operators import embeddings as emb
from tastemill.operators import encoders as enc
from tastemill.operators import history, samples, sequences, snapshots, walks
from tastemill.operators import als_sums, pmi_vectors, vector_index
from tastemill.operators.neighbours import best_matches, pruned_matches, similar_items_batch
from tastemill.operators.pair_factors import fit_pair_factors
from tastemill.plans.jobs import model_samples
from tastemill.session import ensure_checkpoint_dir, shared_dir
from tastemill.sources import files
from tastemill.sources.tables import (
    EVENT_RATINGS,
    LINE_RATINGS,
    event_ratings,
    item_vectors,
    line_ratings,
    part_items,
)

Query = Callable[[SparkSession, str], DataFrame]

# Genres of the part items as a closed vocabulary, leaving out "small" and "widget".
PART_GENRES = [
    "ECONOMY",
    "LARGE",
    "MEDIUM",
    "PROMO",
    "SMALL",
    "STANDARD",
    "anvil",
    "blue",
    "bolt",
    "cold",
    "gear",
    "gizmo",
    "hot",
    "large",
    "new",
    "old",
    "plate",
    "red",
    "ring",
    "rod",
]

# What identifies an order line without its floating-point columns.
LINE_KEYS = ["orderKey", "lineNumber", "movieId", "suppKey"]
STORED_VECTOR_SIZE = 64
QUERY_ITEM = 158
# Batch searches ask for every row whose id is divisible by this.
QUERY_STEP = 100
# Walks that DeepWalk trains on, for each item that a walk can start from.
WALKS_PER_ITEM = 20
# Numbers of a stored vector that stand for an item's factors.
STORED_FACTORS = 2
# The share of the exact lists that the index must find.
LEAST_RECALL = 0.9
CV_GRID = [{"regularization": cf.REGULARIZATION}]


def text(array: str) -> Column:
    """An array as comma-separated text."""
    return F.array_join(F.col(array).cast("array<string>"), ",")


def vector_parts(vector: str) -> Column:
    """Size, indexes and values of an ML vector as a struct."""
    schema = "v struct<size: int, indices: array<int>, values: array<double>>"
    return F.from_json(F.to_json(F.struct(F.col(vector).alias("v"))), schema)["v"]


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    return samples.label_ratings(line_ratings(spark, folder), LINE_RATINGS)


def featured(spark: SparkSession, folder: str) -> DataFrame:
    items = part_items(spark, folder)
    ratings = labelled(spark, folder).select(*LINE_RATINGS.all, "label")
    return samples.attach_item_features(ratings, items, LINE_RATINGS)


def line_samples(spark: SparkSession, folder: str) -> DataFrame:
    return model_samples(line_ratings(spark, folder), part_items(spark, folder), LINE_RATINGS)


# Sources and projections -----------------------------------------------------


def ratings_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-ratings-csv"
    ratings = line_ratings(spark, folder).select(files.RATINGS_SCHEMA.fieldNames())
    files.write_samples(ratings, path, "csv")
    return files.read_ratings(spark, path)


def items_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-items-csv"
    files.write_samples(part_items(spark, folder), path, "csv")
    return files.read_items(spark, path)


def training_samples_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-samples-csv"
    # As plain text the samples take more room than all else.
    files.write_samples(line_samples(spark, folder).select(files.SAMPLE_COLUMNS), path, "csv", compression="gzip")
    return files.read_samples(spark, path)


def model_samples_parquet(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-samples-parquet"
    split = samples.hash_split(line_samples(spark, folder), LINE_KEYS)
    files.write_samples(split.select(*files.SAMPLE_COLUMNS, "split"), path, partition_by=("split",))
    return spark.read.parquet(path).select("movieId", "userId", "timestamp", "rating", "userRatingCount", "split")


def shuffled_rows(spark: SparkSession, folder: str) -> DataFrame:
    ratings = line_ratings(spark, folder).select(*LINE_KEYS, "rating")
    return files.shuffle_rows(ratings, LINE_KEYS, seed=7)


def typed_ratings(spark: SparkSession, folder: str) -> DataFrame:
    written = line_ratings(spark, folder).select(
        F.col("userId").cast("string").alias("userId"),
        F.concat_ws("-", "movieId", F.when(F.col("lineNumber") == 1, F.lit("x"))).alias("movieId"),
        F.col("rating").cast("string").alias("rating"),
    )
    return samples.typed_ratings(written).select("userIdInt", "movieIdInt", "ratingFloat")


def label_ratings(spark: SparkSession, folder: str) -> DataFrame:
    return labelled(spark, folder).select(*LINE_KEYS, "userId", "rating", "label")


def positive_ratings(spark: SparkSession, folder: str) -> DataFrame:
    return samples.positive_ratings(line_ratings(spark, folder)).select(*LINE_KEYS, "userId", "rating")


def release_year(spark: SparkSession, folder: str) -> DataFrame:
    return samples.with_release_year(part_items(spark, folder)).select("movieId", "title", "releaseYear")


def genre_columns(spark: SparkSession, folder: str) -> DataFrame:
    return samples.with_genre_columns(part_items(spark, folder)).drop("title")


def genre_explode(spark: SparkSession, folder: str) -> DataFrame:
    return samples.explode_genres(part_items(spark, folder)).select("movieId", "genre")


# Statistics, joins, windows --------------------------------------------------


def item_rating_stats(spark: SparkSession, folder: str) -> DataFrame:
    stats = samples.item_rating_stats(line_ratings(spark, folder))
    return stats.withColumn("ratingVar", F.round("ratingVar", 6))


def item_model_stats(spark: SparkSession, folder: str) -> DataFrame:
    return samples.item_model_stats(line_ratings(spark, folder))


def attach_items(spark: SparkSession, folder: str) -> DataFrame:
    ratings = line_ratings(spark, folder).select(*LINE_KEYS, "userId", "rating")
    return samples.attach_items(ratings, part_items(spark, folder))


def attach_item_stats(spark: SparkSession, folder: str) -> DataFrame:
    kept = ["movieRatingCount", "movieAvgRating", "movieRatingStddev"]
    return featured(spark, folder).select(*LINE_KEYS, "userId", "rating", *kept)


def item_stats_before(spark: SparkSession, folder: str) -> DataFrame:
    kept = ["movieRatingCount", "movieAvgRating", "movieRatingStddev"]
    return samples.item_stats_before(line_ratings(spark, folder), LINE_RATINGS).select(*LINE_KEYS, "userId", *kept)


def attach_item_stats_before(spark: SparkSession, folder: str) -> DataFrame:
    ratings = labelled(spark, folder).select(*LINE_RATINGS.all, "label")
    seen = samples.attach_item_features(ratings, part_items(spark, folder), LINE_RATINGS, point_in_time=True)
    return seen.select(
        *LINE_KEYS, "userId", "releaseYear", "movieGenre1", "movieGenre2", "movieGenre3", "movieRatingCount", "movieAvgRating"
    )


def user_history(spark: SparkSession, folder: str) -> DataFrame:
    ratings = labelled(spark, folder).select(*LINE_RATINGS.all, "label")
    kept = [f"userRatedMovie{i}" for i in range(1, 6)]
    return history.user_history(ratings, LINE_RATINGS).select(*LINE_KEYS, "userId", *kept)


def _window_stats(spark: SparkSession, folder: str, rows: int) -> DataFrame:
    out = history.user_window_stats(featured(spark, folder), LINE_RATINGS, rows=rows, counted=line_ratings(spark, folder))
    return out.select(*LINE_KEYS, "userId", "userRatingCount", "userAvgReleaseYear", "userReleaseYearStddev",
                      "userAvgRating", "userRatingStddev")


def user_window_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _window_stats(spark, folder, history.HISTORY_ROWS)


def user_window_stats_10(spark: SparkSession, folder: str) -> DataFrame:
    return _window_stats(spark, folder, 10)


def user_genre_prefs(spark: SparkSession, folder: str) -> DataFrame:
    out = history.user_genre_prefs(featured(spark, folder), LINE_RATINGS, counted=line_ratings(spark, folder))
    return out.select(*LINE_KEYS, "userId", *[f"userGenre{i}" for i in range(1, 6)])


def warm_rows(spark: SparkSession, folder: str) -> DataFrame:
    out = history.warm_rows(
        history.user_window_stats(featured(spark, folder), LINE_RATINGS, counted=line_ratings(spark, folder))
    )
    return out.select(*LINE_KEYS, "userId", "userRatingCount")


def full_model_samples(spark: SparkSession, folder: str) -> DataFrame:
    return line_samples(spark, folder).select(files.SAMPLE_COLUMNS)


def item_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.item_snapshot(line_samples(spark, folder), LINE_RATINGS)


def user_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.user_snapshot(line_samples(spark, folder), LINE_RATINGS)


# Encoders --------------------------------------------------------------------


def one_hot(spark: SparkSession, folder: str) -> DataFrame:
    encoded = enc.one_hot(part_items(spark, folder).select("movieId")).withColumn("v", vector_parts("movieIdVector"))
    return encoded.select("movieId", F.col("v.indices")[0].alias("index"), F.col("v.size").alias("size"))


def genre_index(spark: SparkSession, folder: str) -> DataFrame:
    exploded = samples.explode_genres(part_items(spark, folder)).select("movieId", "genre")
    return enc.string_index(exploded, "genre", "genreIndex")


def genre_label_table(spark: SparkSession, folder: str) -> DataFrame:
    return enc.label_index(samples.explode_genres(part_items(spark, folder)), "genre", "genreIndex")


def multi_hot(spark: SparkSession, folder: str) -> DataFrame:
    encoded = enc.multi_hot(part_items(spark, folder)).withColumn("indices", vector_parts("vector")["indices"])
    return encoded.select("movieId", text("genreIndexes").alias("genreIndexes"), "indexSize",
                          text("indices").alias("vectorIndexes"))


def _rating_features(spark: SparkSession, folder: str) -> DataFrame:
    scaled = F.round(vector_to_array("scaleAvgRating")[0], 6).alias("scaleAvgRating")
    features = enc.rating_features(line_ratings(spark, folder))
    return features.select("movieId", "ratingCount", "avgRating", F.round("ratingVar", 6).alias("ratingVar"),
                           vector_to_array("avgRatingVec")[0].alias("avgRatingVec"),
                           F.col("ratingCountBucket").cast("int").alias("ratingCountBucket"), scaled)


def rating_count_bucket(spark: SparkSession, folder: str) -> DataFrame:
    stats = samples.item_rating_stats(line_ratings(spark, folder)).select("movieId", "ratingCount")
    buckets = enc.fit_count_buckets(stats, "ratingCount", "bucket").transform(stats)
    return buckets.select("movieId", "ratingCount", F.col("bucket").cast("int").alias("ratingCountBucket"))


def price_bucket(spark: SparkSession, folder: str) -> DataFrame:
    prices = line_ratings(spark, folder).select(*LINE_KEYS, "price")
    buckets = enc.fit_exact_buckets(prices, "price", "bucket").transform(prices)
    return buckets.select(*LINE_KEYS, F.col("bucket").cast("int").alias("priceBucket"))


def avg_rating_minmax(spark: SparkSession, folder: str) -> DataFrame:
    stats = samples.item_rating_stats(line_ratings(spark, folder)).select("movieId", "avgRating")
    scaled = enc.fit_min_max(stats, "avgRating", "scaled").transform(stats)
    return scaled.select("movieId", F.round(vector_to_array("scaled")[0], 6).alias("scaleAvgRating"))


# Sequences, graph, walks -----------------------------------------------------


def user_sequences(spark: SparkSession, folder: str) -> DataFrame:
    found = sequences.user_sequences(event_ratings(spark, folder), EVENT_RATINGS)
    return sequences.sequence_text(found).drop("movieIds")


def item_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.item_pairs(event_ratings(spark, folder), EVENT_RATINGS)


def order_item_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.item_pairs(line_ratings(spark, folder), LINE_RATINGS)


def transition_probs(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.transition_probs(item_pairs(spark, folder))


def item_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.item_distribution(item_pairs(spark, folder))


def random_walks(spark: SparkSession, folder: str) -> DataFrame:
    return walks.random_walks(item_pairs(spark, folder))


def order_random_walks(spark: SparkSession, folder: str) -> DataFrame:
    return walks.random_walks(order_item_pairs(spark, folder))


# Splits, features and stored scores ------------------------------------------


def hash_split(spark: SparkSession, folder: str) -> DataFrame:
    return samples.hash_split(line_ratings(spark, folder).select(*LINE_KEYS), LINE_KEYS)


def user_vectors(spark: SparkSession, folder: str) -> DataFrame:
    vectors = item_vectors(spark, folder)
    sums = emb.user_vectors(line_ratings(spark, folder), vectors, STORED_VECTOR_SIZE)
    return sums.select("userId", F.posexplode("vector").alias("position", "value")).withColumn(
        "value", F.round("value", 4) + 0.0
    )


def similar_vectors(spark: SparkSession, folder: str) -> DataFrame:
    found = emb.similar_items(item_vectors(spark, folder), QUERY_ITEM)
    return found.withColumn("similarity", F.round("similarity", 6))


def similar_vectors_batch(spark: SparkSession, folder: str) -> DataFrame:
    vectors = item_vectors(spark, folder)
    found = similar_items_batch(vectors.where(F.col("item") % QUERY_STEP == 0), vectors)
    return found.withColumn("similarity", F.round("similarity", 6))


def _catalogue(spark: SparkSession, folder: str) -> tuple[DataFrame, vector_index.VectorIndex | None, int]:
    vectors = item_vectors(spark, folder)
    index = vector_index.fit_index(vectors)
    return vectors, index, vector_index.measured_probes(index) if index else 0


def similar_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """The items similar to every item, by an index of the whole catalogue."""
    vectors, index, probes = _catalogue(spark, folder)
    if index is None:
        return spark.createDataFrame([], "query long, item long, similarity double, rank int")
    return vector_index.search(index, vectors, probes=probes)


def similar_catalogue_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the index finds enough of the exact lists of the ids divisible by 100."""
    vectors, index, probes = _catalogue(spark, folder)
    asked = vectors.where(F.col("item") % QUERY_STEP == 0)
    if index is None:
        return spark.createDataFrame([(0, False)], "queries long, enough boolean")
    measured = vector_index.recall_table(
        vector_index.search(index, asked, probes=probes), similar_items_batch(asked, vectors)
    )
    return measured.select("queries", (F.col("recall") >= LEAST_RECALL).alias("enough"))


def dot_crosses(spark: SparkSession, folder: str) -> DataFrame:
    vectors, items = item_vectors(spark, folder), part_items(spark, folder)
    size = STORED_VECTOR_SIZE
    rows = line_samples(spark, folder).select(*LINE_KEYS, "userId", "movieGenre1", "userGenre1")
    # Each is measured before it is joined, so it is read twice.
    users = emb.user_vectors(line_ratings(spark, folder), vectors, size).withColumnRenamed("userId", "item").persist()
    genres = ctr.genre_vectors(items, vectors, size).persist()
    # The users first, as theirs is the table that grows most: rows without vectors are shuffled.
    rows = emb.attach_vectors(rows, users, "userId", "userVector", size, counted=line_ratings(spark, folder))
    rows = emb.attach_vectors(rows, vectors, "movieId", "itemVector", size, counted=line_ratings(spark, folder))
    rows = emb.attach_vectors(rows, genres, "movieGenre1", "itemGenreVector", size)
    rows = emb.attach_vectors(rows, genres, "userGenre1", "userGenreVector", size)
    crosses = [(F.round(c, 4) + 0.0).alias(name) for name, c in ctr.dot_crosses().items()]
    return rows.select(*LINE_KEYS, "userId", *crosses)


def hashed_cross(spark: SparkSession, folder: str) -> DataFrame:
    crossed = ctr.hashed_cross(["movieId", "userRatedMovie1"]).alias("crossBucket")
    return user_history(spark, folder).select(*LINE_KEYS, "userId", "userRatedMovie1", crossed)


def genre_vocab_lookup(spark: SparkSession, folder: str) -> DataFrame:
    items = samples.with_genre_columns(part_items(spark, folder))
    found = ctr.genre_vocab_lookup(items, ctr.ITEM_GENRES, PART_GENRES)
    return found.select("movieId", *[F.col(f"{c}Index").cast("int").alias(f"{c}Index") for c in ctr.ITEM_GENRES])


def genre_indicators(spark: SparkSession, folder: str) -> DataFrame:
    items = samples.with_genre_columns(part_items(spark, folder))
    found = ctr.genre_indicators(items, ctr.ITEM_GENRES, PART_GENRES)
    slots = [text_of_vector(f"{c}IndexVec").alias(f"{c}Slots") for c in ctr.ITEM_GENRES]
    return found.select("movieId", *slots)


def text_of_vector(vector: str) -> Column:
    """Filled slots of a sparse vector and its size as text."""
    parts = vector_parts(vector)
    return F.concat_ws("/", F.array_join(parts["indices"].cast("array<string>"), ","), parts["size"].cast("string"))


def id_bucket(spark: SparkSession, folder: str) -> DataFrame:
    ratings = line_ratings(spark, folder)
    largest = ratings.agg(F.max("movieId")).first()[0]
    bucket = ctr.id_bucket("movieId", (largest or 0) + 1).alias("bucket")
    return ratings.select(*LINE_KEYS, bucket)


def rating_rmse(spark: SparkSession, folder: str) -> DataFrame:
    predicted = featured(spark, folder).select("rating", F.col("movieAvgRating").alias("prediction"))
    return cf.rmse_table(predicted, label="rating").select(F.round("rmse", 6).alias("rmse"))


def score_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    score = (F.col("movieAvgRating") / 5).alias("score")
    scored = featured(spark, folder).select("label", score, F.when(F.col("movieAvgRating") >= 2.5, 1)
                                            .otherwise(0).alias("prediction"))
    out = models.evaluation_table(scored)
    return out.select(F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"))


def distinct_users(spark: SparkSession, folder: str) -> DataFrame:
    return line_ratings(spark, folder).select("userId").distinct()


def numeric_vector(spark: SparkSession, folder: str) -> DataFrame:
    rows = line_samples(spark, folder)
    assembled = VectorAssembler(inputCols=ctr.NUMBERS, outputCol="v").transform(rows)
    values = [vector_to_array("v")[i].alias(f"x{i}") for i in range(len(ctr.NUMBERS))]
    return assembled.select(*LINE_KEYS, "userId", *values)


def pretrained_columns(spark: SparkSession, folder: str) -> DataFrame:
    ratings = line_ratings(spark, folder).select(*LINE_KEYS, "userId")
    vectors = item_vectors(spark, folder)
    rows = emb.attach_vectors(ratings, vectors, "movieId", "itemVector", STORED_VECTOR_SIZE)
    values = [F.round(F.col("itemVector")[i], 6).alias(f"x{i}") for i in range(4)]
    return rows.select(*LINE_KEYS, "userId", F.size("itemVector").alias("size"), *values)


def first_users(spark: SparkSession, folder: str) -> DataFrame:
    return cf.first_ids(line_ratings(spark, folder), "userId")


# Trained models --------------------------------------------------------------


def _als_rows(spark: SparkSession, folder: str) -> DataFrame:
    ratings = samples.hash_split(line_ratings(spark, folder), LINE_KEYS)
    return cf.als_input(ratings, keep=("split", "orderKey", "lineNumber", "suppKey"))


def _als(spark: SparkSession, folder: str) -> tuple[ALSModel, DataFrame]:
    rows = _als_rows(spark, folder)
    return cf.fit_als(rows.where("split = 'train'")), rows


def finite(column: str | Column) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.abs(value) < F.lit(float("inf")), F.lit(False))


def vector_check(vectors: DataFrame) -> DataFrame:
    """Whose vectors there are, how long they are and whether all their numbers are finite."""
    return vectors.select("item", F.size("vector").alias("size"), F.forall("vector", finite).alias("finite"))


def list_check(lists: DataFrame, known: DataFrame) -> DataFrame:
    """Top lists as ``(id, rank)`` and what must hold for every entry.

    The entry is among the ids that have factors, its score is not above that of
    the entry before it, and it occurs once in its list.
    """
    by_rank = Window.partitionBy("id").orderBy("rank")
    ids = known.select(F.col("item").cast("int").alias("recommended"), F.lit(True).alias("found"))
    return lists.join(ids, "recommended", "left").select(
        "id",
        "rank",
        F.coalesce("found", F.lit(False)).alias("known"),
        F.coalesce(F.lag("score").over(by_rank) >= F.col("score"), F.lit(True)).alias("descending"),
        (F.count(F.lit(1)).over(Window.partitionBy("id", "recommended")) == 1).alias("once"),
    )


def als_scores(spark: SparkSession, folder: str) -> DataFrame:
    model, ratings = _als(spark, folder)
    scored = model.transform(ratings.where("split = 'test'"))
    return scored.select("orderKey", "lineNumber", "suppKey", cf.USER, cf.ITEM, cf.RATING,
                         finite("prediction").alias("finite"))


def als_rmse(spark: SparkSession, folder: str) -> DataFrame:
    model, ratings = _als(spark, folder)
    scored = model.transform(ratings.where("split = 'test'")).persist()
    rows = scored.agg(F.count(F.lit(1)).alias("scored"))
    found = rows.crossJoin(cf.rmse_table(scored)).select("scored", finite("rmse").alias("finite")).collect()
    scored.unpersist()
    return spark.createDataFrame(found, "scored long, finite boolean")


def als_item_factors(spark: SparkSession, folder: str) -> DataFrame:
    return vector_check(cf.factors(_als(spark, folder)[0], "items"))


def als_user_factors(spark: SparkSession, folder: str) -> DataFrame:
    return vector_check(cf.factors(_als(spark, folder)[0], "users"))


def als_top_items(spark: SparkSession, folder: str) -> DataFrame:
    model, _ = _als(spark, folder)
    return list_check(cf.ranked(cf.recommend_items(model)), cf.factors(model, "items"))


def als_top_users(spark: SparkSession, folder: str) -> DataFrame:
    model, _ = _als(spark, folder)
    return list_check(cf.ranked(cf.recommend_users(model)), cf.factors(model, "users"))


def als_user_subset(spark: SparkSession, folder: str) -> DataFrame:
    model, ratings = _als(spark, folder)
    lists = cf.ranked(cf.recommend_items(model, users=cf.first_ids(ratings, cf.USER)))
    return list_check(lists, cf.factors(model, "items"))


def als_item_subset(spark: SparkSession, folder: str) -> DataFrame:
    model, ratings = _als(spark, folder)
    lists = cf.ranked(cf.recommend_users(model, items=cf.first_ids(ratings, cf.ITEM)))
    return list_check(lists, cf.factors(model, "users"))


def als_cv(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["orderKey", "lineNumber", cf.ITEM, "suppKey"]
    errors = cf.cross_validate(_als_rows(spark, folder).where("split = 'train'"), keys, grid=CV_GRID)
    return errors.select("fold", F.lit(CV_GRID[0]["regularization"]).alias("regularization"),
                         finite("rmse").alias("finite"))


def _deepwalk(ratings: DataFrame, cols) -> emb.Word2VecModel | emb.ItemVectors:
    return emb.deepwalk(ratings, cols, walks_per_item=WALKS_PER_ITEM)


def similar_check(vectors: DataFrame, item: int) -> DataFrame:
    """Ranks of the items similar to ``item`` and what must hold for them."""
    found = emb.similar_items(vectors, item)
    best_first = Window.orderBy(F.col("similarity").desc(), "item")  # twenty rows at most
    known = vectors.where(F.col("item") != item).select("item", F.lit(True).alias("found"))
    return found.join(known, "item", "left").select(
        F.row_number().over(best_first).alias("rank"),
        F.coalesce("found", F.lit(False)).alias("known"),
        F.col("similarity").between(-1 - 1e-9, 1 + 1e-9).alias("inRange"),
        (F.count(F.lit(1)).over(Window.partitionBy("item")) == 1).alias("once"),
    )


def item2vec_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vector_check(emb.model_vectors(emb.item2vec(event_ratings(spark, folder), EVENT_RATINGS)))


def deepwalk_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vector_check(emb.model_vectors(_deepwalk(event_ratings(spark, folder), EVENT_RATINGS)))


def item2vec_user_vectors(spark: SparkSession, folder: str) -> DataFrame:
    ratings = event_ratings(spark, folder)
    vectors = emb.user_vectors(ratings, emb.model_vectors(emb.item2vec(ratings, EVENT_RATINGS)))
    return vectors.select("userId", F.size("vector").alias("size"), F.forall("vector", finite).alias("finite"),
                          F.exists("vector", lambda x: x != 0).alias("filled"))


def similar_items(spark: SparkSession, folder: str) -> DataFrame:
    return similar_check(emb.model_vectors(emb.item2vec(line_ratings(spark, folder), LINE_RATINGS)), QUERY_ITEM)


def deepwalk_similar_items(spark: SparkSession, folder: str) -> DataFrame:
    return similar_check(emb.model_vectors(_deepwalk(line_ratings(spark, folder), LINE_RATINGS)), QUERY_ITEM)


def score_check(model: models.CtrModel, test: DataFrame) -> DataFrame:
    """Every scored row with its label, and whether score and prediction are sound and fit each other."""
    score = F.col("score")
    fits = (F.col("prediction") == 1) == (score > 0.5)
    return model.score(test, LINE_KEYS).select(
        *LINE_KEYS,
        "label",
        F.coalesce(score.between(0, 1), F.lit(False)).alias("inRange"),
        F.coalesce(fits, F.lit(False)).alias("fits"),
    )


def training_frames(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of the click-through models, written down once."""
    ensure_checkpoint_dir(spark)
    rows = samples.hash_split(files.training_rows(line_samples(spark, folder)), LINE_KEYS).checkpoint()
    return rows.where("split = 'train'"), rows.where("split = 'test'")


def word_vectors(spark: SparkSession, folder: str, train: DataFrame) -> models.Vectors:
    """Item vectors from training rows, user vectors as their sums, genre means."""
    vectors = emb.model_vectors(emb.item2vec(train, LINE_RATINGS)).persist()
    users = emb.user_vectors(train, vectors).withColumnRenamed("userId", "item").persist()
    genres = ctr.genre_vectors(part_items(spark, folder), vectors, emb.VECTOR_SIZE).persist()
    return models.Vectors(vectors, users, emb.VECTOR_SIZE, genres)


def mlp_model(spark: SparkSession, folder: str, train: DataFrame) -> models.CtrModel:
    return models.fit_ctr_mlp(train, word_vectors(spark, folder, train), PART_GENRES)


def neural_cf_model(spark: SparkSession, folder: str, train: DataFrame) -> models.CtrModel:
    model = cf.fit_als(cf.als_input(train))
    vectors = models.Vectors(cf.factors(model, "items"), cf.factors(model, "users"), model.rank)
    return models.fit_neural_cf(train, vectors)


def wide_deep_model(spark: SparkSession, folder: str, train: DataFrame) -> models.CtrModel:
    return models.fit_wide_deep(train, word_vectors(spark, folder, train), LINE_KEYS, PART_GENRES)


def fm_model(spark: SparkSession, folder: str, train: DataFrame) -> models.CtrModel:
    return models.fit_deep_fm(train, word_vectors(spark, folder, train), LINE_KEYS, PART_GENRES)


def two_tower_model(spark: SparkSession, folder: str, train: DataFrame) -> models.CtrModel:
    return models.fit_two_tower(train, word_vectors(spark, folder, train), PART_GENRES)


CLICK_MODELS = {
    "ctr_mlp": mlp_model,
    "neural_cf": neural_cf_model,
    "wide_deep": wide_deep_model,
    "fm": fm_model,
    "two_tower": two_tower_model,
}


def click_query(name: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        train, test = training_frames(spark, folder)
        return score_check(CLICK_MODELS[name](spark, folder, train), test)

    return query


def stored_vectors_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Items for users by the dot product of stored item vectors and their sums."""
    items = item_vectors(spark, folder)
    users = emb.user_vectors(line_ratings(spark, folder), items, STORED_VECTOR_SIZE).withColumnRenamed("userId", "item").persist()
    return best_matches(users, items, cf.TOP_K).select(
        F.col("query").alias("userId"), "rank", F.col("item").alias("movieId"), F.round("score", 4).alias("score")
    )


def users_of_items_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Users for items by dot product, without the users whose vectors are too short to be among them."""
    items = item_vectors(spark, folder)
    # Counted, then dealt.
    users = emb.user_vectors(line_ratings(spark, folder), items, STORED_VECTOR_SIZE).withColumnRenamed("userId", "item").persist()
    found = pruned_matches(items.where(F.col("item") % QUERY_STEP == 0), users, cf.TOP_K)
    return found.select(
        F.col("query").alias("movieId"), "rank", F.col("item").alias("userId"), F.round("score", 4).alias("score")
    )


def two_tower_vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Tower vectors of all items and users with training rows, from their latest features."""
    train, _ = training_frames(spark, folder)
    vectors = word_vectors(spark, folder, train)
    model = models.fit_two_tower(train, vectors, PART_GENRES)
    items = snapshots.item_snapshot(train, LINE_RATINGS)
    items = emb.attach_vectors(items, vectors.items, "movieId", "itemArray", vectors.size)
    users = snapshots.user_snapshot(train, LINE_RATINGS)
    users = emb.attach_vectors(users, vectors.users, "userId", "userArray", vectors.size)
    return model.item_vectors(items), model.user_vectors(users)


def two_tower_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Items for users by the dot product of their tower vectors."""
    items, users = two_tower_vectors(spark, folder)
    # Counted, then dealt.
    found = best_matches(users.persist(), items.persist(), cf.TOP_K)
    return found.select(F.col("query").alias("userId"), "rank", F.col("item").alias("movieId"), "score")


# Results of the trained models themselves, which SQL can't repeat.


def als_predictions(spark: SparkSession, folder: str) -> DataFrame:
    model, ratings = _als(spark, folder)
    scored = model.transform(ratings.where("split = 'test'"))
    return scored.select("orderKey", "lineNumber", "suppKey", cf.USER, cf.ITEM, cf.RATING, "prediction")


def als_errors(spark: SparkSession, folder: str) -> DataFrame:
    """The error on training and test rows, beside that of the training mean."""
    model, ratings = _als(spark, folder)
    mean = ratings.where("split = 'train'").agg(F.avg(cf.RATING)).first()[0]
    wrong = lambda guess: F.sqrt(F.avg((guess - F.col(cf.RATING)) * (guess - F.col(cf.RATING))))
    scored = model.transform(ratings)
    return scored.groupBy("split").agg(
        F.count(F.lit(1)).alias("scored"), wrong(F.col("prediction").cast("double")).alias("rmse"), wrong(F.lit(mean)).alias("meanRmse")
    )


def als_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the model's error on its training rows is below that of the mean, as no model without knowledge of them is."""
    errors = als_errors(spark, folder).where("split = 'train'")
    return errors.select("scored", (F.col("rmse") < F.col("meanRmse")).alias("belowMean"))


def als_half_step(spark: SparkSession, folder: str) -> DataFrame:
    """Users' factors from their ratings, while the first numbers of the stored vectors are those of the items."""
    items = item_vectors(spark, folder).withColumn("vector", F.slice("vector", 1, STORED_FACTORS))
    ratings = line_ratings(spark, folder)
    found = als_sums.half_step(ratings, items, "userId", "movieId", "rating", rank=STORED_FACTORS)
    values = [F.round(F.col("vector")[i], 5) + 0.0 for i in range(STORED_FACTORS)]
    return found.select(F.col("item").alias("userId"), values[0].alias("x"), values[1].alias("y"))


def als_sums_errors(spark: SparkSession, folder: str) -> DataFrame:
    """The errors of ``als_errors`` for a model by summed normal equations, with ids of 64 bits."""
    rows = samples.hash_split(line_ratings(spark, folder), LINE_KEYS).select("userId", "movieId", "rating", "split").persist()
    train = rows.where("split = 'train'")
    mean = train.agg(F.avg("rating")).first()[0]
    wrong = lambda guess: F.sqrt(F.avg((guess - F.col("rating")) * (guess - F.col("rating"))))
    scored = als_sums.fit_als_sums(train, "userId", "movieId", "rating").score(rows, "userId", "movieId")
    return scored.groupBy("split").agg(
        F.count(F.lit(1)).alias("scored"), wrong(F.col("prediction")).alias("rmse"), wrong(F.lit(mean)).alias("meanRmse")
    )


def als_item_lists(spark: SparkSession, folder: str) -> DataFrame:
    return cf.ranked(cf.recommend_items(_als(spark, folder)[0]))


def als_item_lists_pruned(spark: SparkSession, folder: str) -> DataFrame:
    return cf.pruned_lists(_als(spark, folder)[0], "items")


def als_user_lists(spark: SparkSession, folder: str) -> DataFrame:
    return cf.ranked(cf.recommend_users(_als(spark, folder)[0]))


def als_fold_errors(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["orderKey", "lineNumber", cf.ITEM, "suppKey"]
    return cf.cross_validate(_als_rows(spark, folder).where("split = 'train'"), keys, grid=CV_GRID)


def item2vec_values(spark: SparkSession, folder: str) -> DataFrame:
    return emb.model_vectors(emb.item2vec(event_ratings(spark, folder), EVENT_RATINGS))


def deepwalk_values(spark: SparkSession, folder: str) -> DataFrame:
    return emb.model_vectors(_deepwalk(event_ratings(spark, folder), EVENT_RATINGS))


def item_information(spark: SparkSession, folder: str) -> DataFrame:
    """How much more often than chance two items are liked near each other."""
    found = pmi_vectors.co_occurrences(sequences.user_sequences(event_ratings(spark, folder), EVENT_RATINGS))
    return pmi_vectors.positive_information(found).select("a", "b", F.round("weight", 6).alias("weight"))


def pmi_item_values(spark: SparkSession, folder: str) -> DataFrame:
    return pmi_vectors.pmi_vectors(sequences.user_sequences(event_ratings(spark, folder), EVENT_RATINGS))


def score_query(name: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        train, test = training_frames(spark, folder)
        return CLICK_MODELS[name](spark, folder, train).score(test, LINE_KEYS)

    return query


def pair_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of the test rows by learnt vectors of items and users alone."""
    train, test = training_frames(spark, folder)
    model = fit_pair_factors(train, ["movieId", "userId"])
    return model.score(test).select(*LINE_KEYS, "userId", "label", "score")


QUERIES: dict[str, Query] = {
    "ratings_csv": ratings_csv,
    "items_csv": items_csv,
    "training_samples_csv": training_samples_csv,
    "model_samples_parquet": model_samples_parquet,
    "shuffled_rows": shuffled_rows,
    "typed_ratings": typed_ratings,
    "label_ratings": label_ratings,
    "positive_ratings": positive_ratings,
    "release_year": release_year,
    "genre_columns": genre_columns,
    "genre_explode": genre_explode,
    "item_rating_stats": item_rating_stats,
    "item_model_stats": item_model_stats,
    "attach_items": attach_items,
    "attach_item_stats": attach_item_stats,
    "item_stats_before": item_stats_before,
    "attach_item_stats_before": attach_item_stats_before,
    "user_history": user_history,
    "user_window_stats": user_window_stats,
    "user_window_stats_10": user_window_stats_10,
    "user_genre_prefs": user_genre_prefs,
    "warm_rows": warm_rows,
    "model_samples": full_model_samples,
    "item_snapshot": item_snapshot,
    "user_snapshot": user_snapshot,
    "one_hot": one_hot,
    "genre_index": genre_index,
    "genre_label_table": genre_label_table,
    "multi_hot": multi_hot,
    "rating_count_bucket": rating_count_bucket,
    "price_bucket": price_bucket,
    "avg_rating_minmax": avg_rating_minmax,
    "rating_features": _rating_features,
    "user_sequences": user_sequences,
    "item_pairs": item_pairs,
    "order_item_pairs": order_item_pairs,
    "transition_probs": transition_probs,
    "item_distribution": item_distribution,
    "random_walks": random_walks,
    "order_random_walks": order_random_walks,
    "hash_split": hash_split,
    "user_vectors": user_vectors,
    "similar_vectors": similar_vectors,
    "similar_vectors_batch": similar_vectors_batch,
    "similar_catalogue": similar_catalogue,
    "similar_catalogue_recall": similar_catalogue_recall,
    "dot_crosses": dot_crosses,
    "hashed_cross": hashed_cross,
    "genre_vocab_lookup": genre_vocab_lookup,
    "genre_indicators": genre_indicators,
    "id_bucket": id_bucket,
    "rating_rmse": rating_rmse,
    "score_evaluation": score_evaluation,
    "first_users": first_users,
    "distinct_users": distinct_users,
    "numeric_vector": numeric_vector,
    "pretrained_columns": pretrained_columns,
    "als_scores": als_scores,
    "als_rmse": als_rmse,
    "als_item_factors": als_item_factors,
    "als_user_factors": als_user_factors,
    "als_top_items": als_top_items,
    "als_top_users": als_top_users,
    "als_user_subset": als_user_subset,
    "als_item_subset": als_item_subset,
    "als_cv": als_cv,
    "item2vec_vectors": item2vec_vectors,
    "deepwalk_vectors": deepwalk_vectors,
    "item2vec_user_vectors": item2vec_user_vectors,
    "similar_items": similar_items,
    "deepwalk_similar_items": deepwalk_similar_items,
    "ctr_mlp": click_query("ctr_mlp"),
    "neural_cf": click_query("neural_cf"),
    "wide_deep": click_query("wide_deep"),
    "fm": click_query("fm"),
    "two_tower": click_query("two_tower"),
    "stored_vectors_topk": stored_vectors_topk,
    "users_of_items_topk": users_of_items_topk,
    "two_tower_topk": two_tower_topk,
    "als_predictions": als_predictions,
    "als_errors": als_errors,
    "als_fit": als_fit,
    "als_half_step": als_half_step,
    "als_sums_errors": als_sums_errors,
    "als_item_lists": als_item_lists,
    "als_item_lists_pruned": als_item_lists_pruned,
    "als_user_lists": als_user_lists,
    "als_fold_errors": als_fold_errors,
    "item_information": item_information,
    "pmi_item_values": pmi_item_values,
    "item2vec_values": item2vec_values,
    "deepwalk_values": deepwalk_values,
    "pair_scores": pair_scores,
    **{f"{name}_scores": score_query(name) for name in CLICK_MODELS},
}
