"""The four batch jobs end to end, built from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tastemill.columns import RatingColumns
from tastemill.functions.scalars import genre_list, slots
from tastemill.operators import collaborative as cf
from tastemill.operators import embeddings as emb
from tastemill.operators import encoders as enc
from tastemill.operators.history import HISTORY_ROWS, user_features
from tastemill.operators.samples import attach_item_features, hash_split, label_ratings
from tastemill.operators.sequences import item_pairs, user_sequences
from tastemill.operators.skew import HOT_ROWS
from tastemill.operators.snapshots import item_snapshot, user_snapshot
from tastemill.operators.walks import WALK_LENGTH, WALKS, walk_paths
from tastemill.sources.files import SAMPLE_COLUMNS, write_samples


def model_samples(
    ratings: DataFrame,
    items: DataFrame,
    cols: RatingColumns = RatingColumns(),
    *,
    rows: int = HISTORY_ROWS,
    hot_rows: int = HOT_ROWS,
    point_in_time: bool = False,
) -> DataFrame:
    """Labelled ratings with item features and features of the user's past.

    With ``point_in_time``, item statistics too are of the past only.
    The 27 sample columns come first, in file order, followed by those tie
    columns of ``cols`` that are not among them.
    """
    labelled = label_ratings(ratings.select(*cols.all), cols)
    featured = attach_item_features(labelled, items, cols, hot_rows=hot_rows, point_in_time=point_in_time)
    genres = slots(genre_list("genres"), "movieGenre", 3)
    samples = user_features(featured.drop(*genres), cols, rows=rows, hot_rows=hot_rows, counted=ratings, added=genres)
    standard_names = {"movieId": cols.item, "userId": cols.user, "rating": cols.rating, "timestamp": cols.time}
    wide = [standard_names.get(c, c) for c in SAMPLE_COLUMNS]
    return samples.select(*wide, *[c for c in cols.ties if c not in wide])


def write_split_samples(samples: DataFrame, folder: str, keys: list[str], fmt: str = "parquet") -> None:
    """Write samples once, split into ``split=train`` and ``split=test``."""
    write_samples(hash_split(samples, keys), folder, fmt, partition_by=("split",))


def samples_job(
    spark: SparkSession, ratings: DataFrame, items: DataFrame, folder: str, cols: RatingColumns = RatingColumns()
) -> None:
    """Write model samples, then both snapshots.

    The samples are computed once; the snapshots read the written table.
    """
    keys = list(dict.fromkeys([cols.user, *cols.order]))
    write_split_samples(model_samples(ratings, items, cols), f"{folder}/modelSamples", keys)
    samples = spark.read.parquet(f"{folder}/modelSamples")
    write_samples(item_snapshot(samples, cols), f"{folder}/itemFeatures")
    write_samples(user_snapshot(samples, cols), f"{folder}/userFeatures")


def features_job(ratings: DataFrame, items: DataFrame, cols: RatingColumns = RatingColumns()) -> dict[str, DataFrame]:
    """Encoded item ids and genres, and scaled rating statistics."""
    return {
        "oneHot": enc.one_hot(items, cols.item),
        "multiHot": enc.multi_hot(items, cols.item),
        "ratingFeatures": enc.rating_features(ratings, cols),
    }


def embedding_job(
    ratings: DataFrame,
    query_item: object,
    cols: RatingColumns = RatingColumns(),
    *,
    walks: int = WALKS,
    length: int = WALK_LENGTH,
    **options,
) -> dict[str, DataFrame]:
    """Item vectors from sequences and from walks, similar items, user vectors."""
    size = options.get("size", emb.VECTOR_SIZE)
    item_model = emb.fit_item2vec(user_sequences(ratings, cols), **options)
    paths = walk_paths(item_pairs(ratings, cols), walks=walks, length=length)
    graph_model = emb.fit_item2vec(paths, "path", **options)
    item_type = ratings.schema[cols.item].dataType.simpleString()
    vectors = emb.model_vectors(item_model, item_type)
    return {
        "itemVectors": vectors,
        "similarItems": emb.synonyms(item_model, query_item),
        "graphVectors": emb.model_vectors(graph_model, item_type),
        "graphSimilarItems": emb.synonyms(graph_model, query_item),
        "userVectors": emb.user_vectors(ratings, vectors, size, cols),
    }


def collaborative_job(
    ratings: DataFrame, cols: RatingColumns = RatingColumns(), *, folds: int = cf.FOLDS
) -> dict[str, DataFrame]:
    """Factors, test error, top lists and cross-validation."""
    keys = list(dict.fromkeys([cols.user, *cols.order]))
    split = hash_split(ratings, keys)
    train = cf.als_input(split.where("split = 'train'"), cols)
    test = cf.als_input(split.where("split = 'test'"), cols)
    model = cf.fit_als(train)
    rows = cf.als_input(ratings, cols)
    return {
        "userFactors": cf.factors(model, "users"),
        "itemFactors": cf.factors(model, "items"),
        "rmse": cf.rmse_table(model.transform(test)),
        "itemsForUsers": cf.recommend_items(model),
        "usersForItems": cf.recommend_users(model),
        "itemsForSomeUsers": cf.recommend_items(model, users=cf.first_ids(rows, cf.USER)),
        "usersForSomeItems": cf.recommend_users(model, items=cf.first_ids(rows, cf.ITEM)),
        "crossValidation": cf.cross_validate(train, [cf.USER, cf.ITEM], folds=folds),
    }
