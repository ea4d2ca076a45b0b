"""Labels, item metadata and item statistics."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.columns import RatingColumns
from tastemill.functions.scalars import (
    DEFAULT_YEAR,
    POSITIVE_RATING,
    draw,
    genre_list,
    label,
    release_year,
    slots,
    two_digits,
)
from tastemill.operators.skew import (
    HOT_ROWS,
    OFFSET,
    drop_helper_columns,
    group_window,
    lookup_join,
    moments_before_chunk,
    ordered_groups,
)


def typed_ratings(df: DataFrame, cols: RatingColumns = RatingColumns()) -> DataFrame:
    """Cast text ids and ratings; what does not parse becomes null."""
    return df.withColumns(
        {
            f"{cols.user}Int": F.col(cols.user).try_cast("int"),
            f"{cols.item}Int": F.col(cols.item).try_cast("int"),
            f"{cols.rating}Float": F.col(cols.rating).try_cast("double"),
        }
    )


def label_ratings(
    df: DataFrame, cols: RatingColumns = RatingColumns(), threshold: float = POSITIVE_RATING
) -> DataFrame:
    """Add ``label``: 1 where the rating reaches ``threshold``."""
    return df.withColumn("label", label(cols.rating, threshold))


def positive_ratings(
    df: DataFrame, cols: RatingColumns = RatingColumns(), threshold: float = POSITIVE_RATING
) -> DataFrame:
    """Keep ratings that reach ``threshold``."""
    return df.where(F.col(cols.rating) >= threshold)


def with_release_year(items: DataFrame, title: str = "title") -> DataFrame:
    return items.withColumn("releaseYear", release_year(title))


def with_genre_columns(items: DataFrame, genres: str = "genres", n: int = 3) -> DataFrame:
    return items.withColumns(slots(genre_list(genres), "movieGenre", n))


def explode_genres(items: DataFrame, genres: str = "genres", name: str = "genre") -> DataFrame:
    """One row per item and genre; items without a genre list have none."""
    return items.withColumn(name, F.explode(genre_list(genres)))


def attach_items(
    ratings: DataFrame, items: DataFrame, cols: RatingColumns = RatingColumns(), *, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add item metadata to ratings; a rating of an unknown item stays."""
    return lookup_join(ratings, items, cols.item, hot_rows=hot_rows)


def item_rating_stats(ratings: DataFrame, cols: RatingColumns = RatingColumns()) -> DataFrame:
    """Count, mean and sample variance of each item's ratings."""
    return ratings.groupBy(cols.item).agg(
        F.count(F.lit(1)).alias("ratingCount"),
        F.avg(cols.rating).alias("avgRating"),
        F.var_samp(cols.rating).alias("ratingVar"),
    )


def item_model_stats(ratings: DataFrame, cols: RatingColumns = RatingColumns()) -> DataFrame:
    """Item statistics as used in model samples: two decimals, 0 for one rating."""
    return (
        ratings.groupBy(cols.item)
        .agg(
            F.count(F.lit(1)).alias("movieRatingCount"),
            F.avg(cols.rating).alias("movieAvgRating"),
            F.stddev_samp(cols.rating).alias("movieRatingStddev"),
        )
        .na.fill(0, ["movieAvgRating", "movieRatingStddev"])
        .withColumns({c: two_digits(c) for c in ("movieAvgRating", "movieRatingStddev")})
    )


def item_stats_before(
    ratings: DataFrame,
    cols: RatingColumns = RatingColumns(),
    *,
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add to each rating the statistics of the item's earlier ratings.

    The columns and their rounding are those of ``item_model_stats``, but no row
    sees itself or the future, so that they can be used to train and to test.
    Earlier means before in the order of time, ties and user. An item's first
    rating has count, mean and deviation 0; null ratings count as rows only. One
    shuffle and one window; an item of more than ``hot_rows`` ratings is cut into
    chunks, each of which continues from the moments of those before it.
    """
    order = list(dict.fromkeys([*cols.order, cols.user]))
    # No rows are copied across cuts: what lies before a chunk is known from its moments.
    grouped = ordered_groups(ratings, [cols.item], order, 0, hot_rows=hot_rows, counted=counted)
    grouped = moments_before_chunk(grouped, [cols.item], cols.rating)
    w = group_window([cols.item], order).rowsBetween(Window.unboundedPreceding, -1)
    seen = grouped.select(
        "*",
        (F.count(F.lit(1)).over(w) + F.col(OFFSET)).alias("movieRatingCount"),
        F.count(cols.rating).over(w).alias("__n"),
        F.avg(cols.rating).over(w).alias("movieAvgRating"),
        F.var_pop(cols.rating).over(w).alias("__var"),
        F.stddev_samp(cols.rating).over(w).alias("movieRatingStddev"),
    )
    n, n0, step = F.col("__n"), F.col("__n0"), F.col("movieAvgRating") - F.col("__mean0")
    share = n / (n + n0)
    mean = F.col("__mean0") + F.coalesce(step * share, F.lit(0.0))
    squares = F.col("__m20") + F.coalesce(F.col("__var") * n + step * step * n0 * share, F.lit(0.0))
    deviation = F.when(n + n0 > 1, F.sqrt(squares / (n + n0 - 1)))
    merged = seen.withColumns(
        {
            "movieAvgRating": F.when(n0.isNull(), F.col("movieAvgRating")).otherwise(mean),
            "movieRatingStddev": F.when(n0.isNull(), F.col("movieRatingStddev")).otherwise(deviation),
        }
    )
    return (
        drop_helper_columns(merged.drop("__n", "__var", "__n0", "__mean0", "__m20"))
        .na.fill(0, ["movieAvgRating", "movieRatingStddev"])
        .withColumns({c: two_digits(c) for c in ("movieAvgRating", "movieRatingStddev")})
    )


def item_metadata(items: DataFrame, cols: RatingColumns = RatingColumns()) -> DataFrame:
    """Year and genres of every item."""
    metadata = items.select(cols.item, release_year("title").alias("__year"), "genres")
    return metadata.withColumns(slots(genre_list("genres"), "movieGenre", 3))


def item_profile(ratings: DataFrame, items: DataFrame, cols: RatingColumns = RatingColumns()) -> DataFrame:
    """Year, genres and statistics of every rated item.

    Metadata and statistics are joined while they hold one row per item, so that
    the much larger ratings table is joined only once.
    """
    metadata = items.select(cols.item, release_year("title").alias("__year"), "genres")
    return (
        item_model_stats(ratings, cols)
        .join(metadata, cols.item, "left")
        .withColumns(
            {
                "releaseYear": F.coalesce(F.col("__year"), F.lit(DEFAULT_YEAR)),
                **slots(genre_list("genres"), "movieGenre", 3),
            }
        )
        .drop("__year")
    )


def attach_item_features(
    labelled: DataFrame,
    items: DataFrame,
    cols: RatingColumns = RatingColumns(),
    *,
    hot_rows: int = HOT_ROWS,
    point_in_time: bool = False,
) -> DataFrame:
    """Add each item's year, genres and statistics to labelled ratings.

    The statistics are of all the item's ratings or, with ``point_in_time``, of
    those before the row's own.
    """
    if point_in_time:
        seen = lookup_join(
            item_stats_before(labelled, cols, hot_rows=hot_rows), item_metadata(items, cols), cols.item, hot_rows=hot_rows
        )
        return seen.withColumn("releaseYear", F.coalesce(F.col("__year"), F.lit(DEFAULT_YEAR))).drop("__year")
    # Held because its size decides the join, which then reads it again.
    profile = item_profile(labelled, items, cols).persist(StorageLevel.MEMORY_AND_DISK)
    # The profile counts the item's rows, so the join needn't.
    return lookup_join(labelled, profile, cols.item, hot_rows=hot_rows, counted="movieRatingCount")


def split_bucket(keys: list[str]) -> Column:
    """A reproducible number from 0 to 99 for a row."""
    return draw(*[F.col(k) for k in keys]) % 100


def hash_split(df: DataFrame, keys: list[str], train_percent: int = 80) -> DataFrame:
    """Add ``split``, ``train`` or ``test``, decided by a hash of ``keys``.

    Rows keep their side on every run, on any cluster and after any retry.
    """
    return df.withColumn("split", F.when(split_bucket(keys) < train_percent, "train").otherwise("test"))


def random_split(df: DataFrame, weights: tuple[float, ...] = (0.8, 0.2), seed: int = 42) -> list[DataFrame]:
    """Spark's own sampling split, with a seed."""
    return df.randomSplit(list(weights), seed)
