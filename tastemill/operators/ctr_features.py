"""Feature columns of the click-through models."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder, OneHotEncoderModel, StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.functions.scalars import dot, draw, genre_list
from tastemill.operators.skew import lookup_join

# The genre vocabulary of the models, in index order.
GENRES = [
    "Action",
    "Comedy",
    "Drama",
    "Adventure",
    "Crime",
    "Animation",
    "Horror",
    "Children",
    "Documentary",
    "Mystery",
    "Thriller",
    "Sci-Fi",
    "Fantasy",
    "Western",
    "Musical",
    "Romance",
    "Film-Noir",
    "(no genres listed)",
    "War",
    "IMAX",
]

# Sizes of the identity buckets and of the hashed cross.
MOVIE_BUCKETS = 193_610
USER_BUCKETS = 611
CROSS_BUCKETS = 10_000

ITEM_NUMBERS = ["releaseYear", "movieRatingCount", "movieAvgRating", "movieRatingStddev"]
USER_NUMBERS = [
    "userRatingCount",
    "userAvgReleaseYear",
    "userReleaseYearStddev",
    "userAvgRating",
    "userRatingStddev",
]
NUMBERS = ITEM_NUMBERS + USER_NUMBERS

ITEM_GENRES = [f"movieGenre{i}" for i in range(1, 4)]
USER_GENRES = [f"userGenre{i}" for i in range(1, 6)]
GENRE_COLUMNS = ITEM_GENRES + USER_GENRES


def vocabulary_model(columns: list[str], vocabulary: list[str], suffix: str = "Index") -> StringIndexerModel:
    """Position in a given vocabulary; unknown and missing values get the next index."""
    return StringIndexerModel.from_arrays_of_labels(
        [vocabulary] * len(columns),
        inputCols=columns,
        outputCols=[f"{c}{suffix}" for c in columns],
        handleInvalid="keep",
    )


def genre_vocab_lookup(df: DataFrame, columns: list[str], vocabulary: list[str] | None = None) -> DataFrame:
    """Add ``<column>Index`` for every genre column."""
    return vocabulary_model(columns, vocabulary or GENRES).transform(df)


def id_bucket(column: str, buckets: int, default: int | None = None) -> Column:
    """The id itself as a bucket number.

    An id outside ``[0, buckets)`` is an error, or goes to ``default`` if given.
    """
    value = F.col(column).cast("long")
    inside = (value >= 0) & (value < buckets)
    if default is None:
        message = F.concat(F.lit(f"{column} outside [0, {buckets}): "), F.coalesce(value.cast("string"), F.lit("null")))
        other = F.raise_error(message).cast("long")
    else:
        other = F.lit(default).cast("long")
    return F.when(inside, value).otherwise(other)


def hashed_cross(columns: list[str], buckets: int = CROSS_BUCKETS) -> Column:
    """A bucket for a combination of values, the same on every engine with MD5."""
    return draw(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]) % buckets


def sized(column: str, size: int) -> Column:
    """The column marked as a category index below ``size``."""
    values = {"type": "nominal", "name": column, "num_vals": size}
    return F.col(column).cast("double").alias(column, metadata={"ml_attr": values})


def fit_indicators(df: DataFrame, columns: list[str], *, drop_last: bool, suffix: str = "Vec") -> OneHotEncoderModel:
    """Indicator vectors for index columns whose sizes are known from metadata.

    With ``drop_last`` the last slot, which holds values outside a vocabulary,
    is left out and such values become all zeros.
    """
    return OneHotEncoder(
        inputCols=columns,
        outputCols=[f"{c}{suffix}" for c in columns],
        dropLast=drop_last,
        handleInvalid="error" if drop_last else "keep",
    ).fit(df)


def genre_indicators(df: DataFrame, columns: list[str], vocabulary: list[str] | None = None) -> DataFrame:
    """Add an indicator vector for every genre column."""
    indexed = genre_vocab_lookup(df, columns, vocabulary)
    index = [f"{c}Index" for c in columns]
    return fit_indicators(indexed, index, drop_last=True).transform(indexed)


def id_indicator(df: DataFrame, column: str, size: int) -> DataFrame:
    """Add ``<column>Vec``, an indicator of exactly ``size`` slots."""
    vector = f"{column}Vec"
    marked = df.withColumn(column, sized(column, size))
    encoded = OneHotEncoder(inputCol=column, outputCol=vector, dropLast=False).fit(marked).transform(marked)
    # One name per slot would otherwise be carried through every later plan.
    bare = F.col(vector).alias(vector, metadata={"ml_attr": {"num_attrs": size}})
    return encoded.withColumn(vector, bare)


def genre_vectors(items: DataFrame, vectors: DataFrame, size: int, key: str = "movieId") -> DataFrame:
    """Mean vector of the items of each genre: ``(item, vector)`` with the genre as item."""
    listed = items.select(key, F.explode(F.array_distinct(genre_list("genres"))).alias("genre"))
    joined = lookup_join(listed, vectors.select(F.col("item").alias(key), "vector"), key, "inner")
    means = [F.avg(F.col("vector")[i]) for i in range(size)]
    return joined.groupBy(F.col("genre").alias("item")).agg(F.array(*means).alias("vector"))


def dot_crosses(
    item: str = "itemVector",
    user: str = "userVector",
    item_genre: str = "itemGenreVector",
    user_genre: str = "userGenreVector",
) -> dict[str, Column]:
    """The four products of an item-side with a user-side vector."""
    return {
        "itemUserDot": dot(item, user),
        "itemUserGenreDot": dot(item, user_genre),
        "itemGenreUserDot": dot(item_genre, user),
        "itemGenreUserGenreDot": dot(item_genre, user_genre),
    }
