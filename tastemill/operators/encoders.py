"""One-hot, multi-hot, bucket and scale encoders."""

from __future__ import annotations

import struct

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    Bucketizer,
    CountVectorizerModel,
    MinMaxScaler,
    QuantileDiscretizer,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastemill.columns import RatingColumns
from tastemill.functions.scalars import genre_list
from tastemill.operators.samples import explode_genres, item_rating_stats
from tastemill.operators.skew import HOT_ROWS, lookup_join, positions

# A model object carries at most this many labels through the driver.
MODEL_LABELS = 100_000
# Bits of a value's 64-bit key that each pass of ``exact_quantiles`` decides.
DIGITS = (11, 11, 11, 11, 10, 10)
SIGN = 1 << 63


def sparse_vector(size: Column, slots: Column) -> Column:
    """A vector of ``size`` with 1 in each of the ascending ``slots``."""
    # A vector's stored form is a struct; reading it back from JSON makes the vector.
    ones = F.transform(slots, lambda _: F.lit(1.0))
    stored = F.struct(F.lit(0).alias("type"), size.alias("size"), slots.alias("indices"), ones.alias("values"))
    schema = T.StructType([T.StructField("v", VectorUDT())])
    return F.from_json(F.to_json(F.struct(stored.alias("v"))), schema)["v"]


def one_hot(df: DataFrame, column: str = "movieId") -> DataFrame:
    """Add the id as ``<column>Number`` and its indicator as ``<column>Vector``.

    The vector has one slot for every integer up to the largest id. Its metadata
    holds that number and no names, so that it costs the driver nothing. A null
    id has no vector; a negative one is an error.
    """
    number, vector = f"{column}Number", f"{column}Vector"
    numbered = df.withColumn(number, F.col(column).cast("int"))
    size = (numbered.agg(F.max(number)).first()[0] or 0) + 1
    wrong = F.raise_error(F.concat(F.lit(f"negative {column}: "), F.col(number).cast("string"))).cast("int")
    slot = F.when(F.col(number) >= 0, F.col(number)).otherwise(wrong)
    indicator = F.when(F.col(number).isNotNull(), sparse_vector(F.lit(size), F.array(slot)))
    return numbered.withColumn(vector, indicator.alias(vector, metadata={"ml_attr": {"num_attrs": size}}))


def label_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("labelCount"))


def _few_labels(counts: DataFrame) -> bool:
    return counts.count() <= MODEL_LABELS


def fit_string_index(df: DataFrame, column: str, output: str) -> StringIndexerModel:
    """Index labels by falling frequency, ties in ascending order."""
    return StringIndexer(inputCol=column, outputCol=output, stringOrderType="frequencyDesc").fit(df)


def label_index(df: DataFrame, column: str, output: str, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The table ``(label, labelCount, index)``, ranked without the driver.

    Labels of one count are ordered by their text, as ``StringIndexer`` does.
    """
    counts = label_counts(df, column).withColumns(
        {"__all": F.lit(0), "__rarity": -F.col("labelCount"), "__text": F.col(column).cast("string")}
    )
    ranked = positions(counts, ["__all"], ["__rarity", "__text"], "__rank", hot_rows=hot_rows)
    return ranked.select(column, "labelCount", (F.col("__rank") - 1).cast("int").alias(output))


def string_index(df: DataFrame, column: str, output: str, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add each label's index, 0 for the most frequent label; rows without a label are left out."""
    index = label_index(df, column, output, hot_rows=hot_rows).drop("labelCount")
    return lookup_join(df, index, column, "inner", hot_rows=hot_rows)


def multi_hot(items: DataFrame, key: str = "movieId", genres: str = "genres") -> DataFrame:
    """Encode each item's genre list as indexes and as a sparse 0/1 vector.

    An item is one row, so encoding it needs neither an explode nor a shuffle:
    the genre labels, counted once, become a vocabulary applied row by row. The
    vocabulary is part of the fitted model; one of more than ``MODEL_LABELS``
    labels is joined in Spark instead, with the same outcome.
    """
    exploded = explode_genres(items.select(key, genres), genres)
    if not _few_labels(label_counts(exploded, "genre")):
        return _joined_multi_hot(exploded, key)
    labels = list(fit_string_index(exploded, "genre", "__index").labels)
    vectorizer = CountVectorizerModel.from_vocabulary(labels, "__list", "vector").setBinary(True)
    vocabulary = F.array(*[F.lit(x) for x in labels])
    return (
        vectorizer.transform(items.select(key, genre_list(genres).alias("__list")).where(F.col("__list").isNotNull()))
        .withColumn(
            "genreIndexes",
            F.array_sort(
                F.transform(F.array_distinct("__list"), lambda g: (F.array_position(vocabulary, g) - 1).cast("int"))
            ),
        )
        .withColumn("indexSize", F.lit(len(labels)))
        .select(key, "genreIndexes", "indexSize", "vector")
    )


def _joined_multi_hot(exploded: DataFrame, key: str) -> DataFrame:
    """``multi_hot`` of exploded items without a model on the driver."""
    index = label_index(exploded, "genre", "__slot").drop("labelCount").persist(StorageLevel.MEMORY_AND_DISK)
    size = index.count()
    slots = lookup_join(exploded.select(key, "genre"), index, "genre", "inner").groupBy(key)
    rows = slots.agg(F.array_sort(F.collect_set("__slot")).alias("genreIndexes")).withColumn("indexSize", F.lit(size))
    vector = sparse_vector(F.col("indexSize"), F.col("genreIndexes"))
    return rows.select(key, "genreIndexes", "indexSize", vector.alias("vector"))


def to_vector(df: DataFrame, column: str, output: str) -> DataFrame:
    """A number as a vector of length one."""
    return VectorAssembler(inputCols=[column], outputCol=output, handleInvalid="keep").transform(df)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("__n"))


def count_quantiles(df: DataFrame, column: str, buckets: int) -> list[float]:
    """Exact inner quantiles of a column of counts, repeated values merged.

    ``column`` holds counts of rows, so ``d`` distinct values take at least
    ``d * d / 2`` rows of the counted table: a trillion rows give at most 1.5
    million values. The table of values is therefore small enough for one
    running sum, whatever the number of rows.
    """
    upto = Window.partitionBy(F.lit(0)).orderBy(column)
    counted = value_counts(df, column).select(
        F.col(column).cast("double").alias("value"),
        F.sum("__n").over(upto).alias("hi"),
        F.sum("__n").over(Window.partitionBy(F.lit(0))).alias("total"),
        F.col("__n").alias("n"),
    )
    # The i-th quantile has rank ceil(i * total / buckets), so hi * buckets div total
    # counts the quantiles up to a value. A value is a quantile where that count grows.
    cuts = counted.where(f"least({buckets - 1}, hi * {buckets} div total) > (hi - n) * {buckets} div total")
    return sorted(r["value"] for r in cuts.select("value").collect())


def fit_count_buckets(df: DataFrame, column: str, output: str, buckets: int = 100) -> Bucketizer:
    """Quantile buckets of a column of row counts, exact at any size."""
    inner = count_quantiles(df, column, buckets)
    return Bucketizer(inputCol=column, outputCol=output, splits=[float("-inf"), *inner, float("inf")])


def _ordered_key(column: str) -> Column:
    """A double's bits, turned so that the order of unsigned 64-bit numbers is that of the values."""
    # Adding zero makes one zero of both.
    value = F.col(column).cast("double") + F.lit(0.0)
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value).cast("long")
    return F.when(bits >= 0, bits.bitwiseXOR(F.lit(-SIGN))).otherwise(F.bitwise_not(bits))


def _value_of(key: int) -> float:
    key %= 1 << 64
    return struct.unpack(">d", struct.pack(">Q", key ^ SIGN if key & SIGN else key ^ (1 << 64) - 1))[0]


def exact_quantiles(df: DataFrame, column: str, buckets: int) -> list[float]:
    """Exact inner quantiles of any numeric column, repeated values merged.

    The i-th of them is the value of rank ``ceil(i * n / buckets)``; nulls and
    NaN have no rank. Radix selection: values are 64-bit keys, and each of six
    passes counts the next 10 or 11 bits of those keys whose bits before are the
    bits of a wanted rank. A pass moves no values, only at most ``2048 *
    buckets`` counts from each task, and what comes to the driver is one row for
    each quantile. ``df`` is read once; the passes read the keys, which are kept in memory
    and on disk meanwhile. The number of passes does not depend on the values. The
    values are read as doubles, so integers beyond 2^53 are rounded first.
    """
    present = df.select(F.col(column).cast("double").alias("__value")).where("__value is not null and not isnan(__value)")
    keys = present.select(_ordered_key("__value").alias("__key")).persist(StorageLevel.MEMORY_AND_DISK)
    n = keys.count()
    ranks = sorted({-(-i * n // buckets) for i in range(1, buckets)} - {0})
    wanted, left = [(0, r) for r in ranks], 64
    for bits in DIGITS if ranks else ():
        before = F.shiftrightunsigned("__key", left) if left < 64 else F.lit(0).cast("long")
        left -= bits
        cells = (
            keys.select(before.alias("prefix"), F.shiftrightunsigned("__key", left).alias("cell"))
            .where(F.col("prefix").isin(sorted({p for p, _ in wanted})))
            .groupBy("prefix", "cell")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        upto = Window.partitionBy("prefix").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        ends = cells.withColumn("hi", F.sum("n").over(upto))
        # One row for each rank.
        asked = df.sparkSession.createDataFrame(wanted, "prefix long, rank long")
        found = ends.join(F.broadcast(asked), "prefix").where("rank <= hi and rank > hi - n")
        wanted = [(r.cell, r.rank) for r in found.select("cell", (F.col("rank") - F.col("hi") + F.col("n")).alias("rank")).collect()]
    keys.unpersist()
    return sorted({_value_of(key) for key, _ in wanted})


def fit_exact_buckets(df: DataFrame, column: str, output: str, buckets: int = 100) -> Bucketizer:
    """Quantile buckets of any numeric column from its exact quantiles; NaN and null get one of their own."""
    inner = [v for v in exact_quantiles(df, column, buckets) if abs(v) != float("inf")]
    splits = [float("-inf"), *inner, float("inf")]
    return Bucketizer(inputCol=column, outputCol=output, splits=splits, handleInvalid="keep")


def fit_quantile_buckets(
    df: DataFrame, column: str, output: str, buckets: int = 100, relative_error: float = 0.001
) -> Bucketizer:
    """Quantile buckets of any numeric column, from a mergeable sketch."""
    return QuantileDiscretizer(
        inputCol=column, outputCol=output, numBuckets=buckets, relativeError=relative_error
    ).fit(df)


def fit_min_max(df: DataFrame, column: str, output: str) -> PipelineModel:
    """Scale a numeric column to [0, 1]."""
    vector = f"{column}Vec"
    stages = [
        VectorAssembler(inputCols=[column], outputCol=vector),
        MinMaxScaler(inputCol=vector, outputCol=output),
    ]
    return Pipeline(stages=stages).fit(df)


def rating_features(ratings: DataFrame, cols: RatingColumns = RatingColumns(), buckets: int = 100) -> DataFrame:
    """Item statistics with the rating count bucketed and the mean scaled."""
    # Read three times: for the quantiles, for the range, and for the result.
    stats = item_rating_stats(ratings, cols).persist(StorageLevel.MEMORY_AND_DISK)
    stages = [
        fit_count_buckets(stats, "ratingCount", "ratingCountBucket", buckets),
        VectorAssembler(inputCols=["avgRating"], outputCol="avgRatingVec"),
        MinMaxScaler(inputCol="avgRatingVec", outputCol="scaleAvgRating"),
    ]
    return Pipeline(stages=stages).fit(stats).transform(stats)

