"""Reading ratings and items, writing and reading model samples."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATINGS_SCHEMA = T.StructType(
    [
        T.StructField("userId", T.LongType()),
        T.StructField("movieId", T.LongType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("timestamp", T.LongType()),
    ]
)

ITEMS_SCHEMA = T.StructType(
    [
        T.StructField("movieId", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("genres", T.StringType()),
    ]
)

# The 27 columns of a model sample, in file order.
SAMPLES_SCHEMA = T.StructType(
    [
        T.StructField("movieId", T.LongType()),
        T.StructField("userId", T.LongType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("releaseYear", T.IntegerType()),
        *[T.StructField(f"movieGenre{i}", T.StringType()) for i in range(1, 4)],
        T.StructField("movieRatingCount", T.LongType()),
        T.StructField("movieAvgRating", T.DoubleType()),
        T.StructField("movieRatingStddev", T.DoubleType()),
        *[T.StructField(f"userRatedMovie{i}", T.LongType()) for i in range(1, 6)],
        T.StructField("userRatingCount", T.LongType()),
        T.StructField("userAvgReleaseYear", T.IntegerType()),
        T.StructField("userReleaseYearStddev", T.DoubleType()),
        T.StructField("userAvgRating", T.DoubleType()),
        T.StructField("userRatingStddev", T.DoubleType()),
        *[T.StructField(f"userGenre{i}", T.StringType()) for i in range(1, 6)],
    ]
)

SAMPLE_COLUMNS = SAMPLES_SCHEMA.fieldNames()


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str, **options: str) -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        # Doubled quotes inside quoted fields are plain CSV, not backslash escapes.
        reader = reader.option("header", True).option("escape", '"')
    return reader.options(**options).format(fmt).load(path)


def read_ratings(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """User-item ratings with typed columns; time is epoch seconds."""
    return _read(spark, path, RATINGS_SCHEMA, fmt)


def read_items(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Items with a title and a ``|``-separated genre list."""
    return _read(spark, path, ITEMS_SCHEMA, fmt)


def write_samples(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    *,
    single_file: bool = False,
    partition_by: tuple[str, ...] = (),
    compression: str | None = None,
) -> None:
    """Write samples, replacing what is there.

    ``compression`` is one of those that Spark's writer of ``fmt`` knows, by default its own.

    ``single_file`` puts the whole output through one task. It is meant for
    small exports only and is off by default.
    """
    out = df.coalesce(1) if single_file else df
    writer = out.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if compression:
        writer = writer.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def read_samples(
    spark: SparkSession, path: str, fmt: str = "csv", *, schema: T.StructType = SAMPLES_SCHEMA
) -> DataFrame:
    """Read samples as training rows: no missing values, malformed rows skipped.

    A missing number becomes 0. A missing string becomes the empty string, and
    so does the string ``0``, which the training files use for "missing".
    """
    if fmt != "csv":
        return training_rows(_read(spark, path, schema, fmt))
    # Spark judges a CSV row by the columns a query asks for. Reading text and
    # testing every column here makes the same rows malformed for every query.
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = _read(spark, path, texts, fmt, mode="DROPMALFORMED")
    valid = [F.col(f.name).isNull() | _readable(f) for f in schema.fields]
    typed = [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields]
    return training_rows(raw.where(reduce(and_, valid)).select(*typed))


def _readable(f: T.StructField) -> Column:
    if isinstance(f.dataType, T.StringType):
        return F.length(f.name) >= 0
    return F.col(f.name).try_cast(f.dataType).isNotNull()


def training_rows(df: DataFrame) -> DataFrame:
    """Fill what is missing in samples, as ``read_samples`` does."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    blank = {c: F.when(F.col(c) == "0", F.lit("")).otherwise(F.col(c)) for c in strings}
    return df.withColumns(blank).na.fill(0).na.fill("") if blank else df.na.fill(0)


def shuffle_order(keys: list[str], seed: int = 0) -> Column:
    """A reproducible pseudo-random sort key."""
    return F.xxhash64(F.lit(seed), *[F.col(k) for k in keys])


def shuffle_rows(df: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """Reorder training rows reproducibly, over the whole table."""
    return df.orderBy(shuffle_order(keys, seed), *keys)
