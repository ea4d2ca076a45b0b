"""Ratings, items and vectors derived from the TPC-H-like tables.

The tables hold no ratings, so order lines and click events stand in for them:
a customer "rates" a part by the quantity ordered, a user "rates" the thing an
event is about by its value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.columns import RatingColumns

LINE_RATINGS = RatingColumns(ties=("orderKey", "lineNumber", "movieId", "suppKey", "quantity", "price"))
EVENT_RATINGS = RatingColumns(ties=("eventId",))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _since_epoch(unit: str, column: str) -> str:
    return f"timestampdiff({unit}, timestamp_ntz'1970-01-01 00:00:00', {column})"


def line_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Ratings 0.5 to 5.0 from order lines; time in epoch seconds."""
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("userId"),
        F.col("l_partkey").alias("movieId"),
        (F.ceil(F.col("l_quantity") / 5) / F.lit(2.0)).cast("double").alias("rating"),
        F.expr(_since_epoch("SECOND", "l_shipdate")).alias("timestamp"),
        F.col("l_orderkey").alias("orderKey"),
        F.col("l_linenumber").alias("lineNumber"),
        F.col("l_suppkey").alias("suppKey"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
    )


def event_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Ratings 0.5 to 5.0 from events; time in epoch microseconds."""
    events = table(spark, folder, "events")
    score = F.least(F.lit(10), 1 + F.floor(F.col("value") / 8)) / F.lit(2.0)
    return events.select(
        F.col("user_id").alias("userId"),
        F.get_json_object("props", "$.k").cast("long").alias("movieId"),
        score.cast("double").alias("rating"),
        F.expr(_since_epoch("MICROSECOND", "ts")).alias("timestamp"),
        F.col("event_id").alias("eventId"),
    )


def part_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items from parts: a title ending in a year and a genre list."""
    year = (F.lit(1970) + F.col("p_size")).cast("string")
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("movieId"),
        F.concat(F.col("p_name"), F.lit(" ("), year, F.lit(")")).alias("title"),
        F.concat(F.col("p_type"), F.lit("|"), F.replace(F.col("p_name"), F.lit(" "), F.lit("|"))).alias("genres"),
    )


def item_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Stored vectors, widened to double."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("vector")
    )
