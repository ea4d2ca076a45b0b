"""Behaviour sequences and the item transition graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.columns import RatingColumns
from tastemill.functions.scalars import POSITIVE_RATING
from tastemill.operators.samples import positive_ratings
from tastemill.operators.skew import (
    HOT_ROWS,
    drop_helper_columns,
    group_window,
    ordered_groups,
    positions,
    running_ranges,
)

# Word2Vec cuts sentences at this length; longer sequences are cut the same way.
SEGMENT_ITEMS = 1000


def user_sequences(
    ratings: DataFrame,
    cols: RatingColumns = RatingColumns(),
    *,
    threshold: float = POSITIVE_RATING,
    segment_items: int = SEGMENT_ITEMS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Liked items per user in time order: ``(user, segment, movieIds)``.

    A sequence is stored in segments of at most ``segment_items`` items, so no
    row grows with the activity of one user. Segments 0, 1, ... put together are
    the whole sequence; most users have just segment 0.
    """
    liked = positive_ratings(ratings, cols, threshold).select(*cols.all)
    placed = positions(liked, [cols.user], cols.order, "__position", hot_rows=hot_rows)
    segment = F.expr(f"(__position - 1) div {segment_items}").cast("int")
    return (
        placed.select(cols.user, cols.item, "__position", segment.alias("segment"))
        .groupBy(cols.user, "segment")
        .agg(F.array_sort(F.collect_list(F.struct("__position", cols.item))).alias("__entries"))
        .select(cols.user, "segment", F.transform("__entries", lambda e: e[cols.item]).alias("movieIds"))
    )


def sequence_text(sequences: DataFrame, items: str = "movieIds", output: str = "movieIdStr") -> DataFrame:
    """Add a sequence's items as one space-separated string."""
    return sequences.withColumn(output, F.array_join(F.col(items).cast("array<string>"), " "))


def item_steps(
    ratings: DataFrame,
    cols: RatingColumns = RatingColumns(),
    *,
    threshold: float = POSITIVE_RATING,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Every step from one liked item to the user's next: ``(src, dst)``."""
    liked = positive_ratings(ratings, cols, threshold).select(*cols.all)
    grouped = ordered_groups(liked, [cols.user], cols.order, 1, hot_rows=hot_rows)
    steps = grouped.withColumn("src", F.lag(cols.item).over(group_window([cols.user], cols.order)))
    return drop_helper_columns(steps).select("src", F.col(cols.item).alias("dst")).where(F.col("src").isNotNull())


def item_pairs(
    ratings: DataFrame,
    cols: RatingColumns = RatingColumns(),
    *,
    threshold: float = POSITIVE_RATING,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """How often each step occurs: ``(src, dst, cnt)``."""
    steps = item_steps(ratings, cols, threshold=threshold, hot_rows=hot_rows)
    return steps.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("cnt"))


def transition_probs(pairs: DataFrame) -> DataFrame:
    """Step probabilities, also as integer ranges out of the source's total."""
    return running_ranges(pairs, ["src"], "dst", "cnt", digits=2).select(
        "src", "dst", "cnt", (F.col("cnt") / F.col("total")).alias("prob"), "lo", "hi", "total"
    )


def item_distribution(pairs: DataFrame) -> DataFrame:
    """How often each item is a source, also as ranges out of all steps."""
    sources = pairs.groupBy(F.col("src").alias("item")).agg(F.sum("cnt").alias("cnt"))
    return running_ranges(sources, [], "item", "cnt", digits=3).select(
        "item", "cnt", (F.col("cnt") / F.col("total")).alias("prob"), "lo", "hi", "total"
    )
