"""Features of a user's past: what came before each rating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tastemill.columns import RatingColumns
from tastemill.functions.scalars import genre_list, ranked_values, slots, two_digits
from tastemill.operators.skew import HOT_ROWS, drop_helper_columns, group_window, ordered_groups

# Fixed values.
HISTORY_ROWS = 100
RECENT_ITEMS = 5
TOP_GENRES = 5
MIN_HISTORY = 1


def _past(cols: RatingColumns, rows: int) -> WindowSpec:
    """A user's previous ``rows`` ratings, the current one left out."""
    return group_window([cols.user], cols.order).rowsBetween(-rows, -1)


def _past_items(cols: RatingColumns, w: WindowSpec) -> Column:
    """Liked items, newest first."""
    return F.reverse(F.collect_list(F.when(F.col("label") == 1, F.col(cols.item))).over(w))


def _past_genres(w: WindowSpec) -> Column:
    """Genre lists of liked items."""
    return F.collect_list(F.when(F.col("label") == 1, genre_list("genres"))).over(w)


def _past_numbers(cols: RatingColumns, w: WindowSpec) -> dict[str, Column]:
    return {
        "userRatingCount": F.count(F.lit(1)).over(w),
        "userAvgReleaseYear": F.avg("releaseYear").over(w),
        "userReleaseYearStddev": F.stddev_samp("releaseYear").over(w),
        "userAvgRating": F.avg(cols.rating).over(w),
        "userRatingStddev": F.stddev_samp(cols.rating).over(w),
    }


def _present(df: DataFrame) -> DataFrame:
    """Fill one-row deviations with 0 and round the way samples are stored."""
    numbers = ["userAvgReleaseYear", "userReleaseYearStddev", "userRatingStddev"]
    return df.na.fill(0, numbers).withColumns(
        {
            "userAvgReleaseYear": F.col("userAvgReleaseYear").cast("int"),
            "userReleaseYearStddev": two_digits("userReleaseYearStddev"),
            "userAvgRating": two_digits("userAvgRating"),
            "userRatingStddev": two_digits("userRatingStddev"),
        }
    )


def user_history(
    df: DataFrame, cols: RatingColumns = RatingColumns(), *, rows: int = HISTORY_ROWS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add the last five liked items before each rating."""
    grouped = ordered_groups(df, [cols.user], cols.order, rows, hot_rows=hot_rows)
    out = grouped.select("*", _past_items(cols, _past(cols, rows)).alias("__liked"))
    return drop_helper_columns(out.withColumns(slots("__liked", "userRatedMovie", RECENT_ITEMS)).drop("__liked"))


def user_window_stats(
    df: DataFrame,
    cols: RatingColumns = RatingColumns(),
    *,
    rows: int = HISTORY_ROWS,
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add counts, means and deviations over each user's previous ratings.

    Rows per user are counted on ``counted``, by default on ``df`` itself.
    """
    grouped = ordered_groups(df, [cols.user], cols.order, rows, hot_rows=hot_rows, counted=counted)
    numbers = [c.alias(name) for name, c in _past_numbers(cols, _past(cols, rows)).items()]
    return _present(drop_helper_columns(grouped.select("*", *numbers)))


def user_genre_prefs(
    df: DataFrame,
    cols: RatingColumns = RatingColumns(),
    *,
    rows: int = HISTORY_ROWS,
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add the five most frequent genres among previously liked items.

    Rows per user are counted on ``counted``, by default on ``df`` itself.
    """
    grouped = ordered_groups(df, [cols.user], cols.order, rows, hot_rows=hot_rows, counted=counted)
    out = drop_helper_columns(grouped.select("*", _past_genres(_past(cols, rows)).alias("__genres")))
    ranked = out.withColumn("__ranked", ranked_values(F.flatten("__genres")))
    return ranked.withColumns(slots("__ranked", "userGenre", TOP_GENRES)).drop("__genres", "__ranked")


def user_features(
    df: DataFrame,
    cols: RatingColumns = RatingColumns(),
    *,
    rows: int = HISTORY_ROWS,
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
    added: dict[str, Column] | None = None,
) -> DataFrame:
    """All features of the user's past, for ratings with enough of it.

    Every expression shares one window specification and is computed in one
    projection, so the plan holds one shuffle, one sort and one window. Rows per
    user are counted on ``counted``, by default on ``df`` itself. ``added`` are columns of
    ``df``'s own that are computed after the window, so that they needn't travel to it.
    """
    grouped = ordered_groups(df, [cols.user], cols.order, rows, hot_rows=hot_rows, counted=counted)
    w = _past(cols, rows)
    numbers = [c.alias(name) for name, c in _past_numbers(cols, w).items()]
    past = grouped.select(
        "*", _past_items(cols, w).alias("__liked"), *numbers, _past_genres(w).alias("__genres")
    )
    # Warm-up rows go before the costlier genre ranking.
    kept = warm_rows(drop_helper_columns(past))
    out = _present(kept).withColumn("__ranked", ranked_values(F.flatten("__genres")))
    return out.withColumns(
        {**(added or {}), **slots("__liked", "userRatedMovie", RECENT_ITEMS), **slots("__ranked", "userGenre", TOP_GENRES)}
    ).drop("genres", "__liked", "__genres", "__ranked")


def warm_rows(df: DataFrame, minimum: int = MIN_HISTORY) -> DataFrame:
    """Drop ratings of users who had rated too little before."""
    return df.where(F.col("userRatingCount") > minimum)
