"""Column expressions shared by the operators. All run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
POSITIVE_RATING = 3.5
DEFAULT_YEAR = 1990


def label(rating: str | Column, threshold: float = POSITIVE_RATING) -> Column:
    """1 for a positive rating, else 0."""
    value = F.col(rating) if isinstance(rating, str) else rating
    return F.when(value >= threshold, 1).otherwise(0)


def release_year(title: str, default: int = DEFAULT_YEAR) -> Column:
    """The year in a title ending in ``(yyyy)``, else ``default``."""
    digits = F.regexp_extract(F.col(title), r"\(([0-9]{4})\)$", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("int"), F.lit(default))


def genre_list(genres: str) -> Column:
    """A ``|``-separated list as an array."""
    return F.split(F.col(genres), r"\|")


def slots(values: str | Column, prefix: str, n: int) -> dict[str, Column]:
    """The first ``n`` array elements as columns ``prefix1..n``, null beyond the end."""
    array = F.col(values) if isinstance(values, str) else values
    return {f"{prefix}{i + 1}": F.get(array, F.lit(i)) for i in range(n)}


def two_digits(value: str | Column) -> Column:
    """Round to two decimals as ``format_number`` does, but stay a number."""
    number = F.col(value) if isinstance(value, str) else value
    return F.replace(F.format_number(number, 2), F.lit(","), F.lit("")).cast("double")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ranked_values(values: Column) -> Column:
    """Distinct array elements, most frequent first, ties in ascending order."""

    def from_sorted(ordered: Column) -> Column:
        # Positions at which a run of equal elements ends; their gaps are the counts.
        ends = F.filter(
            F.sequence(F.lit(1), F.size(ordered)),
            lambda i: (i == F.size(ordered)) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        return bind(ends, lambda e: from_ends(ordered, e))

    def from_ends(ordered: Column, ends: Column) -> Column:
        runs = F.zip_with(
            ends,
            F.concat(F.array(F.lit(0)), ends),
            lambda end, before: F.struct((before - end).alias("n"), F.get(ordered, end - 1).alias("value")),
        )
        return F.transform(F.sort_array(F.slice(runs, 1, F.size(ends))), lambda run: run["value"])

    return F.when(F.size(values) > 0, bind(F.sort_array(values), from_sorted)).otherwise(F.slice(values, 1, 0))


def dot(a: str | Column, b: str | Column) -> Column:
    """Dot product of two arrays of double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def draw(*key: Column) -> Column:
    """A reproducible 60-bit integer drawn from the MD5 of ``key``."""
    text = F.concat_ws(":", *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
