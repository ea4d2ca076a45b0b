"""Joins and ordered groups that stay balanced when one key is very common.

A window over ``PARTITION BY user`` puts all rows of a user into one task. That
is right for ordinary users and wrong for one who owns a third of the table.
``ordered_groups`` cuts such groups into range-partitioned chunks and copies the
few rows a bounded window frame needs across each cut, so that windows over
``(user, chunk)`` give exactly the rows of a window over ``user``.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastemill.session import ensure_checkpoint_dir

# A key with more rows than this is split over several tasks.
HOT_ROWS = 2_000_000
# A lookup table is broadcast up to this many rows and about this many bytes.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
# Buckets of keys whose rows are counted before those of any key.
HOT_BUCKETS = 4_096
# Copies of a hot key's lookup row, and so tasks its rows are spread over.
SALTS = 64

CHUNK = "__chunk"
HALO = "__halo"
OFFSET = "__offset"
TIE = "__tie"


def same_keys(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Equality on key pairs, a null key matching a null key."""
    return reduce(and_, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows, or None when there are none.

    Rows are counted in ``HOT_BUCKETS`` buckets of keys first, so that a task moves
    one number for each bucket, however many keys there are. Only keys of buckets
    with more than ``hot_rows`` rows are counted themselves. There can be at most
    ``rows / hot_rows`` such keys, which bounds what callers broadcast.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(HOT_BUCKETS))
    counts = df.groupBy(bucket.alias("__bucket")).agg(F.count(F.lit(1)).alias("__n"))
    full = [r["__bucket"] for r in counts.where(F.col("__n") > hot_rows).select("__bucket").collect()]
    if not full:
        return None
    hot = (
        df.where(bucket.isin(full))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > hot_rows)
        .select(*[F.col(k).alias(f"__hot_{k}") for k in keys], "__n")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    return _unless_empty(hot)


def _unless_empty(hot: DataFrame) -> DataFrame | None:
    if hot.isEmpty():
        hot.unpersist()
        return None
    return hot


def _with_broadcast(hot: DataFrame) -> DataFrame:
    return F.broadcast(hot) if fits_broadcast(hot) else hot


def _row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes in memory."""
    sizes = [F.lit(0)]
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            sizes.append(F.lit(16) + F.coalesce(F.octet_length(f.name), F.lit(0)))
        elif isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, T.NumericType):
            sizes.append(F.lit(16) + F.coalesce(F.octet_length(F.to_json(f.name)), F.lit(0)))
        elif isinstance(f.dataType, T.ArrayType):
            sizes.append(F.lit(16) + 8 * F.greatest(F.coalesce(F.size(f.name), F.lit(0)), F.lit(0)))
        elif isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            sizes.append(F.lit(8))
        else:
            sizes.append(F.lit(16) + F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0)))
    return reduce(add, sizes).cast("long")


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether the whole table is within both broadcast limits, by measuring it."""
    # Counted in each task; only one row per task is moved.
    measured = df.select(_row_bytes(df).alias("__bytes"))
    n, total = measured.agg(F.count(F.lit(1)), F.coalesce(F.sum("__bytes"), F.lit(0))).first()
    return n <= rows and total <= size


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "left",
    *,
    hot_rows: int = HOT_ROWS,
    broadcast_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
    counted: DataFrame | str | None = None,
) -> DataFrame:
    """Join ``left`` to ``right``, which has one row per ``key``.

    A right side measured to be small is broadcast, so ``left`` is not
    shuffled. Otherwise both sides are shuffled; rows of hot keys carry a salt
    and the matching right rows are repeated once per salt. Persist a ``right``
    that is costly to compute: it is measured, then joined. ``counted`` names a column of
    ``right`` with the number of the key's rows in ``left``, which then aren't counted, or is a
    table that is cheaper to count, for when ``left`` adds columns to it or leaves out rows.
    """
    if fits_broadcast(right, broadcast_rows):
        return left.join(F.broadcast(right), key, how)

    if not isinstance(counted, str):
        hot = hot_keys((left if counted is None else counted).where(F.col(key).isNotNull()), [key], hot_rows)
    else:
        known = right.where(F.col(key).isNotNull() & (F.col(counted) > hot_rows))
        hot = _unless_empty(known.select(F.col(key).alias(f"__hot_{key}")).distinct().persist(StorageLevel.MEMORY_AND_DISK))
    if hot is None:
        return left.join(right, key, how)

    marks = _with_broadcast(hot.select(F.col(f"__hot_{key}").alias(key), F.lit(True).alias("__is_hot")))
    # The partition number spreads even exact copies of a row, and a retried task
    # keeps its number.
    row_hash = F.xxhash64(*[F.col(c) for c in left.columns], F.spark_partition_id())
    spread = F.pmod(row_hash, F.lit(salts)).cast("int")
    salted_left = (
        left.join(marks, key, "left")
        .withColumn("__salt", F.when(F.col("__is_hot"), spread).otherwise(F.lit(0)))
        .drop("__is_hot")
    )
    last_salt = F.when(F.col("__is_hot"), F.lit(salts - 1)).otherwise(F.lit(0))
    salted_right = (
        right.join(marks, key, "left")
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), last_salt)))
        .drop("__is_hot")
    )
    return salted_left.join(salted_right, [key, "__salt"], how).drop("__salt")


def ordered_groups(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    before: int,
    *,
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Prepare ``df`` for windows per ``keys`` in ascending ``order``.

    Adds four columns. ``CHUNK`` joins ``keys`` in the window's partitioning and
    ``TIE`` the end of its order; ``group_window`` does both. ``HALO`` marks
    copied rows, which callers drop after the window; each chunk is given the
    ``before`` rows that precede it. ``OFFSET`` is the number of rows of the key
    that come before the chunk's own rows. ``order`` must be a total order
    within a key but for exact copies of a row, which ``TIE`` tells apart.

    Rows per key are counted on ``counted``, for when ``df`` adds columns to a
    table that is cheaper to read.
    """
    whole = {CHUNK: F.lit(-1), HALO: F.lit(False), OFFSET: F.lit(0).cast("long"), TIE: F.lit(0).cast("long")}
    hot = hot_keys(df if counted is None else counted, keys, hot_rows)
    if hot is None:
        return df.withColumns(whole)

    ensure_checkpoint_dir(df.sparkSession)
    hot_side = _with_broadcast(hot)
    on_hot = same_keys(df, hot_side, [(k, f"__hot_{k}") for k in keys])
    cold = df.join(hot_side, on_hot, "left_anti").withColumns(whole)

    hot_total = hot.agg(F.sum("__n")).first()[0]
    chunks = int(hot_total // hot_rows) + 2
    # The range boundaries come from a sample, so the chunk numbers are written
    # down before anything is derived from them.
    own = (
        df.join(hot_side, on_hot, "left_semi")
        .withColumn(TIE, F.monotonically_increasing_id())
        .repartitionByRange(chunks, *keys, *order, TIE)
        .withColumn(CHUNK, F.spark_partition_id())
        .checkpoint()
    )

    # One row per (key, chunk): at most chunks + number of hot keys rows.
    per_key = Window.partitionBy(*keys).orderBy(CHUNK)
    starts = (
        own.groupBy(*keys, CHUNK)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn(
            OFFSET,
            F.coalesce(F.sum("__n").over(per_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"),
        )
        .withColumn(
            "__next",
            F.collect_list(F.struct(F.col(CHUNK).alias("chunk"), F.col(OFFSET).alias("offset"))).over(
                per_key.rowsBetween(1, max(before, 1))
            ),
        )
        .select(*[F.col(k).alias(f"__hot_{k}") for k in keys], F.col(CHUNK).alias("__of"), "__n", OFFSET, "__next")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    starts_side = _with_broadcast(starts)
    on_start = same_keys(own, starts_side, [(k, f"__hot_{k}") for k in keys]) & (own[CHUNK] == starts_side["__of"])

    own_rows = own.join(starts_side, on_start).select(
        *[own[c] for c in df.columns], own[CHUNK], F.lit(False).alias(HALO), OFFSET, TIE
    )
    parts = own_rows
    if before > 0:
        from_end = Window.partitionBy(*keys, CHUNK).orderBy(*[F.col(c).desc() for c in [*order, TIE]])
        tail = own.withColumn("__back", F.row_number().over(from_end)).where(F.col("__back") <= before)
        on_tail = same_keys(tail, starts_side, [(k, f"__hot_{k}") for k in keys]) & (
            tail[CHUNK] == starts_side["__of"]
        )
        # A copied row at position p serves the chunks whose own rows begin
        # fewer than `before` rows after it.
        halo = (
            tail.join(starts_side, on_tail)
            .select(
                *[tail[c] for c in df.columns],
                TIE,
                (F.col(OFFSET) + F.col("__n") - F.col("__back") + 1).alias("__position"),
                F.explode("__next").alias("__to"),
            )
            .where(F.col("__to.offset") < F.col("__position") + before)
            .select(
                *df.columns,
                F.col("__to.chunk").alias(CHUNK),
                F.lit(True).alias(HALO),
                F.col("__to.offset").alias(OFFSET),
                TIE,
            )
        )
        parts = parts.unionByName(halo)
    return cold.unionByName(parts)


def group_window(keys: list[str], order: list[str]) -> WindowSpec:
    """The window over rows prepared by ``ordered_groups``."""
    return Window.partitionBy(*keys, CHUNK).orderBy(*order, TIE)


def drop_helper_columns(df: DataFrame) -> DataFrame:
    """Remove halo rows and the columns added by ``ordered_groups``."""
    return df.where(~F.col(HALO)).drop(CHUNK, HALO, OFFSET, TIE)


def moments_before_chunk(grouped: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Add ``__n0``, ``__mean0``, ``__m20``: moments of ``value`` in the key's chunks before a row's own.

    ``grouped`` comes from ``ordered_groups``. Each chunk is reduced to its count,
    mean and squared deviations, and running sums over the chunks are taken
    relative to the key's mean, which keeps them exact to rounding. The three
    columns are null in a key's first chunk and in keys that were not cut, for
    which nothing is computed.
    """
    chunks = (
        grouped.where((F.col(CHUNK) >= 0) & ~F.col(HALO))
        .groupBy(*keys, CHUNK)
        .agg(F.count(value).alias("__n"), F.avg(value).alias("__mean"), F.var_pop(value).alias("__var"))
        .na.fill(0, ["__mean", "__var"])
    )
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    n, off = F.col("__n"), F.col("__mean") - F.col("__centre")
    # One row per (key, chunk), as many as there are chunks.
    sums = (
        chunks.withColumn("__centre", F.sum(n * F.col("__mean")).over(whole) / F.sum(n).over(whole))
        .withColumn("__n0", F.sum("__n").over(earlier))
        .withColumn("__off0", F.sum(n * off).over(earlier))
        .withColumn("__square0", F.sum(n * (F.col("__var") + off * off)).over(earlier))
        .where(F.col("__n0") > 0)
        .select(
            *[F.col(k).alias(f"__hot_{k}") for k in keys],
            F.col(CHUNK).alias("__of"),
            "__n0",
            (F.col("__centre") + F.col("__off0") / F.col("__n0")).alias("__mean0"),
            F.greatest(F.col("__square0") - F.col("__off0") * F.col("__off0") / F.col("__n0"), F.lit(0.0)).alias("__m20"),
        )
    )
    side = _with_broadcast(sums)
    on = same_keys(grouped, side, [(k, f"__hot_{k}") for k in keys]) & (grouped[CHUNK] == side["__of"])
    return grouped.join(side, on, "left").drop("__of", *[f"__hot_{k}" for k in keys])


def positions(df: DataFrame, keys: list[str], order: list[str], name: str, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Number each key's rows 1, 2, ... in ascending ``order``."""
    grouped = ordered_groups(df, keys, order, 0, hot_rows=hot_rows)
    number = F.row_number().over(group_window(keys, order)) + F.col(OFFSET)
    return drop_helper_columns(grouped.withColumn(name, number))


def running_ranges(
    df: DataFrame, groups: list[str], member: str, weight: str, *, digits: int = 2
) -> DataFrame:
    """Lay each group's members end to end as integer ranges ``[lo, hi)``.

    Members are ordered by the first hex digits of their MD5, then by value.
    The digits cut even one huge group into ``16 ** digits`` balanced parts,
    whose totals are small enough to be accumulated in one window. ``member``
    is unique within a group. Adds ``lo``, ``hi`` and the group's ``total``.
    """
    part = "__part"
    rows = df.withColumn(part, F.substring(F.md5(F.col(member).cast("string")), 1, digits))
    within = Window.partitionBy(*groups, part).orderBy(member).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__upto", F.sum(weight).over(within))

    group_window = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    totals = rows.groupBy(*groups, part).agg(F.sum(weight).alias("__sum"))
    starts = totals.select(
        *groups,
        part,
        F.coalesce(
            F.sum("__sum").over(group_window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__start"),
        F.sum("__sum").over(group_window).alias("total"),
    )
    return (
        rows.join(starts, [*groups, part])
        .withColumn("hi", (F.col("__start") + F.col("__upto")).cast("long"))
        .withColumn("lo", (F.col("hi") - F.col(weight)).cast("long"))
        .withColumn("total", F.col("total").cast("long"))
        .drop(part, "__upto", "__start")
    )
