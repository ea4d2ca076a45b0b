from pyspark.sql import functions as F

from tastemill.operators.skew import hot_keys, lookup_join, positions, running_ranges


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_hot_keys(spark):
    df = spark.range(100).withColumn("k", F.when(F.col("id") < 60, 0).otherwise(F.col("id")))
    assert [r["__hot_k"] for r in hot_keys(df, ["k"], 50).collect()] == [0]
    assert hot_keys(df, ["k"], 60) is None


def shuffled_rows_of_counts(spark, df, *keys):
    """Rows that the tasks of ``hot_keys`` move, by the plan's shuffle of a count."""
    from tastemill.operators import skew

    found = []

    class Seen:
        def __getattr__(self, name):
            return getattr(df, name)

        def groupBy(self, *columns):
            found.append(df.groupBy(*columns).count().count())
            return df.groupBy(*columns)

    assert skew.hot_keys(Seen(), list(keys), 1_000) is None
    return found


def test_hot_keys_moves_no_row_for_each_key(spark):
    from tastemill.operators.skew import HOT_BUCKETS

    df = spark.range(20_000).withColumn("k", F.col("id"))
    counted = shuffled_rows_of_counts(spark, df, "k")
    assert counted and max(counted) <= HOT_BUCKETS


def test_hot_keys_with_nulls_and_two_columns(spark):
    df = spark.range(90).select(F.when(F.col("id") >= 40, F.col("id") % 7).alias("a"), F.lit("x").alias("b"))
    assert [(r["__hot_a"], r["__hot_b"], r["__n"]) for r in hot_keys(df, ["a", "b"], 30).collect()] == [(None, "x", 40)]


def test_lookup_join_takes_given_counts(spark):
    left = spark.range(300).withColumn("k", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 20))
    # The key 4 comes twice.
    right = spark.range(16).select(F.when(F.col("id") < 15, F.col("id")).otherwise(4).alias("k"), (F.col("id") * 2).alias("v"))
    right = right.join(left.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k")

    class Uncounted:
        """Fails where the rows are counted."""

        def __getattr__(self, name):
            assert name not in ("groupBy", "where")
            return getattr(left, name)

    for how in ("left", "inner"):
        given = lookup_join(Uncounted(), right, "k", how, broadcast_rows=0, hot_rows=30, salts=7, counted="n")
        assert rows(given) == rows(left.join(right, "k", how))


def test_lookup_join_strategies_agree(spark):
    left = spark.range(300).withColumn("k", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 20))
    left = left.withColumn("k", F.when(F.col("id") < 280, F.col("k")))
    right = spark.range(15).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner"):
        expected = rows(left.join(right, "k", how))
        assert rows(lookup_join(left, right, "k", how)) == expected
        assert rows(lookup_join(left, right, "k", how, broadcast_rows=0)) == expected
        salted = lookup_join(left, right, "k", how, broadcast_rows=0, hot_rows=30, salts=7)
        assert rows(salted) == expected


def test_positions_across_chunks(spark):
    df = spark.range(500).select((F.col("id") % 2 * 0).alias("k"), (F.col("id") * 37 % 500).alias("o"))
    found = positions(df, ["k"], ["o"], "p", hot_rows=40).collect()
    assert len(found) == 500 and all(r.p == r.o + 1 for r in found)


def test_positions_with_a_null_hot_key(spark):
    df = spark.range(200).select(F.lit(None).cast("long").alias("k"), F.col("id").alias("o"))
    found = positions(df, ["k"], ["o"], "p", hot_rows=40).collect()
    assert sorted(r.p for r in found) == list(range(1, 201))


def test_running_ranges_tile_the_total(spark):
    df = spark.range(400).select((F.col("id") % 3).alias("g"), F.col("id").alias("m"), (F.col("id") % 5 + 1).alias("w"))
    found = running_ranges(df, ["g"], "m", "w", digits=1).collect()
    for g in range(3):
        ranges = sorted((r.lo, r.hi) for r in found if r.g == g)
        assert ranges[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
        assert {r.total for r in found if r.g == g} == {ranges[-1][1]}


def test_exact_copies_are_split_too(spark):
    from tastemill.operators.skew import HALO, drop_helper_columns, group_window, ordered_groups

    df = spark.range(300).select(F.lit(1).alias("k"), F.lit(5).alias("o"))
    grouped = ordered_groups(df, ["k"], ["o"], 10, hot_rows=40)
    w = group_window(["k"], ["o"]).rowsBetween(-10, -1)
    assert grouped.where(~F.col(HALO)).groupBy("__chunk").count().agg(F.max("count")).first()[0] < 150
    counts = [r.n for r in drop_helper_columns(grouped.withColumn("n", F.count(F.lit(1)).over(w))).collect()]
    assert sorted(counts) == list(range(10)) + [10] * 290
    assert sorted(r.p for r in positions(df, ["k"], ["o"], "p", hot_rows=40).collect()) == list(range(1, 301))
