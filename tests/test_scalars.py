from pyspark.sql import functions as F

from tastemill.functions import scalars


def one(spark, value, type_, column):
    return spark.createDataFrame([(value,)], f"x {type_}").select(column.alias("y")).first()[0]


def test_release_year(spark):
    titles = ["Toy Story (1995)", "Babylon 5", "X (2006-2007)", "Foo (1995) ", "(abcd)", None, "Heat"]
    years = [one(spark, t, "string", scalars.release_year("x")) for t in titles]
    assert years == [1995, 1990, 1990, 1990, 1990, 1990, 1990]


def test_two_digits_rounds_half_even_and_drops_separators(spark):
    numbers = [0.125, 0.375, 1234.5, 2.325, 3.0]
    found = [one(spark, n, "double", scalars.two_digits("x")) for n in numbers]
    assert found == [0.12, 0.38, 1234.5, 2.33, 3.0]


def test_slots_are_null_beyond_the_end(spark):
    for text, expected in [("A", ["A", None, None]), ("A|B|C|D|E|F", ["A", "B", "C"]), (None, [None] * 3)]:
        df = spark.createDataFrame([(text,)], "g string").withColumns(scalars.slots(scalars.genre_list("g"), "s", 3))
        assert list(df.drop("g").first()) == expected


def test_ranked_values(spark):
    cases = [
        (["A", "B", "B", "C", "C", "B"], ["B", "C", "A"]),
        (["C", "A", "B"], ["A", "B", "C"]),
        (["A"], ["A"]),
        ([], []),
    ]
    for values, expected in cases:
        assert one(spark, values, "array<string>", scalars.ranked_values(F.col("x"))) == expected


def test_draw_is_fixed(spark):
    a = one(spark, 7, "long", scalars.draw(F.col("x"), F.lit(1)))
    b = one(spark, 7, "long", scalars.draw(F.col("x"), F.lit(1)))
    assert a == b and 0 <= a < 16**15
