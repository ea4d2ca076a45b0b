"""Iterations leave on disk only what is read later."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemill.operators import als_sums, pair_factors, skip_grams
from tastemill.session import drop_checkpoints, ensure_checkpoint_dir


@pytest.fixture
def left(spark):
    """Counts the folders that a call adds to the checkpoints."""
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder))
    return lambda: len(set(os.listdir(folder)) - before)


@pytest.fixture
def rows(spark):
    draw = np.random.default_rng(4)
    made = [(int(u), int(i), float(draw.integers(1, 6)), k % 2) for k, (u, i) in enumerate(draw.integers(0, 12, (300, 2)))]
    return spark.createDataFrame(made, "user long, item long, rating double, label int")


def test_dropped_checkpoints_are_gone(spark, left):
    frame = spark.range(5).checkpoint()
    assert left() == 1
    drop_checkpoints(frame, spark.range(3), spark.range(3).where("id > 1"))
    assert left() == 0


def test_pair_factors_keep_their_last_tables(rows, left):
    model = pair_factors.fit_pair_factors(rows, ["user", "item"], rounds=4)
    assert left() == 2
    assert model.score(rows).where("score > 0 and score < 1").count() == 300


def test_summed_factors_keep_the_last_ones(rows, left):
    model = als_sums.fit_als_sums(rows, "user", "item", "rating", rank=3, iterations=3)
    assert left() == 2
    assert model.score(rows, "user", "item").where(F.col("prediction").isNotNull()).count() == 300


def test_skip_grams_keep_vocabulary_and_vectors(rows, left):
    sequences = rows.groupBy("user").agg(F.collect_list("item").alias("items"))
    model = skip_grams.fit_skip_grams(sequences, "items", size=4, window=5, iterations=3, seed=1, least=1)
    assert left() == 2 and model.getVectors().count() == 12
