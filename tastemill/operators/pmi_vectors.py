"""Item vectors from joint occurrences, with everything that grows with the items in tables.

Items that occur near each other more often than chance have a positive mutual
information. The matrix of these numbers is sparse, one row of a table for each
entry; its leading eigenvectors, found by block power iteration, are the item
vectors. A step is a join of the entries with the vectors and a sum. Only
matrices of the vectors' size reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.functions.scalars import draw
from tastemill.operators.embeddings import VECTOR_SIZE, WINDOW_SIZE
from tastemill.operators.skew import HOT_ROWS, lookup_join
from tastemill.session import ensure_checkpoint_dir

STEPS = 12
# Vectors are made orthogonal after this many steps.
STEPS_PER_TURN = 3


def co_occurrences(sequences: DataFrame, items: str = "movieIds", *, window: int = WINDOW_SIZE) -> DataFrame:
    """How often two items lie at most ``window`` places apart: ``(a, b, n)``, both ways round.

    Sequences come in segments of bounded length; items of different segments don't count as
    near. Two occurrences of one item count as a pair of it with itself, twice.
    """
    placed = sequences.where(F.col(items).isNotNull()).select(items, F.posexplode(items).alias("__at", "a"))
    near = placed.select("a", F.explode(F.slice(items, F.col("__at") + 2, F.lit(window))).alias("b")).dropna()
    # Counted before they are turned round.
    once = near.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return once.select("n", both.alias("p")).groupBy("p.a", "p.b").agg(F.sum("n").alias("n")).select("a", "b", "n")


def positive_information(counts: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(a, b, weight)``: the logarithm of how much more often than chance, where that is above zero."""
    counts = counts.persist(StorageLevel.MEMORY_AND_DISK)
    total = counts.agg(F.sum("n")).first()[0] or 0
    of = counts.groupBy("a").agg(F.sum("n").alias("__of"))
    joined = lookup_join(counts, of.withColumnRenamed("__of", "__a"), "a", hot_rows=hot_rows)
    joined = lookup_join(joined, of.select(F.col("a").alias("b"), F.col("__of").alias("__b")), "b", hot_rows=hot_rows)
    ratio = F.col("n") * F.lit(float(total)) / (F.col("__a").cast("double") * F.col("__b"))
    found = joined.where(ratio > 1).select("a", "b", F.log(ratio).alias("weight"))
    ensure_checkpoint_dir(counts.sparkSession)
    found = found.checkpoint()
    counts.unpersist()
    return found


def _turned(vectors: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Each vector times a small matrix."""
    size, width = matrix.shape
    parts = [sum((F.col("vector")[i] * F.lit(float(matrix[i, j])) for i in range(size)), F.lit(0.0)) for j in range(width)]
    return vectors.select("item", F.array(*parts).alias("vector"))


def _products(rows: DataFrame, left: Column, right: Column, size: int) -> np.ndarray:
    """The sum of all outer products, a matrix of the vectors' size."""
    sums = [F.sum(left[i] * right[j]) for i in range(size) for j in range(size)]
    return np.array([x or 0.0 for x in rows.agg(*sums).first()], float).reshape(size, size)


def _stepped(entries: DataFrame, vectors: DataFrame, size: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The matrix times the vectors."""
    named = vectors.select(F.col("item").alias("b"), F.col("vector").alias("__v"))
    rows = lookup_join(entries, named, "b", "inner", hot_rows=hot_rows)
    sums = [F.sum(F.col("weight") * F.col("__v")[i]).alias(f"s{i}") for i in range(size)]
    found = rows.groupBy(F.col("a").alias("item")).agg(*sums)
    return found.select("item", F.array(*[f"s{i}" for i in range(size)]).alias("vector"))


def leading_vectors(
    entries: DataFrame, size: int = VECTOR_SIZE, *, steps: int = STEPS, seed: int = 42, hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, list[float]]:
    """The leading eigenvectors of a symmetric ``(a, b, weight)``: ``(item, vector)``, and the eigenvalues.

    Element i of an item's vector is its element of the i-th eigenvector, times the root of
    the eigenvalue (zero for a negative one). Vectors are made orthogonal again after a few
    steps, so no direction drowns in the first one. With fewer items than ``size`` the
    further elements are zero. Without entries there are no vectors.
    """
    ensure_checkpoint_dir(entries.sparkSession)
    starts = [draw(F.lit(seed), F.lit(i), F.col("item")) / F.lit(float(2**59)) - 1 for i in range(size)]
    items = entries.select(F.col("a").alias("item")).distinct()
    vectors = items.select("item", F.array(*starts).alias("vector")).checkpoint()
    for step in range(steps):
        if step % STEPS_PER_TURN == 0 or step == steps - 1:
            spread, basis = np.linalg.eigh(_products(vectors, F.col("vector"), F.col("vector"), size))
            # Directions that have vanished stay zero.
            kept = spread > max(spread.max(), 0) * 1e-12
            vectors = _turned(vectors, basis * np.where(kept, 1 / np.sqrt(np.maximum(spread, 1e-300)), 0.0))
        last, vectors = vectors, _stepped(entries, vectors, size, hot_rows).checkpoint()
    # Within the space that was found, the eigenvectors are those of a small matrix.
    meets = last.withColumnRenamed("vector", "__x").join(vectors, "item")
    small = _products(meets, F.col("__x"), F.col("vector"), size)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)
    values, turn = values[order], turn[:, order]
    # The matrix times an eigenvector is the eigenvalue times it.
    rooted = np.where(values > 1e-12, 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
    return _turned(vectors, turn * rooted), values.tolist()


def pmi_vectors(
    sequences: DataFrame,
    items: str = "movieIds",
    *,
    size: int = VECTOR_SIZE,
    window: int = WINDOW_SIZE,
    steps: int = STEPS,
    seed: int = 42,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``(item, vector)`` for every item that is near some other more often than chance, however rare."""
    entries = positive_information(co_occurrences(sequences, items, window=window), hot_rows=hot_rows)
    return leading_vectors(entries, size, steps=steps, seed=seed, hot_rows=hot_rows)[0]
