"""An index of vectors by cells, for the similar items of a whole catalogue.

Cells are the regions of k-means centres, which are fitted on a bounded sample;
every vector is put into the cell of its nearest centre. A query looks into the
few cells whose centres are nearest to it only. How many that must be for a
wanted recall is measured on some queries against the exact search. Looking into
all cells is the exact search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemill.operators.embeddings import SIMILAR_ITEMS
from tastemill.operators.neighbours import Lists, best_matches, by_item, listed, matrix, unit_vectors
from tastemill.session import ensure_checkpoint_dir

# Vectors that centres are fitted on, at most but for the chance of a hash.
SAMPLE_ROWS = 50_000
MOST_CELLS = 4_096
# Vectors of a cell, and queries for it, that one task compares at a time.
PIECE_ROWS = 32_768
# What a task makes of some of its rows at a time.
SLICE_BYTES = 16 << 20
# Queries that the number of cells to look into is measured on.
MEASURED_QUERIES = 200
# Above what is wanted of other queries (0.9), since few queries are measured.
RECALL = 0.98


@dataclass(frozen=True)
class VectorIndex:
    """``table`` is ``(item, vector, cell)`` with vectors of length one."""

    centres: np.ndarray
    table: DataFrame


def _nearest(held: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest cells of each vector, nearest first."""
    return np.argsort((centres * centres).sum(1) / 2 - held @ centres.T, axis=1, kind="stable")[:, :n]


def _slices(batches: Iterator[pa.RecordBatch], row_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that what is made of one takes ``SLICE_BYTES`` or so."""
    rows = max(1, SLICE_BYTES // row_bytes)
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _with_cells(vectors: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """Each vector with its ``n`` nearest cells: ``(item, vector, cell, place)``, places from 1."""
    kind = vectors.schema["item"].dataType.simpleString()
    row_bytes = 16 * len(centres) + n * 8 * (centres.shape[1] + 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, row_bytes):
            rows = batch.num_rows
            cells = _nearest(matrix(batch.column("vector"), rows), centres, n)
            places = np.tile(np.arange(1, cells.shape[1] + 1, dtype=np.int32), rows)
            repeated = batch.take(pa.array(np.repeat(np.arange(rows), cells.shape[1])))
            made = [repeated.column("item"), repeated.column("vector"), pa.array(cells.ravel().astype(np.int32)), pa.array(places)]
            yield pa.RecordBatch.from_arrays(made, ["item", "vector", "cell", "place"])

    return vectors.select("item", "vector").mapInArrow(run, f"item {kind}, vector array<double>, cell int, place int")


def fit_index(
    vectors: DataFrame, *, cells: int | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 42
) -> VectorIndex | None:
    """Index every row of ``(item, vector)``, whose items are unique; None without vectors.

    There are about as many cells as the square root of the number of vectors, ``MOST_CELLS`` at
    most. Centres are fitted on about ``sample_rows`` vectors, chosen by the hash
    of their item. Null vectors and those of length zero are left out, as in the
    exact search.
    """
    ensure_checkpoint_dir(vectors.sparkSession)
    units = unit_vectors(vectors).checkpoint()
    n = units.count()
    if not n:
        return None
    share = min(1.0, sample_rows / n)
    chosen = units.where(F.pmod(F.xxhash64("item"), F.lit(1_000_000)) < math.ceil(share * 1_000_000))
    cells = cells or min(MOST_CELLS, math.isqrt(n) or 1)
    features = chosen.select(array_to_vector("vector").alias("features")).persist()
    held = features.count()
    if not held:
        centres = np.array([units.first()["vector"]])
    elif held < 2 or cells < 2:
        centres = np.array([features.first()["features"].toArray()])
    else:
        model = KMeans(k=min(cells, held), maxIter=10, seed=seed, initMode="random").fit(features)
        centres = np.array(model.clusterCenters())
    features.unpersist()
    return VectorIndex(centres, _with_cells(units, centres, 1).drop("place").checkpoint())


def measured_probes(
    index: VectorIndex, k: int = SIMILAR_ITEMS, recall: float = RECALL, queries: int = MEASURED_QUERIES
) -> int:
    """In how many cells to look so that ``recall`` of the ``k`` best are found, on some queries.

    These are the items of the least hashes. Their exact lists tell how
    far down in the order of cells each match lies.
    """
    some = index.table.select("item", "vector").orderBy(F.xxhash64("item"), "item").limit(queries).persist()
    exact = best_matches(some, index.table.select("item", "vector"), k + 1).where("query <> item")
    homes = exact.select("query", "item").join(index.table.select("item", "cell"), "item")
    order = _with_cells(some, index.centres, len(index.centres)).select(F.col("item").alias("query"), "cell", "place")
    counts = homes.join(order, ["query", "cell"]).groupBy("place").count().orderBy("place").collect()
    some.unpersist()
    total, found = sum(r["count"] for r in counts), 0
    for r in counts:
        found += r["count"]
        if found >= recall * total:
            return r["place"]
    return 1


def _bundles(sizes: dict[int, int], most: int) -> dict[int, list[int]]:
    """Cells dealt to bundles of ``most`` vectors or so: the bundles of each cell, several if it is larger."""
    bundles, number, held = {}, 0, 0
    for cell, n in sorted(sizes.items()):
        parts = -(-n // most)
        if held and (parts > 1 or held + n > most):
            number, held = number + 1, 0
        bundles[cell] = list(range(number, number + parts))
        number, held = (number + parts, 0) if parts > 1 else (number, held + n)
    return bundles


def search(
    index: VectorIndex, queries: DataFrame, k: int = SIMILAR_ITEMS, *, probes: int, piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """The ``k`` items most similar by cosine in the ``probes`` nearest cells: ``(query, item, similarity, rank)``.

    Cells are put together to bundles of ``piece_rows`` vectors or so, and a larger cell is cut. A query goes
    to each bundle once, with the cells to look into there, and the queries for a bundle are cut into
    chunks, so no task holds more than about ``piece_rows`` of either. An
    item isn't similar to itself; ties go to the smaller item.
    """
    kind = index.table.schema["item"].dataType.simpleString()
    # One number for each cell, so MOST_CELLS at most.
    bundles = _bundles({r["cell"]: r["count"] for r in index.table.groupBy("cell").count().collect()}, piece_rows)
    units = unit_vectors(queries)
    chunks = max(1, -(-units.count() // piece_rows))
    # Table of all pairs of a cell and one of its bundles, sorted by cell.
    pairs = np.array([(c, b) for c, own in sorted(bundles.items()) for b in own] or np.empty((0, 2)), np.int64).reshape(-1, 2)
    first = np.searchsorted(pairs[:, 0], np.arange(len(index.centres)))
    parts = np.searchsorted(pairs[:, 0], np.arange(len(index.centres)), side="right") - first
    spread = F.element_at(F.array(*[F.lit(int(b)) for b in pairs[:, 1]] or [F.lit(0)]), F.col("at") + 1).alias("bundle")
    at = [F.element_at(F.array(*[F.lit(int(x)) for x in numbers]), F.col("cell") + 1) for numbers in (first, parts)]
    own = at[0] + F.pmod(F.xxhash64("item"), at[1]).cast("int")
    held = index.table.withColumn("at", own).select("item", "vector", "cell", spread)
    centres, item_kind = index.centres, units.schema["item"].dataType.simpleString()
    row_bytes = 64 * len(centres) + 8 * (centres.shape[1] + 4) * (int(pairs[:, 1].max()) + 1 if len(pairs) else 1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, row_bytes):
            cells = _nearest(matrix(batch.column("vector"), batch.num_rows), centres, probes)
            row, cell = np.repeat(np.arange(len(cells)), cells.shape[1]), cells.ravel()
            n = parts[cell]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row, cell, bundle = np.repeat(row, n), np.repeat(cell, n), pairs[np.repeat(first[cell], n) + within, 1]
            order = np.lexsort((cell, bundle, row))
            row, cell, bundle = row[order], cell[order], bundle[order]
            new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (bundle[1:] != bundle[:-1]))) if len(row) else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(np.append(new, len(row)).astype(np.int32), cell.astype(np.int32))
            repeated = batch.take(pa.array(row[new]))
            made = [repeated.column("item"), repeated.column("vector"), lists, pa.array(bundle[new].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(made, ["query", "vector", "cells", "bundle"])

    asked = units.mapInArrow(ask, f"query {item_kind}, vector array<double>, cells array<int>, bundle int")
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("query"), F.lit(chunks)).cast("int"))
    held = held.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query", "item", "similarity"]
        right = by_item(right)
        owners, items = left.column("query").combine_chunks(), right.column("item").combine_chunks()
        if not len(owners) or not len(items):
            return pa.table([owners[:0], items[:0], pa.array([], pa.float64())], names)
        vectors, cells = matrix(right.column("vector"), len(items)), right.column("cell").to_numpy()
        lists = Lists(matrix(left.column("vector"), len(owners)), k + 1)
        looks = left.column("cells").combine_chunks()
        wanted = looks.flatten().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(owners)), looks.value_lengths().to_numpy(zero_copy_only=False))
        by_cell = np.argsort(wanted, kind="stable")
        rows, wanted = rows[by_cell], wanted[by_cell]
        for cell in np.unique(cells):
            some = rows[np.searchsorted(wanted, cell) : np.searchsorted(wanted, cell, side="right")]
            own = np.flatnonzero(cells == cell)
            if len(some):
                # More queries at a time where a cell is small.
                lists.meet(some, vectors[own], own, step=max(256, min(4_096, (1 << 20) // len(own))))
        return pa.table(listed(owners, items, lists.places, lists.scores), names)

    keys = ["bundle", "chunk"]
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(compare, f"query {item_kind}, item {kind}, similarity double")
    best_first = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "item")
    ranked = found.where("query <> item").withColumn("rank", F.row_number().over(best_first))
    return ranked.where(F.col("rank") <= k)


def recall_table(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``queries`` and ``recall``: which share of the pairs in ``exact`` is in ``found``, both with (query, item)."""
    hits = found.select("query", "item").distinct().withColumn("hit", F.lit(1))
    joined = exact.select("query", "item").join(hits, ["query", "item"], "left")
    return joined.agg(
        F.count_distinct("query").alias("queries"), (F.count("hit") / F.count(F.lit(1))).alias("recall")
    )
