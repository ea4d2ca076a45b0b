"""The best matches of a given set of query vectors among all vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions.scalars import dot
from tastemill.operators.embeddings import SIMILAR_ITEMS
from tastemill.operators.skew import BROADCAST_BYTES

# Queries that one task holds, at most and as few as are worth a task, and those that it compares at a time.
BLOCK_QUERIES = 262_144
LEAST_QUERIES = 4_096
STEP_QUERIES = 256
# Longest vectors, whose scores a list's entries must reach where there are several pieces.
LONG_VECTORS = 1024
# Vectors of about one length that are compared, or left out, together.
BLOCK_VECTORS = 1024
# What rounding can add to a dot product, as a share of its bound.
ROUNDING = 1e-9


def matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    """A column of arrays of one length, without nulls, as a matrix with one row for each."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def exact_dots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Dot products row by row, added up from the first element to the last as ``dot`` does."""
    total = np.zeros(len(left))
    for j in range(left.shape[1]):
        total += left[:, j] * right[:, j]
    return total


def _falling(scores: np.ndarray) -> np.ndarray:
    """What sorts scores in falling order, NaN first as Spark does."""
    return np.where(np.isnan(scores), -np.inf, -scores)


def top_matches(
    queries: np.ndarray, vectors: np.ndarray, k: int, *, block_vectors: int = BLOCK_VECTORS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` largest dot products of each row of ``queries`` with rows of ``vectors``.

    Gives the places of the vectors (-1 where there are fewer than ``k``) and the
    scores as matrices with one row for each query, best first, ties by place, and how many vectors each query
    met. Vectors are met in blocks by falling length; a query is done when its
    k-th best is above its bound for a block. Matrix products only find the candidates, whose scores
    are then computed one by one, so that equal vectors have equal scores.
    """
    n, m = len(queries), len(vectors)
    lists = Lists(queries, k)
    if n and m:
        lists.meet(np.arange(n), vectors, np.arange(m), block_vectors=block_vectors)
    return lists.places, lists.scores, lists.met


class Lists:
    """The best ``k`` so far of each row of ``queries``, as ``top_matches`` gives them."""

    def __init__(self, queries: np.ndarray, k: int) -> None:
        n = len(queries)
        self.queries, self.k = queries, k
        self.places, self.scores = np.full((n, k), -1), np.full((n, k), -np.inf)
        self.count, self.met = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def meet(self, rows: np.ndarray, vectors: np.ndarray, own: np.ndarray, *, block_vectors: int = BLOCK_VECTORS, step: int = STEP_QUERIES) -> None:
        """Show some queries the vectors that stand at the places ``own``, which rise."""
        k = self.k
        with np.errstate(invalid="ignore", over="ignore"):
            lengths = np.sqrt((vectors * vectors).sum(1))
            mixed = np.sqrt(np.arange(2.0, 2 + vectors.shape[1]))[None, :]
            # Equal vectors stand together by the second key; of each no more than k can be in a list. NaN comes first.
            order = np.lexsort((own, exact_dots(vectors, mixed), _falling(lengths)))
            held = vectors[order]
            same = np.append(False, (held[1:] == held[:-1]).all(1))
            at = np.arange(len(held))
            kept = at - np.maximum.accumulate(np.where(same, 0, at)) < k
            order, held = order[kept], held[kept]
            lengths = lengths[order]
            reach = np.sqrt((self.queries[rows] ** 2).sum(1))
            # All scores of a zero vector are zero, so its list is that of the first places.
            zero = (self.queries[rows] == 0).all(1) & bool(np.isfinite(lengths[:1]).all())
            for start in range(0, len(rows), step):
                here, none = rows[start : start + step], zero[start : start + step]
                if none.any():
                    few = np.arange(min(k, len(vectors)))
                    self._merge(np.repeat(here[none], len(few)), np.tile(few, none.sum()), vectors, own)
                    self.met[here[none]] += len(vectors)
                if not none.all():
                    self._fill(here[~none], reach[start : start + step][~none], held, lengths, own[order], block_vectors)

    def _fill(self, rows: np.ndarray, reach: np.ndarray, vectors: np.ndarray, lengths: np.ndarray, own: np.ndarray, block: int) -> None:
        """Meet vectors by falling length, as far as a query is open."""
        at, size, k = 0, max(block, self.k), self.k
        while at < len(vectors):
            part = vectors[at : at + size]
            bound = reach * lengths[at]
            slack = bound * ROUNDING
            short = self.count[rows] < k
            least = np.where(short, -np.inf, -_falling(self.scores[rows, k - 1]))
            # Without numbers nothing is known, so such queries stay open.
            still = short | ~(bound + slack < least)
            rows, reach, slack, least, short = rows[still], reach[still], slack[still], least[still], short[still]
            if not len(rows):
                return
            self.met[rows] += len(part)
            found = self.queries[rows] @ part.T
            if short.any() and found.shape[1] > k:
                # Fewer candidates: none below the k-th best of this block.
                best = -np.partition(_falling(found), k - 1, axis=1)[:, k - 1]
                least = np.where(np.isnan(slack), -np.inf, np.maximum(least, best))
            # Finding places in the flat array takes a fifth of the time.
            near = np.flatnonzero(~(found < (least - 2 * slack)[:, None]))
            if len(near):
                row, column = np.divmod(near, len(part))
                self._merge(rows[row], at + column, vectors, own)
            # Later blocks are larger, as few of their vectors get through.
            at, size = at + size, min(4 * size, max(block, 8_192)) if block >= BLOCK_VECTORS else size

    def _merge(self, rows: np.ndarray, at: np.ndarray, vectors: np.ndarray, own: np.ndarray) -> None:
        """Add candidates, pairs of a query and the vector in row ``at``, to the lists."""
        k, touched = self.k, np.unique(rows)
        held = self.count[touched]
        old = np.repeat(touched, held)
        within = np.arange(len(old)) - np.repeat(np.cumsum(held) - held, held)
        some = [slice(i, i + 65_536) for i in range(0, len(rows), 65_536)]
        made = np.concatenate([exact_dots(self.queries[rows[i]], vectors[at[i]]) for i in some])
        row = np.concatenate([old, rows])
        place = np.concatenate([self.places[old, within], own[at]])
        score = np.concatenate([self.scores[old, within], made])
        best = np.lexsort((place, _falling(score), row))
        row, place, score = row[best], place[best], score[best]
        first = np.searchsorted(row, touched)
        n = np.diff(np.append(first, len(row)))
        position = np.arange(len(row)) - np.repeat(first, n)
        kept = position < k
        self.places[row[kept], position[kept]], self.scores[row[kept], position[kept]] = place[kept], score[kept]
        self.count[touched] = np.minimum(k, n)


def listed(queries: pa.Array, items: pa.Array, places: np.ndarray, scores: np.ndarray) -> list[pa.Array]:
    """Filled entries of ``top_matches`` as columns: query, item and score."""
    row, column = np.nonzero(places >= 0)
    return [queries.take(pa.array(row)), items.take(pa.array(places[row, column])), pa.array(scores[row, column])]


def by_item(table: pa.Table) -> pa.Table:
    """Rows in the order of ``item``, a null one first as Spark sorts."""
    return table.take(pc.sort_indices(table, sort_keys=[("item", "ascending")], null_placement="at_start"))


def _floor(queries: np.ndarray, long: pa.Table, k: int) -> np.ndarray:
    """What the ``k``-th best of some vectors gives each query at least; nothing where that is no number."""
    least = np.full(len(queries), -np.inf)
    if long.num_rows < k:
        return least
    vectors = matrix(long.column("vector"), long.num_rows)
    with np.errstate(invalid="ignore", over="ignore"):
        reach = np.sqrt((queries**2).sum(1)) * np.sqrt((vectors * vectors).sum(1).max())
        for at in range(0, len(queries), 16 * STEP_QUERIES):
            part = slice(at, at + 16 * STEP_QUERIES)
            least[part] = -np.partition(_falling(queries[part] @ vectors.T), k - 1, axis=1)[:, k - 1]
        least -= 2 * reach * ROUNDING
    return np.where(np.isfinite(least), least, -np.inf)


def _matches(queries: DataFrame, vectors: DataFrame, k: int, block_queries: int, block_vectors: int, pass_bytes: int) -> DataFrame:
    """The best ``k`` of each query: ``(query, item, score, rank, scored)``.

    Queries are dealt into chunks and vectors into pieces by hashes of their items, and each chunk meets
    each piece in one group, which holds ``block_queries`` with their lists and vectors, each within
    ``pass_bytes``. Queries move once for each piece and vectors once for each chunk. A piece gives out the first of a query's
    list and what reaches the ``k``-th best of the longest vectors of all; less can't be in the whole list.
    """
    # Vectors of another length, and with null elements, match nothing.
    whole = lambda df: df.where(dot("vector", "vector").isNotNull())
    asked, held = whole(queries), whole(vectors)
    rows = asked.count()
    n, width = held.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    pieces = max(1, -(-n * (8 * width + 16) // pass_bytes))
    tasks = -(-2 * queries.sparkSession.sparkContext.defaultParallelism // pieces)
    most = max(1, min(block_queries, pass_bytes // (8 * width + 16 * k)))
    chunks = max(1, -(-rows // most), min(tasks, rows // LEAST_QUERIES))
    norm = dot("vector", "vector")
    long = held.select("vector", F.size("vector").alias("size")).orderBy(norm.desc()).limit(LONG_VECTORS).toArrow() if pieces > 1 else None
    dealt = lambda column, parts: F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    size = F.size("vector").alias("size")
    # Names of their own, since both may be parts of one table.
    left = asked.select(F.col("item").alias("query"), F.col("vector").alias("wanted"), size, dealt("item", chunks).alias("chunk"), each(pieces).alias("piece"))
    right = held.select("item", "vector", size, dealt("item", pieces).alias("piece"), each(chunks).alias("chunk"))
    kinds = [df.schema["item"].dataType.simpleString() for df in (queries, vectors)]
    names = ["query", "item", "score", "scored"]

    def compare(some: pa.Table, others: pa.Table) -> pa.Table:
        others = by_item(others)
        own, items = some.column("query").combine_chunks(), others.column("item").combine_chunks()
        if not len(own) or not len(items):
            return pa.table([own[:0], items[:0], pa.array([], pa.float64()), pa.array([], pa.int64())], names)
        places, scores, met = top_matches(
            matrix(some.column("wanted"), len(own)), matrix(others.column("vector"), len(items)), k, block_vectors=block_vectors
        )
        if long is not None:
            least = _floor(matrix(some.column("wanted"), len(own)), long.filter(pc.equal(long.column("size"), some.column("size")[0])), k)
            places[(scores < least[:, None]) & (np.arange(k) > 0)] = -1
        # What a query met in this piece stands in its first row only.
        scored = np.where(np.arange(k) == 0, met[:, None], 0)[places >= 0]
        return pa.table([*listed(own, items, places, scores), pa.array(scored)], names)

    keys = ["size", "chunk", "piece"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        compare, f"query {kinds[0]}, item {kinds[1]}, score double, scored long"
    )
    best_first = Window.partitionBy("query").orderBy(F.col("score").desc(), "item")
    found = found.select("*", F.row_number().over(best_first).alias("rank"), F.sum("scored").over(Window.partitionBy("query")).alias("all"))
    return found.where(F.col("rank") <= k).select("query", "item", "score", "rank", F.col("all").alias("scored"))


def best_matches(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    *,
    block_queries: int = BLOCK_QUERIES,
    pass_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The ``k`` largest dot products of each query: ``(query, item, score, rank)``.

    Both tables are ``(item, vector)`` with arrays of one length. Chunks of queries meet
    pieces of the vectors, each pair in a group of bounded size, which gives
    its own best ``k`` per query. Ties go to the smaller item.
    Without queries or vectors there are no rows; null vectors match nothing.
    """
    return _matches(queries, vectors, k, block_queries, BLOCK_VECTORS, pass_bytes).select("query", "item", "score", "rank")


def pruned_matches(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    *,
    block_queries: int = BLOCK_QUERIES,
    block_vectors: int = BLOCK_VECTORS,
    pass_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """As ``best_matches``, also with ``scored``: how many vectors were compared with a query.

    Both tables have different items. In each piece vectors are met by falling
    length. No dot product exceeds the product of both lengths, so a query whose k-th best so far
    is above its bound for a block is done with this block and all after it.
    Exact for any vectors; where all are of one length nothing is left out.
    """
    found = _matches(queries.where("item IS NOT NULL"), vectors, k, block_queries, block_vectors, pass_bytes)
    return found.select("query", F.col("item").cast("long").alias("item"), "score", "rank", "scored")


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """Vectors divided by their length; those of length zero are left out."""
    norm = F.sqrt(dot("vector", "vector"))
    # An array of norms, since one used inside the function would be computed for every element.
    norms = F.array_repeat(norm, F.size("vector"))
    return vectors.where(norm > 0).select("item", F.zip_with("vector", norms, lambda x, n: x / n).alias("vector"))


def similar_items_batch(queries: DataFrame, vectors: DataFrame, k: int = SIMILAR_ITEMS) -> DataFrame:
    """The ``k`` items most similar by cosine to each query item: ``(query, item, similarity)``.

    An item isn't similar to itself. Repeated items must not occur in either table.
    """
    found = best_matches(unit_vectors(queries), unit_vectors(vectors), k + 1).where("query <> item")
    best_first = Window.partitionBy("query").orderBy("rank")
    kept = found.withColumn("n", F.row_number().over(best_first)).where(F.col("n") <= k)
    return kept.select("query", "item", F.col("score").alias("similarity"))
