"""Item, graph and user embeddings, and similar items."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.columns import RatingColumns
from tastemill.functions.scalars import dot
from tastemill.operators.sequences import SEGMENT_ITEMS, item_pairs, user_sequences
from tastemill.operators.skew import HOT_ROWS, fits_broadcast, hot_keys, lookup_join
from tastemill.operators.skip_grams import ItemVectors, fit_skip_grams
from tastemill.operators.walks import WALK_LENGTH, WALKS, walk_paths

# Fixed values.
VECTOR_SIZE = 10
WINDOW_SIZE = 5
ITERATIONS = 10
SIMILAR_ITEMS = 20
LEAST_COUNT = 5

# Sequences trained on by one Word2Vec task in one pass.
SEQUENCES_PER_TASK = 100_000
# Word2Vec keeps up to this many items, with codes and vectors, on the driver and in every task.
DRIVER_ITEMS = 100_000


def fit_item2vec(
    sequences: DataFrame,
    items: str = "movieIds",
    *,
    size: int = VECTOR_SIZE,
    window: int = WINDOW_SIZE,
    iterations: int = ITERATIONS,
    seed: int = 42,
    partitions: int | None = None,
    least: int = LEAST_COUNT,
    driver_items: int = DRIVER_ITEMS,
) -> Word2VecModel | ItemVectors:
    """Train item vectors on item sequences.

    Items that occur fewer than ``least`` times get no vector. With more than ``driver_items``
    others the vectors are trained by ``fit_skip_grams``, in shards, and not by Word2Vec.

    Word2Vec trains in one task unless told otherwise. The number of tasks here
    grows with the number of sequences. Sequences are sorted by their other
    columns, which identify them, so that the same data is trained on in the
    same order. They are kept while they are counted, sorted and trained on.
    """
    own = not sequences.is_cached
    if own:
        sequences = sequences.persist(StorageLevel.MEMORY_AND_DISK)
    known = sequences.select(F.explode(items).alias("__item")).groupBy("__item").count().where(F.col("count") >= least)
    if known.count() > driver_items:
        found = fit_skip_grams(sequences, items, size=size, window=window, iterations=iterations, seed=seed, least=least)
        if own:
            sequences.unpersist()
        return found
    if partitions is None:
        partitions = sequences.count() // SEQUENCES_PER_TASK + 1
    ids = [c for c in sequences.columns if c != items]
    words = sequences.orderBy(*ids) if ids else sequences
    model = Word2Vec(
        inputCol="words",
        outputCol="vector",
        vectorSize=size,
        windowSize=window,
        maxIter=iterations,
        maxSentenceLength=SEGMENT_ITEMS,
        numPartitions=partitions,
        seed=seed,
        minCount=least,
    ).fit(words.select(F.col(items).cast("array<string>").alias("words")))
    if own:
        sequences.unpersist()
    return model


def model_vectors(model: Word2VecModel | ItemVectors, item_type: str = "long") -> DataFrame:
    """Trained vectors as ``(item, vector)`` with an array of double."""
    return model.getVectors().select(
        F.col("word").cast(item_type).alias("item"), vector_to_array("vector").alias("vector")
    )


def item2vec(ratings: DataFrame, cols: RatingColumns = RatingColumns(), **options) -> Word2VecModel | ItemVectors:
    """Item vectors from the order in which users liked items."""
    return fit_item2vec(user_sequences(ratings, cols), **options)


def deepwalk(
    ratings: DataFrame,
    cols: RatingColumns = RatingColumns(),
    *,
    walks: int = WALKS,
    walks_per_item: int | None = None,
    length: int = WALK_LENGTH,
    **options,
) -> Word2VecModel | ItemVectors:
    """Item vectors from random walks over the transition graph.

    With ``walks_per_item`` the number of walks grows with the items that a walk
    can start from, and ``walks`` is not used.
    """
    pairs = item_pairs(ratings, cols)
    if walks_per_item is not None:
        pairs = pairs.persist(StorageLevel.MEMORY_AND_DISK)
        walks = walks_per_item * pairs.select("src").distinct().count()
    model = fit_item2vec(walk_paths(pairs, walks=walks, length=length), "path", **options)
    pairs.unpersist()
    return model


def attach_vectors(
    df: DataFrame,
    vectors: DataFrame,
    key: str,
    output: str,
    size: int,
    *,
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add the vector stored for ``key`` in ``(item, vector)``, zeros if there is none.

    Rows per key are counted on ``counted``, by default on ``df`` itself.
    """
    named = vectors.select(F.col("item").alias(key), F.col("vector").alias(output))
    joined = lookup_join(df, named, key, hot_rows=hot_rows, counted=counted)
    return joined.withColumn(output, F.coalesce(F.col(output), F.array_repeat(F.lit(0.0), size)))


def user_vectors(
    ratings: DataFrame,
    vectors: DataFrame,
    size: int = VECTOR_SIZE,
    cols: RatingColumns = RatingColumns(),
    *,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Sum of the vectors of all items a user rated: ``(user, vector)``.

    Items without a vector add nothing. Repeated ratings are counted before the
    join. Where the vectors fit a broadcast and no user has more than ``hot_rows``
    ratings, the ratings are shuffled by user once, and no sums move; else the
    sums are combined before their shuffle.
    """
    if fits_broadcast(vectors) and hot_keys(ratings, [cols.user], hot_rows) is None:
        ratings = ratings.select(cols.user, cols.item).repartition(cols.user)
    counted = ratings.groupBy(cols.user, cols.item).agg(F.count(F.lit(1)).alias("__times"))
    named = vectors.select(F.col("item").alias(cols.item), "vector")
    joined = lookup_join(counted, named, cols.item, hot_rows=hot_rows)
    sums = [F.coalesce(F.sum(F.col("__times") * F.col("vector")[i]), F.lit(0.0)) for i in range(size)]
    return joined.groupBy(cols.user).agg(F.array(*sums).alias("vector"))


def _norm(vector: str | Column) -> Column:
    return F.sqrt(dot(vector, vector))


def similar_items(vectors: DataFrame, item: object, k: int = SIMILAR_ITEMS) -> DataFrame:
    """The ``k`` items most similar to ``item`` by cosine: ``(item, similarity)``.

    One pass over the vectors; each task keeps its own best ``k``. An unknown
    item gives no rows.
    """
    # One value: items are unique in the table of vectors.
    query = vectors.where(F.col("item") == F.lit(item)).select("vector").scalar()
    similarity = F.try_divide(dot("vector", "__query"), _norm("vector") * _norm("__query"))
    return (
        vectors.where(F.col("item") != F.lit(item))
        .withColumn("__query", query)
        .select("item", similarity.alias("similarity"))
        .where(F.col("similarity").isNotNull())
        .orderBy(F.col("similarity").desc(), "item")
        .limit(k)
    )


def synonyms(model: Word2VecModel | ItemVectors, item: object, k: int = SIMILAR_ITEMS) -> DataFrame:
    """Similar items out of a trained model."""
    return similar_items(model_vectors(model, "string"), str(item), k)
