"""Collaborative filtering with ALS: factors, recommendations, evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.columns import RatingColumns
from tastemill.functions.scalars import draw
from tastemill.operators.encoders import label_index
from tastemill.operators.neighbours import pruned_matches
from tastemill.operators.skew import HOT_ROWS, lookup_join
from tastemill.session import ensure_checkpoint_dir

# Fixed values.
ITERATIONS = 5
REGULARIZATION = 0.01
TOP_K = 10
FOLDS = 10
SUBSET_SIZE = 3

# Models that cross-validation fits side by side.
MODELS_AT_ONCE = 4

USER, ITEM, RATING = "userIdInt", "movieIdInt", "ratingFloat"


def als_input(ratings: DataFrame, cols: RatingColumns = RatingColumns(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Ratings with the integer ids ALS needs.

    Rows whose ids or rating are missing or no numbers are left out. An id that
    is a number beyond 32 bits is an error: number such ids with ``dense_ids``.
    """

    def narrow(column: str) -> Column:
        wide = F.col(column).try_cast("decimal(38,0)")
        message = F.concat(F.lit(f"{column} beyond 32 bits, use dense_ids: "), wide.cast("string"))
        return F.when(wide.between(-(2**31), 2**31 - 1), wide.cast("int")).when(
            wide.isNotNull(), F.raise_error(message).cast("int")
        )

    return ratings.select(
        narrow(cols.user).alias(USER),
        narrow(cols.item).alias(ITEM),
        F.col(cols.rating).try_cast("double").alias(RATING),
        *keep,
    ).dropna(subset=[USER, ITEM, RATING])


def dense_ids(ratings: DataFrame, column: str, *, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Ratings with ``column`` numbered 0, 1, ... by falling frequency, and the table ``(original, number)``.

    For ids beyond 32 bits, or that are no numbers. The table is checkpointed,
    so that the numbers stay what they are.
    """
    ensure_checkpoint_dir(ratings.sparkSession)
    index = label_index(ratings, column, "__number", hot_rows=hot_rows).select(column, "__number").checkpoint()
    numbered = lookup_join(ratings, index, column, "inner", hot_rows=hot_rows)
    columns = [F.col("__number").alias(column) if c == column else F.col(c) for c in ratings.columns]
    table = index.select(F.col(column).alias("original"), F.col("__number").alias("number"))
    return numbered.select(*columns), table


def original_ids(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """Put the original ids of ``dense_ids`` back in the place of numbers."""
    index = table.select(F.col("number").alias(column), F.col("original").alias("__original"))
    columns = [F.col("__original").alias(column) if c == column else F.col(c) for c in df.columns]
    return lookup_join(df, index, column, "inner").select(*columns)


def fit_als(
    ratings: DataFrame,
    *,
    iterations: int = ITERATIONS,
    regularization: float = REGULARIZATION,
    rank: int = 10,
    seed: int = 42,
    blocks: int | None = None,
) -> ALSModel:
    """Factorize ratings prepared by ``als_input``.

    ALS works in as many tasks as it has blocks, ten by default. Here there are
    as many as the cluster has cores. Users or items without factors are left
    out of predictions, by the estimator itself, so that cross-validation sees
    no NaN either. Each iteration is checkpointed: ALS then deletes the shuffle files of
    those before, which stay on disk otherwise.
    """
    spark = ratings.sparkSession
    ensure_checkpoint_dir(spark)
    blocks = blocks or max(10, spark.sparkContext.defaultParallelism)
    return ALS(
        userCol=USER,
        itemCol=ITEM,
        ratingCol=RATING,
        maxIter=iterations,
        regParam=regularization,
        rank=rank,
        seed=seed,
        numUserBlocks=blocks,
        numItemBlocks=blocks,
        coldStartStrategy="drop",
        checkpointInterval=1,
    ).fit(ratings)


def factors(model: ALSModel, side: str) -> DataFrame:
    """Latent factors of ``users`` or ``items`` as ``(item, vector)``."""
    table = model.userFactors if side == "users" else model.itemFactors
    return table.select(F.col("id").cast("long").alias("item"), F.col("features").cast("array<double>").alias("vector"))


def rmse(predictions: DataFrame, label: str = RATING, prediction: str = "prediction") -> float:
    """Root mean squared error of stored predictions."""
    return RegressionEvaluator(metricName="rmse", labelCol=label, predictionCol=prediction).evaluate(predictions)


def rmse_table(predictions: DataFrame, label: str = RATING, prediction: str = "prediction") -> DataFrame:
    """The same error as a one-row table."""
    error = F.col(prediction).cast("double") - F.col(label).cast("double")
    return predictions.agg(F.sqrt(F.avg(error * error)).alias("rmse"))


def first_ids(ratings: DataFrame, column: str, n: int = SUBSET_SIZE) -> DataFrame:
    """The ``n`` smallest distinct ids."""
    return ratings.select(column).distinct().orderBy(column).limit(n)


def _top_lists(model: ALSModel, recommended: str, k: int, only: DataFrame | None) -> DataFrame:
    """The table that ``recommendForAllUsers`` and its like give, by blocks of both sides.

    Spark's own lists multiply all blocks and put every score into a queue; here a
    user or item is done when what is left is too short to matter.
    """
    owners, others = factors(model, "users"), factors(model, "items")
    owner, other = USER, ITEM
    if recommended == "users":
        owners, others, owner, other = others, owners, ITEM, USER
    if only is not None:
        owners = owners.join(only.select(F.col(owner).cast("long").alias("item")), "item", "left_semi")
    found = pruned_matches(owners, others, k)
    entry = F.struct(F.col("rank"), F.col("item").cast("int").alias(other), F.col("score").cast("float").alias("rating"))
    listed = found.groupBy("query").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    plain = F.transform("entries", lambda e: F.struct(e[other].alias(other), e["rating"].alias("rating")))
    return listed.select(F.col("query").cast("int").alias(owner), plain.alias("recommendations"))


def recommend_items(model: ALSModel, k: int = TOP_K, users: DataFrame | None = None) -> DataFrame:
    """Top items per user, for all users or those given."""
    return _top_lists(model, "items", k, users)


def recommend_users(model: ALSModel, k: int = TOP_K, items: DataFrame | None = None) -> DataFrame:
    """Top users per item, for all items or those given."""
    return _top_lists(model, "users", k, items)


def ranked(recommendations: DataFrame) -> DataFrame:
    """Recommendations as one row per entry: ``(id, rank, recommended, score)``."""
    owner = recommendations.columns[0]
    entry = F.posexplode("recommendations").alias("position", "entry")
    return recommendations.select(F.col(owner).alias("id"), entry).select(
        "id",
        (F.col("position") + 1).alias("rank"),
        F.col("entry").getField(ITEM if owner == USER else USER).alias("recommended"),
        F.col("entry.rating").alias("score"),
    )


def pruned_lists(model: ALSModel, recommended: str = "items", k: int = TOP_K) -> DataFrame:
    """The lists of ``ranked`` for all users (of items) or all items (of users), without scoring every pair.

    ``scored`` is how many factors were compared for the list's owner. Scores are doubles.
    """
    owners, others = factors(model, "users"), factors(model, "items")
    if recommended == "users":
        owners, others = others, owners
    found = pruned_matches(owners, others, k)
    return found.select(F.col("query").alias("id"), "rank", F.col("item").alias("recommended"), "score", "scored")


def cross_validate(
    ratings: DataFrame,
    keys: list[str],
    *,
    folds: int = FOLDS,
    grid: Sequence[dict] = ({},),
    at_once: int = MODELS_AT_ONCE,
    **als_options,
) -> DataFrame:
    """Error of ALS on each of ``folds`` held-out parts: ``(setting, fold, rmse)``.

    ``setting`` is the place in ``grid``, whose members are options of
    ``fit_als``. ``keys`` identify a row and decide its fold by hash. A fold
    drawn with ``rand`` could change between the jobs of one fit when a lost
    task is redone in another row order.
    """
    # Only what the models read is kept.
    fold = (draw(*[F.col(k) for k in keys]) % folds).cast("int").alias("__fold")
    folded = ratings.select(USER, ITEM, RATING, fold).persist(StorageLevel.MEMORY_AND_DISK)

    def error(setting: int, fold: int) -> tuple[int, int, float]:
        model = fit_als(folded.where(F.col("__fold") != fold), **{**als_options, **grid[setting]})
        return setting, fold, float(rmse(model.transform(folded.where(F.col("__fold") == fold))))

    fit = inheritable_thread_target(ratings.sparkSession)(error)
    with ThreadPoolExecutor(at_once) as pool:
        runs = [pool.submit(fit, setting, fold) for setting in range(len(grid)) for fold in range(folds)]
        errors = [run.result() for run in runs]
    folded.unpersist()
    return ratings.sparkSession.createDataFrame(errors, "setting int, fold int, rmse double")


def fit_best(ratings: DataFrame, errors: DataFrame, grid: Sequence[dict], **als_options) -> ALSModel:
    """ALS on all rows with the setting whose mean error is the least, the first one among equals."""
    means = errors.groupBy("setting").agg(F.avg("rmse").alias("error"))
    best = means.orderBy("error", "setting").first()["setting"]
    return fit_als(ratings, **{**als_options, **grid[best]})
