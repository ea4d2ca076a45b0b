"""Click-through models on model samples, trained with Spark ML.

Embedding columns are pre-trained: item and user vectors come from item2vec or
ALS and enter the models as dense features.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import FMClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import FeatureHasher, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.operators.ctr_features import (
    CROSS_BUCKETS,
    GENRE_COLUMNS,
    GENRES,
    ITEM_GENRES,
    ITEM_NUMBERS,
    NUMBERS,
    USER_GENRES,
    USER_NUMBERS,
    dot_crosses,
    genre_indicators,
    hashed_cross,
    id_indicator,
)
from tastemill.operators.embeddings import attach_vectors
from tastemill.operators.networks import fit_network, packed_rows
from tastemill.operators.pair_factors import fit_pair_factors
from tastemill.operators.samples import split_bucket
from tastemill.operators.towers import TwoTowers, fit_towers, genre_features, with_tower_scores

# Fixed values.
EPOCHS = 8
HIDDEN = [128, 128]
CF_HIDDEN = [64, 64]
FM_FACTORS = 10

# More slots than movie and user ids together, so few ids share one.
FIRST_ORDER_SLOTS = 1 << 18

Prepare = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Vectors:
    """Pre-trained vectors, each table ``(item, vector)``, all of one size."""

    items: DataFrame
    users: DataFrame
    size: int
    genres: DataFrame | None = None


@dataclass(frozen=True)
class CtrModel:
    """Feature preparation and the model fitted on its result."""

    prepare: Prepare
    model: PipelineModel
    probability: str = "probability"

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(self.prepare(rows))

    def score(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """``keys``, ``label``, ``score`` (probability of a like) and ``prediction``."""
        return self.transform(rows).select(
            *keys,
            F.col("label").cast("int").alias("label"),
            _like(self.probability).alias("score"),
            (F.col("prediction") if self.probability == "probability" else _like(self.probability).cast("int"))
            .cast("int")
            .alias("prediction"),
        )


def _like(probability: str):
    return F.get(vector_to_array(probability), F.lit(1))


def _with_item_and_user_vectors(rows: DataFrame, vectors: Vectors) -> DataFrame:
    out = attach_vectors(rows, vectors.items, "movieId", "itemArray", vectors.size)
    out = attach_vectors(out, vectors.users, "userId", "userArray", vectors.size)
    return out.withColumns({"itemVector": array_to_vector("itemArray"), "userVector": array_to_vector("userArray")})


def _fit(prepared: DataFrame, dense: list[str], indicators: list[str], estimator) -> PipelineModel:
    """Scale the dense inputs, append the sparse indicators, fit the estimator."""
    dense_assembler = VectorAssembler(inputCols=dense, outputCol="dense")
    # Read for the scaler, for the width, and by the trainer or to pack them for it.
    rows = dense_assembler.transform(prepared).select("dense", *indicators, "label")
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    rest = Pipeline(
        stages=[
            StandardScaler(inputCol="dense", outputCol="scaled", withMean=True, withStd=True),
            VectorAssembler(inputCols=["scaled", *indicators], outputCol="features"),
        ]
    ).fit(rows)
    features = rest.transform(rows).select("features", "label")
    if isinstance(estimator, MultilayerPerceptronClassifier):
        width = features.first()["features"].size
        estimator = estimator.copy().setLayers([width, *estimator.getLayers(), 2])
        packed = packed_rows(features, width)
        # The packed rows are all that training reads.
        rows.unpersist()
        model = fit_network(packed, estimator)
        packed.release()
    else:
        model = estimator.fit(features)
        rows.unpersist()
    return PipelineModel(stages=[dense_assembler, *rest.stages, model])


def _network(hidden: list[int], epochs: int, seed: int, probability: str = "probability"):
    # The layers before fitting are the hidden ones; the input width is not known yet.
    return MultilayerPerceptronClassifier(
        layers=hidden,
        maxIter=epochs,
        seed=seed,
        probabilityCol=probability,
        rawPredictionCol=f"{probability}Raw",
        predictionCol="prediction" if probability == "probability" else f"{probability}Class",
    )


def fit_ctr_mlp(
    train: DataFrame,
    vectors: Vectors,
    vocabulary: list[str] = GENRES,
    *,
    epochs: int = EPOCHS,
    seed: int = 42,
    probability: str = "probability",
) -> CtrModel:
    """Genres, item and user vectors and nine numbers into a 128-128 network."""

    def prepare(rows: DataFrame) -> DataFrame:
        return genre_indicators(_with_item_and_user_vectors(rows, vectors), GENRE_COLUMNS, vocabulary)

    dense, indicators = ["itemVector", "userVector", *NUMBERS], [f"{c}IndexVec" for c in GENRE_COLUMNS]
    model = _fit(prepare(train), dense, indicators, _network(HIDDEN, epochs, seed, probability))
    return CtrModel(prepare, model, probability)


def fit_neural_cf(train: DataFrame, vectors: Vectors, *, epochs: int = EPOCHS, seed: int = 42) -> CtrModel:
    """Only the item and the user vector into a 64-64 network."""

    def prepare(rows: DataFrame) -> DataFrame:
        return _with_item_and_user_vectors(rows, vectors)

    model = _fit(prepare(train), ["itemVector", "userVector"], [], _network(CF_HIDDEN, epochs, seed))
    return CtrModel(prepare, model)


def fit_wide_deep(
    train: DataFrame,
    vectors: Vectors,
    keys: list[str],
    vocabulary: list[str] = GENRES,
    *,
    epochs: int = EPOCHS,
    seed: int = 42,
    cross_buckets: int = CROSS_BUCKETS,
    blend_percent: int = 20,
) -> CtrModel:
    """A linear model on crossed ids beside the 128-128 network.

    The wide part sees the hashed cross of an item with the item liked last.
    Both parts are trained on most of the training rows; the rest, picked by a
    hash of ``keys`` and seen by neither, weighs their scores against each other.
    """
    held = split_bucket([*keys, "label"]) < blend_percent
    own_rows, blend_rows = train.where(~held), train.where(held)

    deep = fit_ctr_mlp(own_rows, vectors, vocabulary, epochs=epochs, seed=seed, probability="deep")

    def crossed(rows: DataFrame) -> DataFrame:
        cross = rows.withColumn("cross", hashed_cross(["movieId", "userRatedMovie1"], cross_buckets))
        return id_indicator(cross, "cross", cross_buckets)

    wide = LogisticRegression(
        featuresCol="crossVec",
        labelCol="label",
        maxIter=epochs,
        regParam=0.01,
        probabilityCol="wide",
        rawPredictionCol="wideRaw",
        predictionCol="wideClass",
    ).fit(crossed(own_rows))

    def prepare(rows: DataFrame) -> DataFrame:
        both = wide.transform(crossed(deep.transform(rows).drop("features")))
        return both.withColumns({"wideScore": _like("wide"), "deepScore": _like("deep")})

    blend = Pipeline(
        stages=[
            VectorAssembler(inputCols=["wideScore", "deepScore"], outputCol="features"),
            LogisticRegression(featuresCol="features", labelCol="label"),
        ]
    ).fit(prepare(blend_rows))
    return CtrModel(prepare, blend)


def fit_deep_fm(
    train: DataFrame,
    vectors: Vectors,
    keys: list[str],
    vocabulary: list[str] = GENRES,
    *,
    first_order_slots: int = FIRST_ORDER_SLOTS,
    epochs: int = EPOCHS,
    seed: int = 42,
    blend_percent: int = 20,
) -> CtrModel:
    """First-order indicators, dot crosses and a deep part into one output layer.

    First-order terms of ids and genres are hashed into ``first_order_slots``,
    so their number does not grow with that of the ids. They are fitted with the
    other parts below the output layer, and the output layer, fitted as in
    ``fit_wide_deep`` on rows that those parts have not seen, has such terms of
    its own: no training row is without a say in the weights of its ids. A
    factorization machine adds pairwise terms of genres, crosses and numbers, and
    ``fit_pair_factors`` those of ids, each with a vector of its own.
    """
    if vectors.genres is None:
        raise ValueError("dot crosses need genre vectors")
    held = split_bucket([*keys, "label"]) < blend_percent
    own_rows, blend_rows = train.where(~held), train.where(held)
    genres = [ITEM_GENRES[0], USER_GENRES[0]]
    genre_slots = [f"{c}IndexVec" for c in genres]
    crosses = dot_crosses("itemArray", "userArray", "itemGenreArray", "userGenreArray")

    def crossed(rows: DataFrame) -> DataFrame:
        out = genre_indicators(_with_item_and_user_vectors(rows, vectors), GENRE_COLUMNS, vocabulary)
        out = attach_vectors(out, vectors.genres, genres[0], "itemGenreArray", vectors.size)
        out = attach_vectors(out, vectors.genres, genres[1], "userGenreArray", vectors.size).withColumns(crosses)
        return out

    ids = ["movieId", "userId"]
    own = crossed(own_rows).persist(StorageLevel.MEMORY_AND_DISK)
    machine = FMClassifier(
        factorSize=FM_FACTORS,
        maxIter=epochs,
        stepSize=0.01,
        seed=seed,
        probabilityCol="pairs",
        rawPredictionCol="pairsRaw",
        predictionCol="pairsClass",
    )
    pair_model = _fit(own, [*crosses, *NUMBERS], genre_slots, machine)
    id_model = fit_pair_factors(own, ids, rounds=epochs, seed=seed)
    first_order = Pipeline(
        stages=[
            FeatureHasher(
                inputCols=[*ids, *genres], categoricalCols=ids, outputCol="features", numFeatures=first_order_slots
            ),
            LogisticRegression(
                featuresCol="features",
                labelCol="label",
                maxIter=epochs,
                regParam=0.01,
                probabilityCol="first",
                rawPredictionCol="firstRaw",
                predictionCol="firstClass",
            ),
        ]
    ).fit(own)
    deep_inputs = ["itemVector", "userVector", *NUMBERS], [f"{c}IndexVec" for c in GENRE_COLUMNS]
    deep_model = _fit(own, *deep_inputs, _network(HIDDEN, epochs, seed, "deep"))
    own.unpersist()

    def prepare(rows: DataFrame) -> DataFrame:
        out = pair_model.transform(crossed(rows)).drop("dense", "scaled", "features")
        out = deep_model.transform(out).drop("dense", "scaled", "features")
        out = first_order.transform(out).drop("features")
        return id_model.score(out.withColumns({f"{part}Score": _like(part) for part in parts}), "idsScore")

    parts = ["first", "pairs", "deep"]
    output = Pipeline(
        stages=[
            FeatureHasher(
                inputCols=[*ids, *genres, *crosses, *[f"{part}Score" for part in [*parts, "ids"]]],
                categoricalCols=ids,
                outputCol="features",
                numFeatures=first_order_slots,
            ),
            LogisticRegression(featuresCol="features", labelCol="label", maxIter=epochs, regParam=0.01),
        ]
    ).fit(prepare(blend_rows))
    return CtrModel(prepare, output)


@dataclass(frozen=True)
class TowerModel:
    """Two towers and what enters them; ``prepare`` adds the vectors to rows."""

    prepare: Prepare
    towers: TwoTowers
    item_inputs: list[str | Column]
    user_inputs: list[str | Column]

    def score(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """``keys``, ``label``, ``score`` (between 0 and 1) and ``prediction``."""
        scored = with_tower_scores(self.prepare(rows), self.towers, [*keys, "label"], self.item_inputs, self.user_inputs)
        score = F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))
        return scored.select(*keys, F.col("label").cast("int").alias("label"), score.alias("score"), (score > 0.5).cast("int").alias("prediction"))

    def item_vectors(self, items: DataFrame) -> DataFrame:
        """``(item, vector)`` for rows with ``movieId``, ``itemArray`` and the features of an item snapshot."""
        return self.towers.items.vectors(items, "movieId", self.item_inputs)

    def user_vectors(self, users: DataFrame) -> DataFrame:
        """``(item, vector)`` for rows with ``userId``, ``userArray`` and the features of a user snapshot."""
        return self.towers.users.vectors(users, "userId", self.user_inputs)


def tower_inputs(side: str, size: int, vocabulary: list[str]) -> list[str | Column]:
    """What enters the ``item`` or the ``user`` tower: numbers, genres and the pre-trained vector."""
    numbers, genres, vector = (ITEM_NUMBERS, ITEM_GENRES, "itemArray") if side == "item" else (USER_NUMBERS, USER_GENRES, "userArray")
    return [*numbers, *genre_features(genres, vocabulary), *[F.col(vector)[i] for i in range(size)]]


def fit_two_tower(train: DataFrame, vectors: Vectors, vocabulary: list[str] = GENRES, *, seed: int = 42) -> TowerModel:
    """Item side and user side in towers of their own, joined by a dot product."""

    def prepare(rows: DataFrame) -> DataFrame:
        out = attach_vectors(rows, vectors.items, "movieId", "itemArray", vectors.size)
        return attach_vectors(out, vectors.users, "userId", "userArray", vectors.size)

    inputs = [tower_inputs(side, vectors.size, vocabulary) for side in ("item", "user")]
    towers = fit_towers(prepare(train), *inputs, seed=seed)
    if towers is None:
        raise ValueError("two towers need training rows with a label")
    return TowerModel(prepare, towers, *inputs)


def evaluate(scored: DataFrame) -> dict[str, float]:
    """Log loss and accuracy of scored rows."""
    rows = scored.select(
        F.col("label").cast("double").alias("label"),
        F.col("prediction").cast("double").alias("prediction"),
        array_to_vector(F.array(1 - F.col("score"), F.col("score"))).alias("probability"),
    )
    loss = MulticlassClassificationEvaluator(metricName="logLoss", probabilityCol="probability")
    accuracy = MulticlassClassificationEvaluator(metricName="accuracy")
    return {"loss": loss.evaluate(rows), "accuracy": accuracy.evaluate(rows)}


def evaluation_table(scored: DataFrame, epsilon: float = 1e-15) -> DataFrame:
    """The same two numbers as a one-row table."""
    right = F.when(F.col("label") == 1, F.col("score")).otherwise(1 - F.col("score"))
    clipped = F.least(F.greatest(right, F.lit(epsilon)), F.lit(1 - epsilon))
    hit = F.when(F.col("label") == F.col("prediction"), 1.0).otherwise(0.0)
    return scored.agg(F.avg(-F.log(clipped)).alias("loss"), F.avg(hit).alias("accuracy"))
