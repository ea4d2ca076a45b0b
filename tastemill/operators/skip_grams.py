"""Training of item vectors by skip-grams, with nothing on the driver that grows with the items.

Spark's Word2Vec keeps every word, its code and its vectors on the driver and in every task.
Here items are dealt into shards. A task holds the vectors of one shard as centres and those of one shard as contexts,
and goes through the pairs of items near each other that fall on both; in as many turns as there are shards every
shard of centres meets every shard of contexts, which are in no other task meanwhile. Pairs are
told from drawn items of the same shard (negative sampling), windows are drawn anew at each iteration,
and steps are scaled by an item's squared gradients so far (AdaGrad). All draws come from seeds, so the
same data gives the same vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemill.operators.skew import HOT_ROWS, lookup_join
from tastemill.session import delete_path, ensure_checkpoint_dir

# Items of one shard, whose vectors a task holds twice.
SHARD_ITEMS = 400_000
# Words whose pairs are made, shuffled and trained on together.
CHUNK_WORDS = 32_000_000
# Pairs that a task collects before it hands them on, and those of one step.
PAIRS_AT_ONCE = 1 << 21
STEP_PAIRS = 8_192
# Drawn items for each pair, and pairs that share as many of them as they are.
NEGATIVES, SHARING = 5, 16
RATE = 0.1
# Frequent items are drawn as contexts less often than they occur.
FLATTENED = 0.75


@dataclass(frozen=True)
class ItemVectors:
    """Trained vectors as ``(word, vector)``, as a ``Word2VecModel`` gives them."""

    table: DataFrame

    def getVectors(self) -> DataFrame:  # noqa: N802
        return self.table.select("word", array_to_vector("vector").alias("vector"))


def _same(key: int) -> int:
    return key


def near_pairs(codes: np.ndarray, lengths: np.ndarray, window: int, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Centres and contexts of sequences laid end to end; each centre draws how far its window reaches."""
    of = np.repeat(np.arange(len(lengths)), lengths)
    reach = random.integers(1, window + 1, len(codes))
    found = []
    for d in range(1, min(window, len(codes) - 1) + 1):
        near = of[d:] == of[:-d]
        ahead, back = np.flatnonzero(near & (reach[:-d] >= d)), np.flatnonzero(near & (reach[d:] >= d))
        found += [(codes[ahead], codes[ahead + d]), (codes[back + d], codes[back])]
    if not found:
        return codes[:0], codes[:0]
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _add(table: np.ndarray, squares: np.ndarray, rows: np.ndarray, slopes: np.ndarray) -> None:
    """One AdaGrad step for each of the rows, which may repeat."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    rows, sums = rows[first], np.add.reduceat(slopes[order], first, axis=0)
    squares[rows] += (sums * sums).mean(1)
    table[rows] += sums * (RATE / np.sqrt(squares[rows] + 1e-10))[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def train_pairs(
    centres: np.ndarray,
    contexts: np.ndarray,
    squares: tuple[np.ndarray, np.ndarray],
    pairs: tuple[np.ndarray, np.ndarray],
    weights: np.ndarray,
    random: np.random.Generator,
    step: int = STEP_PAIRS,
) -> None:
    """Go once through the pairs, in a drawn order, and move the vectors in place."""
    n, size = len(pairs[0]), centres.shape[1]
    order = random.permutation(n)
    upto = np.cumsum(weights, dtype=np.float64)
    for at in range(0, n, step):
        here = order[at : at + step]
        a, b = pairs[0][here], pairs[1][here]
        drawn = np.searchsorted(upto, random.random(-(-len(a) // SHARING) * SHARING) * upto[-1], "right")
        drawn = np.minimum(drawn, len(contexts) - 1)
        x, y, z = centres[a], contexts[b], contexts[drawn].reshape(-1, SHARING, size)
        wrong = (1 - _sigmoid((x * y).sum(1)))[:, None]
        grouped = np.zeros((z.shape[0] * SHARING, size), np.float32)
        grouped[: len(a)] = x
        grouped = grouped.reshape(z.shape)
        odds = _sigmoid(grouped @ z.transpose(0, 2, 1)) * np.float32(-NEGATIVES / SHARING)
        odds.reshape(-1, SHARING)[len(a) :] = 0
        away = (odds @ z).reshape(-1, size)[: len(a)]
        push = (odds.transpose(0, 2, 1) @ grouped).reshape(-1, size)
        _add(centres, squares[0], a, wrong * y + away)
        _add(contexts, squares[1], np.concatenate([b, drawn]), np.concatenate([wrong * x, push]))


def _numbered(sequences: DataFrame, items: str, least: int, shard_items: int, hot_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """Vocabulary ``(item, n, shard, place)``, sequences as ``words`` of codes (place times shards, plus shard), shards."""
    ids = [c for c in sequences.columns if c != items]
    # A key that is never null, as null items are words too.
    placed = sequences.select(*ids, F.posexplode(items).alias("__at", "__item")).withColumn("__key", F.struct("__item"))
    counts = placed.groupBy("__key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).persist(StorageLevel.MEMORY_AND_DISK)
    spark = sequences.sparkSession
    shards = max(1, spark.sparkContext.defaultParallelism, -(-counts.count() // shard_items))
    shard = F.pmod(F.xxhash64("__key"), F.lit(shards)).cast("int")
    by_key = Window.partitionBy("shard").orderBy("__key")
    vocabulary = counts.withColumn("shard", shard).withColumn("place", F.row_number().over(by_key) - 1).checkpoint()
    counts.unpersist()
    codes = vocabulary.select("__key", (F.col("place").cast("long") * shards + F.col("shard")).alias("__code"), F.col("n").alias("__n"))
    coded = lookup_join(placed.select(*ids, "__at", "__key"), codes, "__key", "inner", hot_rows=hot_rows, counted="__n")
    listed = coded.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("__at", "__code"))).alias("words"))
    return vocabulary, listed.select(*ids, F.col("words.__code").alias("words")), shards


def _packed(listed: DataFrame) -> RDD:
    """Codes and lengths of the sequences as bytes, in the order of their ids in as many parts as the session shuffles into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            codes, lengths = words.flatten().to_numpy(), pa.compute.list_value_length(words).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([codes.tobytes()]), pa.array([lengths.astype(np.int32).tobytes()])], ["codes", "lengths"])

    ids = [c for c in listed.columns if c != "words"]
    parts = max(int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions")), listed.sparkSession.sparkContext.defaultParallelism)
    ordered = listed.repartition(parts, *ids).sortWithinPartitions(*ids).select("words")
    return ordered.mapInArrow(run, "codes binary, lengths binary").rdd.map(lambda r: (bytes(r[0]), bytes(r[1])))


def _started(vocabulary: DataFrame, size: int, seed: int) -> RDD:
    """``(shard, (side, shard, vectors, squares, weights))`` for both sides of each shard, before training."""

    def run(table: pa.Table) -> pa.Table:
        shard, n = table.column("shard")[0].as_py(), np.empty(table.num_rows, np.float32)
        n[table.column("place").to_numpy()] = table.column("n").to_numpy()
        return pa.table({"shard": pa.array([shard], pa.int32()), "weights": pa.array([(n**FLATTENED).tobytes()])})

    def both(row: tuple) -> Iterator[tuple]:
        shard, weights = row[0], bytes(row[1])
        n = len(weights) // 4
        centres = (np.random.default_rng([seed, shard]).random((n, size), np.float32) - 0.5) / size
        zeros = np.zeros(n, np.float32).tobytes()
        yield shard, (0, shard, centres.tobytes(), zeros, b"")
        yield shard, (1, shard, np.zeros((n, size), np.float32).tobytes(), zeros, weights)

    weighed = vocabulary.groupBy("shard").applyInArrow(run, "shard int, weights binary")
    return weighed.select("shard", "weights").rdd.flatMap(both)


def fit_skip_grams(
    sequences: DataFrame,
    items: str,
    *,
    size: int,
    window: int,
    iterations: int,
    seed: int,
    least: int,
    shard_items: int = SHARD_ITEMS,
    chunk_words: int = CHUNK_WORDS,
    hot_rows: int = HOT_ROWS,
) -> ItemVectors:
    """Vectors of the items that occur at least ``least`` times in the sequences, which their other columns identify."""
    spark = sequences.sparkSession
    ensure_checkpoint_dir(spark)
    vocabulary, listed, shards = _numbered(sequences, items, least, shard_items, hot_rows)
    words = vocabulary.agg(F.sum("n")).first()[0] or 0
    chunks = max(1, -(-words // chunk_words))
    packed = _packed(listed).persist(StorageLevel.MEMORY_AND_DISK)

    def paired(turn: int, chunk: int):
        def run(part: int, blocks: Iterator[tuple]) -> Iterator[tuple]:
            random, held, count, told = np.random.default_rng([seed, turn, part]), [], 0, 0

            def dealt() -> Iterator[tuple]:
                a, b = (np.concatenate([h[k] for h in held]) for k in (0, 1))
                own, other = a % shards, b % shards
                key = own * shards + (other - own) % shards
                order = np.argsort(key, kind="stable")
                a, b, key = (a[order] // shards).astype(np.uint32), (b[order] // shards).astype(np.uint32), key[order]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                for start, end in zip(first, np.append(first[1:], len(key))):
                    i, r = divmod(int(key[start]), shards)
                    yield i, (2, r, (part, told), a[start:end].tobytes(), b[start:end].tobytes())

            for number, (codes, lengths) in enumerate(blocks):
                if (part + number) % chunks != chunk:
                    continue
                made = near_pairs(np.frombuffer(codes, np.int64), np.frombuffer(lengths, np.int32), window, random)
                held.append(made)
                count += len(made[0])
                if count >= PAIRS_AT_ONCE:
                    yield from dealt()
                    held, count, told = [], 0, told + 1
            if count:
                yield from dealt()

        return run

    def trained(turn: int, r: int):
        def run(rows: Iterator[tuple]) -> Iterator[tuple]:
            sides, pairs = {}, []
            for key, row in rows:
                if row[0] < 2:
                    sides[row[0]] = (key, *row)
                elif row[1] == r:
                    pairs.append(row[2:])
            # A shard without items has no rows.
            if len(sides) == 2 and pairs:
                pairs.sort(key=lambda p: p[0])
                i, own = sides[0][0], sides[0][2]
                centres, contexts = (np.frombuffer(sides[k][3], np.float32).reshape(-1, size).copy() for k in (0, 1))
                squares = tuple(np.frombuffer(sides[k][4], np.float32).copy() for k in (0, 1))
                near = tuple(np.concatenate([np.frombuffer(p[k], np.uint32) for p in pairs]).astype(np.int64) for k in (1, 2))
                random = np.random.default_rng([seed, turn, r, own])
                step = min(STEP_PAIRS, max(256, min(len(centres), len(contexts)) // 4))
                train_pairs(centres, contexts, squares, near, np.frombuffer(sides[1][5], np.float32), random, step)
                made = {0: centres, 1: contexts}
                sides = {k: (i, k, sides[k][2], made[k].tobytes(), squares[k].tobytes(), sides[k][5]) for k in (0, 1)}
            for key, *row in sides.values():
                # In the next turn the task of a shard of centres meets the next shard of contexts.
                shard = row[1]
                yield (shard if row[0] == 0 else (shard - r - 1) % shards), tuple(row)

        return run

    state, last = _started(vocabulary, size, seed), None
    for turn in range(iterations * chunks):
        pairs = packed.mapPartitionsWithIndex(paired(turn, turn % chunks)).partitionBy(shards, _same)
        for r in range(shards):
            moved = state.partitionBy(shards, _same)
            state = moved.union(pairs).mapPartitions(trained(turn, r))
        state = state.persist(StorageLevel.MEMORY_AND_DISK)
        state.checkpoint()
        state.count()
        # All that led here can go.
        moved._jrdd.rdd().cleanShuffleDependencies(True)
        pairs._jrdd.rdd().cleanShuffleDependencies(True)
        if last is not None:
            last.unpersist()
            delete_path(spark, last.getCheckpointFile())
        last = state

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data in zip(*(c.to_pylist() for c in batch.columns)):
                values = np.frombuffer(data, np.float32)
                n = len(values) // size
                vectors = pa.ListArray.from_arrays(np.arange(0, n * size + 1, size, dtype=np.int32), values.astype(np.float64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(n, dtype=np.int32)), vectors], ["shard", "place", "vector"])

    kept = state.filter(lambda row: row[1][0] == 0).map(lambda row: (row[1][1], bytearray(row[1][2])))
    vectors = spark.createDataFrame(kept, "shard int, data binary").mapInArrow(unpacked, "shard int, place int, vector array<double>")
    found = vectors.join(vocabulary, ["shard", "place"]).select(F.col("__key.__item").cast("string").alias("word"), "vector").checkpoint()
    state.unpersist()
    if last is not None:
        delete_path(spark, last.getCheckpointFile())
    packed.unpersist()
    return ItemVectors(found)
