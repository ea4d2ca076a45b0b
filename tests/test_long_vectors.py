"""Lists that are put together from several pieces of the vectors."""

import numpy as np
import pyarrow as pa

from tastemill.operators import neighbours

SCHEMA = "item long, vector array<double>"


def test_the_longest_vectors_bound_each_list():
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(900, 6)) * 2.0 ** rng.integers(-3, 3, 900)[:, None]
    queries = np.vstack([rng.normal(size=(200, 6)), np.zeros((1, 6)), np.full((1, 6), np.nan)])
    longest = vectors[np.argsort(-(vectors**2).sum(1))[:100]]
    long = pa.table({"vector": pa.array(longest.tolist(), pa.list_(pa.float64()))})
    least = neighbours._floor(queries, long, 7)
    best = np.sort(queries[:201] @ vectors.T, axis=1)[:, -7]
    assert (least[:201] <= best).all() and least[201] == -np.inf
    # Most of what is short stays below it.
    assert ((queries[:200] @ vectors.T) >= least[:200, None]).sum() < 200 * 40
    assert (neighbours._floor(queries, long.slice(0, 3), 7) == -np.inf).all()


def test_pieces_give_the_lists_of_the_whole(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (v * 1.5 ** (i % 9)).tolist()) for i, v in enumerate(rng.normal(size=(500, 5)))]
    # Copies of one vector, vectors of another length, and one without numbers.
    rows += [(500 + i, rows[8][1]) for i in range(9)] + [(600 + i, [1.0, float(i)]) for i in range(12)] + [(700, [float("nan")] * 5)]
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(4)
    asked = vectors.where("item % 3 = 0")
    lists = lambda **options: {
        (r.query, r["rank"]): r.item for r in neighbours.best_matches(asked, vectors, 6, **options).collect()
    }
    whole = lists()
    assert lists(pass_bytes=3_000) == whole and len({q for q, _ in whole}) == asked.count()
