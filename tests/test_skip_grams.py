"""Item vectors trained in shards."""

import numpy as np
import pytest

from tastemill.operators import embeddings as emb
from tastemill.operators import skip_grams

GROUPS, MEMBERS = 12, 15


@pytest.fixture(scope="module")
def sequences(spark):
    """Most items of a sequence are of one group; item 999 occurs three times, and one item is null."""
    draw = np.random.default_rng(3)
    rows = []
    for user in range(900):
        group, n = draw.integers(GROUPS), draw.integers(2, 14)
        own = group * MEMBERS + draw.integers(MEMBERS, size=n)
        rows.append((user, 0, [int(x) for x in np.where(draw.random(n) < 0.85, own, draw.integers(GROUPS * MEMBERS, size=n))]))
    rows += [(900 + i, 0, [999]) for i in range(3)] + [(910 + i, 0, [None, 1]) for i in range(6)] + [(920, 0, [])]
    return spark.createDataFrame(rows, "userId long, segment int, movieIds array<long>").persist()


def vectors(model):
    return {r.item: r.vector for r in emb.model_vectors(model).collect()}


@pytest.mark.parametrize("options", [{}, {"shard_items": 20}, {"chunk_words": 2_000}])
def test_members_of_a_group_have_like_vectors(sequences, options):
    settings = dict(size=8, window=5, iterations=10, seed=1, least=5)
    found = vectors(skip_grams.fit_skip_grams(sequences, "movieIds", **settings, **options))
    assert found.keys() == {None, *range(GROUPS * MEMBERS)}
    known = np.array([found[i] for i in range(GROUPS * MEMBERS)])
    known /= np.linalg.norm(known, axis=1, keepdims=True)
    like = known @ known.T
    np.fill_diagonal(like, -2)
    group = np.arange(GROUPS * MEMBERS) // MEMBERS
    near = np.argsort(-like, axis=1)[:, :5]
    assert (group[near] == group[:, None]).mean() > 0.9
    if options:
        return
    again = vectors(skip_grams.fit_skip_grams(sequences.repartition(3), "movieIds", **settings))
    assert again == found


def test_many_items_are_trained_in_shards(sequences):
    model = emb.fit_item2vec(sequences, iterations=2, driver_items=50)
    assert isinstance(model, skip_grams.ItemVectors)
    assert set(vectors(model)) == {None, *range(GROUPS * MEMBERS)}
    found = emb.synonyms(model, 1, 7).collect()
    assert len(found) == 7 and "1" not in {r.item for r in found}
    few = emb.fit_item2vec(sequences.where("userId < 900"), iterations=2, partitions=1)
    assert not isinstance(few, skip_grams.ItemVectors)


def test_each_centre_draws_its_window():
    draw = np.random.default_rng(0)
    codes, lengths = np.arange(40_000), np.full(2_000, 20, np.int32)
    a, b = skip_grams.near_pairs(codes, lengths, 5, draw)
    assert (a // 20 == b // 20).all() and (a != b).all() and abs(a - b).max() == 5
    counts = np.bincount(abs(a - b))[1:]
    # A neighbour d places away is met by windows of d places or more.
    expected = np.array([2 * 2_000 * (20 - d) * (6 - d) / 5 for d in range(1, 6)])
    assert (abs(counts / expected - 1) < 0.05).all()
    assert len(skip_grams.near_pairs(codes[:1], lengths[:1] * 0 + 1, 5, draw)[0]) == 0
