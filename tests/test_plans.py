import pytest

from tastemill.plans import registry as reg


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def initial(text):
    """The part of a plan above cached tables."""
    return text.split("InMemoryRelation")[0]


def test_history_features_take_one_window_and_one_shuffle(spark, folder):
    text = initial(plan(reg.user_window_stats(spark, folder)))
    assert text.count("Window [") == 1 and text.count("Exchange hashpartitioning") == 1


def test_model_samples_take_one_window(spark, folder):
    text = initial(plan(reg.line_samples(spark, folder)))
    assert text.count("Window [") == 1 and text.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize(
    "name",
    ["model_samples", "item_snapshot", "user_sequences", "item_pairs", "multi_hot", "user_vectors", "random_walks",
     "similar_vectors_batch", "stored_vectors_topk"],
)
def test_no_python_in_plans(spark, folder, name):
    text = plan(reg.QUERIES[name](spark, folder))
    assert "Python" not in text and "ArrowEval" not in text and "CartesianProduct" not in text


def test_snapshots_prune_before_the_shuffle(spark, folder):
    text = plan(reg.item_snapshot(spark, folder))
    assert text.count("WindowGroupLimit") >= 2 and "Partial" in text


def test_scans_read_only_needed_columns(spark, folder):
    text = plan(reg.item_rating_stats(spark, folder))
    assert "l_comment" not in text and "l_extendedprice" not in text and "l_shipdate" not in text


def test_positive_filter_is_applied_at_the_scan(spark, folder):
    text = plan(reg.item_pairs(spark, folder))
    assert "PushedFilters" in text


def test_model_samples_carry_genres_once(spark, folder):
    text = initial(plan(reg.line_samples(spark, folder)))
    below = text.split("Exchange hashpartitioning")[1]
    assert "movieGenre1" not in below


def test_dot_crosses_shuffle_no_item_or_genre_vectors(spark, folder, monkeypatch):
    from tastemill.operators import embeddings as emb

    keys = []
    attach = emb.attach_vectors
    monkeypatch.setattr(emb, "attach_vectors", lambda df, v, key, *rest, **more: keys.append(key) or attach(df, v, key, *rest, **more))
    reg.dot_crosses(spark, folder)
    assert keys[0] == "userId"


def test_counting_users_joins_no_items(spark, folder, monkeypatch):
    from tastemill.operators import skew

    seen = []
    counted = skew.hot_keys
    monkeypatch.setattr(skew, "hot_keys", lambda df, *rest: seen.append(plan(df)) or counted(df, *rest))
    for name in ("user_window_stats", "user_genre_prefs", "warm_rows"):
        reg.QUERIES[name](spark, folder)
    assert len(seen) == 3 and not any("InMemoryTableScan" in text for text in seen)
