"""The same queries in ANSI SQL, for checking results on another engine."""

from __future__ import annotations

from tastemill.plans.registry import PART_GENRES, QUERY_ITEM, QUERY_STEP, STORED_VECTOR_SIZE, WALKS_PER_ITEM

LINE_ORDER = "timestamp, orderKey, lineNumber, movieId, suppKey, quantity, price"
KEYS = "orderKey, lineNumber, movieId, suppKey"

RATINGS = """
r AS (
  SELECT o_custkey AS userId, l_partkey AS movieId, ceil(l_quantity / 5) / 2.0 AS rating,
         epoch(l_shipdate)::BIGINT AS timestamp, l_orderkey AS orderKey, l_linenumber AS lineNumber,
         l_suppkey AS suppKey, l_quantity AS quantity, l_extendedprice AS price,
         CASE WHEN ceil(l_quantity / 5) / 2.0 >= 3.5 THEN 1 ELSE 0 END AS label
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""

EVENTS = """
e AS (
  SELECT user_id AS userId, json_extract_string(props, '$.k')::BIGINT AS movieId,
         least(10, 1 + floor(value / 8)) / 2.0 AS rating, epoch_us(ts) AS timestamp, event_id AS eventId
  FROM events
)"""

ITEMS = r"""
items AS (
  SELECT p_partkey AS movieId, p_name || ' (' || (1970 + p_size) || ')' AS title,
         p_type || '|' || replace(p_name, ' ', '|') AS genres
  FROM part
),
item_info AS (
  SELECT movieId, title, genres,
         coalesce(try_cast(nullif(regexp_extract(title, '\(([0-9]{4})\)$', 1), '') AS INTEGER), 1990) AS releaseYear,
         string_split(genres, '|')[1] AS movieGenre1, string_split(genres, '|')[2] AS movieGenre2,
         string_split(genres, '|')[3] AS movieGenre3
  FROM items
)"""

STATS = """
stats AS (
  SELECT movieId, count(*) AS movieRatingCount, printf('%.2f', coalesce(avg(rating), 0))::DOUBLE AS movieAvgRating,
         printf('%.2f', coalesce(stddev_samp(rating), 0))::DOUBLE AS movieRatingStddev
  FROM r GROUP BY movieId
)"""

STATS_BEFORE = f"""
stats_before AS (
  SELECT *, count(*) OVER w AS movieRatingCount, printf('%.2f', coalesce(avg(rating) OVER w, 0))::DOUBLE AS movieAvgRating,
         printf('%.2f', coalesce(stddev_samp(rating) OVER w, 0))::DOUBLE AS movieRatingStddev
  FROM r WINDOW w AS (PARTITION BY movieId ORDER BY {LINE_ORDER}, userId ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)"""

FEATURED = """
featured AS (
  SELECT r.*, coalesce(releaseYear, 1990) AS releaseYear, movieGenre1, movieGenre2, movieGenre3, genres,
         movieRatingCount, movieAvgRating, movieRatingStddev,
         row_number() OVER (ORDER BY userId, timestamp, orderKey, lineNumber, r.movieId, suppKey, quantity, price)
           AS rid
  FROM r LEFT JOIN item_info USING (movieId) LEFT JOIN stats USING (movieId)
)"""


COUNT = "count(*) OVER w AS userRatingCount"
LIKED_LIST = "list_reverse(list(movieId) FILTER (WHERE label = 1) OVER w) AS liked"
NUMBERS = f"""{COUNT},
         trunc(coalesce(avg(releaseYear) OVER w, 0))::INTEGER AS userAvgReleaseYear,
         printf('%.2f', coalesce(stddev_samp(releaseYear) OVER w, 0))::DOUBLE AS userReleaseYearStddev,
         printf('%.2f', avg(rating) OVER w)::DOUBLE AS userAvgRating,
         printf('%.2f', coalesce(stddev_samp(rating) OVER w, 0))::DOUBLE AS userRatingStddev"""


def past(*columns: str, rows: int = 100) -> str:
    return f"""
past AS MATERIALIZED (
  SELECT *, {", ".join(columns)} FROM featured
  WINDOW w AS (PARTITION BY userId ORDER BY {LINE_ORDER} ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)
)"""


# A user's rows have consecutive numbers. Genres are numbered in their order, so the five best are the least of one number.
PREFS = """
liked_genres AS MATERIALIZED (
  SELECT userId, rid, unnest(string_split(genres, '|')) AS g FROM past WHERE label = 1
),
codes AS MATERIALIZED (
  SELECT g, row_number() OVER (ORDER BY g) AS code FROM (SELECT DISTINCT g FROM liked_genres WHERE g IS NOT NULL)
),
likes AS MATERIALIZED (SELECT userId, rid, code FROM liked_genres JOIN codes USING (g)),
counted AS (
  SELECT p.rid, e.code, count(*) AS c FROM past p JOIN likes e ON p.userId = e.userId
  WHERE e.rid < p.rid AND e.rid >= p.rid - 100 GROUP BY p.rid, e.code
),
best AS (SELECT rid, min((1000 - c) * 1000000 + code, 5) AS top FROM counted GROUP BY rid),
prefs AS (
  SELECT rid, a.g AS userGenre1, b.g AS userGenre2, c.g AS userGenre3, d.g AS userGenre4, e.g AS userGenre5
  FROM best LEFT JOIN codes a ON a.code = top[1] % 1000000 LEFT JOIN codes b ON b.code = top[2] % 1000000
    LEFT JOIN codes c ON c.code = top[3] % 1000000 LEFT JOIN codes d ON d.code = top[4] % 1000000
    LEFT JOIN codes e ON e.code = top[5] % 1000000
)"""

LIKED = ", ".join(f"liked[{i}] AS userRatedMovie{i}" for i in range(1, 6))
USER_GENRES = ", ".join(f"userGenre{i}" for i in range(1, 6))

SAMPLES = f"""
samples AS (
  SELECT movieId, userId, rating, timestamp, label, releaseYear, movieGenre1, movieGenre2, movieGenre3,
         movieRatingCount, movieAvgRating, movieRatingStddev, {LIKED}, userRatingCount, userAvgReleaseYear,
         userReleaseYearStddev, userAvgRating, userRatingStddev, {USER_GENRES},
         orderKey, lineNumber, suppKey, quantity, price
  FROM past LEFT JOIN prefs USING (rid) WHERE userRatingCount > 1
)"""

SAMPLE_COLUMNS = """movieId, userId, rating, timestamp, label, releaseYear, movieGenre1, movieGenre2, movieGenre3,
  movieRatingCount, movieAvgRating, movieRatingStddev, userRatedMovie1, userRatedMovie2, userRatedMovie3,
  userRatedMovie4, userRatedMovie5, userRatingCount, userAvgReleaseYear, userReleaseYearStddev, userAvgRating,
  userRatingStddev, userGenre1, userGenre2, userGenre3, userGenre4, userGenre5"""


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(parts) + "\n"


UP_TO_FEATURED = (RATINGS, ITEMS, STATS, FEATURED)
UP_TO_SAMPLES = (*UP_TO_FEATURED, past(NUMBERS, LIKED_LIST), PREFS, SAMPLES)
# Samples with fewer columns, where a query needs no more.
WARM = "samples AS (SELECT * FROM past WHERE userRatingCount > 1)"
COUNTED_SAMPLES = (*UP_TO_FEATURED, past(COUNT), WARM)
GENRE_SAMPLES = (
    *UP_TO_FEATURED,
    past(COUNT),
    PREFS,
    "samples AS (SELECT * FROM past LEFT JOIN prefs USING (rid) WHERE userRatingCount > 1)",
)


def draw(key: str) -> str:
    return f"('0x' || substr(md5({key}), 1, 15))::BIGINT"


SPLIT_KEY = "orderKey || ':' || lineNumber || ':' || movieId || ':' || suppKey"
SPLIT = f"CASE WHEN {draw(SPLIT_KEY)} % 100 < 80 THEN 'train' ELSE 'test' END AS split"


def window_stats(rows: int) -> str:
    return (
        with_(*UP_TO_FEATURED, past(NUMBERS, rows=rows))
        + f"SELECT {KEYS}, userId, userRatingCount, userAvgReleaseYear, userReleaseYearStddev, userAvgRating, "
        + "userRatingStddev FROM past"
    )


def steps(source: str, order: str) -> str:
    return f"""
steps AS (
  SELECT movieId AS src, lead(movieId) OVER (PARTITION BY userId ORDER BY {order}) AS dst
  FROM {source} WHERE rating >= 3.5
),
pairs AS (SELECT src, dst, count(*) AS cnt FROM steps WHERE dst IS NOT NULL GROUP BY src, dst)"""


EDGES = """
edges AS (
  SELECT src, dst, cnt, cnt / (sum(cnt) OVER (PARTITION BY src))::DOUBLE AS prob,
         (sum(cnt) OVER w - cnt)::BIGINT AS lo, (sum(cnt) OVER w)::BIGINT AS hi,
         (sum(cnt) OVER (PARTITION BY src))::BIGINT AS total
  FROM pairs WINDOW w AS (PARTITION BY src ORDER BY substr(md5(dst::VARCHAR), 1, 2), dst)
)"""

NODES = """
sources AS (SELECT src AS item, sum(cnt)::BIGINT AS cnt FROM pairs GROUP BY src),
nodes AS (
  SELECT item, cnt, cnt / (sum(cnt) OVER ())::DOUBLE AS prob, (sum(cnt) OVER w - cnt)::BIGINT AS lo,
         (sum(cnt) OVER w)::BIGINT AS hi, (sum(cnt) OVER ())::BIGINT AS total
  FROM sources WINDOW w AS (ORDER BY substr(md5(item::VARCHAR), 1, 3), item)
)"""


def walks_with(ratings: str, source: str, order: str, count: str = "20000") -> str:
    start, onward = draw("walk_id || ':0'"), draw("w.walk_id || ':' || (w.step + 1)")
    parts = f"""
degree AS (SELECT src, max(total) AS total FROM edges GROUP BY src),
starts AS (
  SELECT walk_id, {start} % (SELECT max(total) FROM nodes) AS pos
  FROM (SELECT unnest(range(1, 1 + ({count}))) AS walk_id)
),
walk AS (
  SELECT walk_id, 0 AS step, item FROM starts JOIN nodes ON lo <= pos AND pos < hi
  UNION ALL
  SELECT n.walk_id, n.step, d.dst FROM (
    SELECT w.walk_id, w.step + 1 AS step, w.item, {onward} % g.total AS pos
    FROM walk w JOIN degree g ON g.src = w.item WHERE w.step < 9
  ) n JOIN edges d ON d.src = n.item AND d.lo <= n.pos AND n.pos < d.hi
)"""
    return with_(ratings, steps(source, order), EDGES, NODES, parts, recursive=True)


EVENT_WALKS = walks_with(EVENTS, "e", "timestamp, eventId")
LINE_WALKS = walks_with(RATINGS, "r", LINE_ORDER)
PER_ITEM = f"SELECT {WALKS_PER_ITEM} * count(*) FROM nodes"
EVENT_DEEPWALKS = walks_with(EVENTS, "e", "timestamp, eventId", PER_ITEM)
LINE_DEEPWALKS = walks_with(RATINGS, "r", LINE_ORDER, PER_ITEM)

COUNTED = "SELECT movieId, count(*) AS ratingCount, avg(rating) AS avgRating, var_samp(rating) AS ratingVar FROM r GROUP BY movieId"

BUCKETS = f"""
counted AS ({COUNTED}),
numbered AS (SELECT ratingCount, row_number() OVER (ORDER BY ratingCount) AS rk, count(*) OVER () AS n FROM counted),
cuts AS (
  SELECT DISTINCT ratingCount AS cut FROM numbered JOIN (SELECT unnest(range(1, 100)) AS i) p
    ON rk = (p.i * n + 99) // 100
),
bucketed AS (
  SELECT movieId, ratingCount, avgRating, ratingVar,
         (SELECT count(*) FROM cuts WHERE cut <= ratingCount)::INTEGER AS ratingCountBucket
  FROM counted
)"""

PRICE_BUCKETS = f"""
numbered AS (
  SELECT {KEYS}, price, row_number() OVER (ORDER BY price) AS rk, count(*) OVER () AS n FROM r
),
cuts AS (
  SELECT cut, row_number() OVER (ORDER BY cut)::INTEGER AS below FROM (
    SELECT DISTINCT price AS cut FROM numbered JOIN (SELECT unnest(range(1, 100)) AS i) p ON rk = (p.i * n + 99) // 100
  )
)"""

SCALED = "round((avgRating - min(avgRating) OVER ()) / (max(avgRating) OVER () - min(avgRating) OVER ()), 6)"

GENRE_LABELS = """
labels_seen AS (SELECT movieId, unnest(string_split(genres, '|')) AS genre FROM items),
label_table AS (
  SELECT genre, count(*) AS labelCount, (row_number() OVER (ORDER BY count(*) DESC, genre) - 1)::INTEGER AS genreIndex
  FROM labels_seen GROUP BY genre
)"""

VECTORS = "vectors AS (SELECT vec_id AS item, embedding::DOUBLE[] AS vector FROM embeddings)"

USER_SUMS = f"""
dims AS (SELECT unnest(range(0, {STORED_VECTOR_SIZE})) AS position),
user_dims AS (
  SELECT userId, position, coalesce(sum(vector[position + 1]), 0) AS value
  FROM r LEFT JOIN vectors ON item = movieId CROSS JOIN dims GROUP BY userId, position
)"""

ZEROS = f"list_resize([]::DOUBLE[], {STORED_VECTOR_SIZE}, 0::DOUBLE)"

VOCABULARY = "[" + ", ".join(f"'{g}'" for g in PART_GENRES) + "]"


def position_in_vocabulary(column: str) -> str:
    return f"(coalesce(list_position({VOCABULARY}, {column}), {len(PART_GENRES) + 1}) - 1)::INTEGER"


def slots(column: str) -> str:
    n = len(PART_GENRES)
    place = position_in_vocabulary(column)
    return f"CASE WHEN {place} = {n} THEN '' ELSE {place}::VARCHAR END || '/{n}'"


def filled(column: str) -> str:
    """A sample column as read for training: no NULL, and the string '0' is blank."""
    if "Genre" in column:
        return f"CASE WHEN coalesce({column}, '') = '0' THEN '' ELSE coalesce({column}, '') END AS {column}"
    return f"coalesce({column}, 0) AS {column}"


# Trained models: what of their results doesn't depend on the training itself.

ALS_SIDES = f"""
als_rows AS (SELECT *, {SPLIT} FROM r),
train_users AS (SELECT DISTINCT userId::INTEGER AS id FROM als_rows WHERE split = 'train'),
train_items AS (SELECT DISTINCT movieId::INTEGER AS id FROM als_rows WHERE split = 'train')"""

ALS_SCORED = """
scored AS (
  SELECT * FROM als_rows WHERE split = 'test' AND userId IN (SELECT id FROM train_users)
  AND movieId IN (SELECT id FROM train_items)
)"""


def top_lists(owners: str, entries: str) -> str:
    return (
        with_(RATINGS, ALS_SIDES)
        + f"SELECT o.id, k::INTEGER AS rank, true AS known, true AS descending, true AS once FROM ({owners}) o "
        + f"CROSS JOIN (SELECT unnest(range(1, 11)) AS k) WHERE k <= (SELECT count(*) FROM {entries})"
    )


def first_three(column: str, side: str) -> str:
    return (
        f"SELECT id FROM (SELECT DISTINCT {column}::INTEGER AS id FROM r ORDER BY id LIMIT 3) "
        + f"WHERE id IN (SELECT id FROM {side})"
    )


def similar_ranks(counts: str) -> str:
    """Ranks of the items similar to the query item, where vectors exist for items counted five times."""
    return (
        f"SELECT k::INTEGER AS rank, true AS known, true AS inRange, true AS once "
        + f"FROM (SELECT unnest(range(1, 21)) AS k) WHERE {QUERY_ITEM} IN (SELECT item FROM ({counts})) "
        + f"AND k < (SELECT count(*) FROM ({counts}))"
    )


EVENT_VOCABULARY = "SELECT movieId AS item FROM e WHERE rating >= 3.5 GROUP BY movieId HAVING count(*) >= 5"
LINE_VOCABULARY = "SELECT movieId AS item FROM r WHERE rating >= 3.5 GROUP BY movieId HAVING count(*) >= 5"
WALK_VOCABULARY = "SELECT item FROM walk GROUP BY item HAVING count(*) >= 5"
VECTOR_CHECK = "10 AS size, true AS finite"
SCORED_CHECK = (
    with_(*COUNTED_SAMPLES)
    + f"SELECT {KEYS}, label, true AS inRange, true AS fits FROM (SELECT *, {SPLIT} FROM samples) WHERE split = 'test'"
)

ALL_SAMPLE_COLUMNS = [c.strip() for c in SAMPLE_COLUMNS.replace("\n", " ").split(",")]

ORACLES: dict[str, str] = {
    "ratings_csv": with_(RATINGS) + "SELECT userId, movieId, rating, timestamp FROM r",
    "items_csv": with_(ITEMS) + "SELECT movieId, title, genres FROM items",
    "training_samples_csv": with_(*UP_TO_SAMPLES)
    + f"SELECT {', '.join(filled(c) for c in ALL_SAMPLE_COLUMNS)} FROM samples",
    "model_samples_parquet": with_(*COUNTED_SAMPLES)
    + f"SELECT movieId, userId, timestamp, rating, userRatingCount, {SPLIT} FROM samples",
    "shuffled_rows": with_(RATINGS) + f"SELECT {KEYS}, rating FROM r",
    "typed_ratings": with_(RATINGS)
    + "SELECT userId::INTEGER AS userIdInt, "
    + "CASE WHEN lineNumber = 1 THEN NULL ELSE movieId::INTEGER END AS movieIdInt, rating AS ratingFloat FROM r",
    "label_ratings": with_(RATINGS) + f"SELECT {KEYS}, userId, rating, label FROM r",
    "positive_ratings": with_(RATINGS) + f"SELECT {KEYS}, userId, rating FROM r WHERE rating >= 3.5",
    "release_year": with_(ITEMS) + "SELECT movieId, title, releaseYear FROM item_info",
    "genre_columns": with_(ITEMS) + "SELECT movieId, genres, movieGenre1, movieGenre2, movieGenre3 FROM item_info",
    "genre_explode": with_(ITEMS) + "SELECT movieId, unnest(string_split(genres, '|')) AS genre FROM items",
    "item_rating_stats": with_(RATINGS)
    + f"SELECT movieId, ratingCount, avgRating, round(ratingVar, 6) AS ratingVar FROM ({COUNTED})",
    "item_model_stats": with_(RATINGS, STATS) + "SELECT * FROM stats",
    "attach_items": with_(RATINGS, ITEMS)
    + f"SELECT {KEYS}, userId, rating, title, genres FROM r LEFT JOIN items USING (movieId)",
    "attach_item_stats": with_(RATINGS, STATS)
    + f"SELECT {KEYS}, userId, rating, movieRatingCount, movieAvgRating, movieRatingStddev "
    + "FROM r LEFT JOIN stats USING (movieId)",
    "item_stats_before": with_(RATINGS, STATS_BEFORE)
    + f"SELECT {KEYS}, userId, movieRatingCount, movieAvgRating, movieRatingStddev FROM stats_before",
    "attach_item_stats_before": with_(RATINGS, ITEMS, STATS_BEFORE)
    + f"SELECT {KEYS}, userId, coalesce(releaseYear, 1990) AS releaseYear, movieGenre1, movieGenre2, movieGenre3, "
    + "movieRatingCount, movieAvgRating FROM stats_before LEFT JOIN item_info USING (movieId)",
    "user_history": with_(*UP_TO_FEATURED, past(LIKED_LIST)) + f"SELECT {KEYS}, userId, {LIKED} FROM past",
    "user_window_stats": window_stats(100),
    "user_window_stats_10": window_stats(10),
    "user_genre_prefs": with_(*UP_TO_FEATURED, past(COUNT), PREFS)
    + f"SELECT {KEYS}, userId, {USER_GENRES} FROM past LEFT JOIN prefs USING (rid)",
    "warm_rows": with_(*UP_TO_FEATURED, past(COUNT))
    + f"SELECT {KEYS}, userId, userRatingCount FROM past WHERE userRatingCount > 1",
    "model_samples": with_(*UP_TO_SAMPLES) + f"SELECT {SAMPLE_COLUMNS} FROM samples",
    "item_snapshot": with_(*COUNTED_SAMPLES)
    + "SELECT movieId, releaseYear, coalesce(movieGenre1, '') AS movieGenre1, coalesce(movieGenre2, '') AS movieGenre2, "
    + "coalesce(movieGenre3, '') AS movieGenre3, movieRatingCount, movieAvgRating, movieRatingStddev FROM ("
    + "SELECT *, row_number() OVER (PARTITION BY movieId ORDER BY timestamp DESC, orderKey DESC, lineNumber DESC, "
    + "suppKey DESC, quantity DESC, price DESC, userId DESC) AS k FROM samples) WHERE k = 1",
    "user_snapshot": with_(*UP_TO_SAMPLES)
    + "SELECT userId, userRatedMovie1, userRatedMovie2, userRatedMovie3, userRatedMovie4, userRatedMovie5, "
    + "userRatingCount, userAvgReleaseYear, userReleaseYearStddev, userAvgRating, userRatingStddev, "
    + ", ".join(f"coalesce(userGenre{i}, '') AS userGenre{i}" for i in range(1, 6))
    + " FROM (SELECT *, row_number() OVER (PARTITION BY userId ORDER BY timestamp DESC, orderKey DESC, "
    + "lineNumber DESC, movieId DESC, suppKey DESC, quantity DESC, price DESC) AS k FROM samples) WHERE k = 1",
    "one_hot": with_(ITEMS)
    + "SELECT movieId, movieId::INTEGER AS index, ((SELECT max(movieId) FROM items) + 1)::INTEGER AS size FROM items",
    "genre_index": with_(ITEMS, GENRE_LABELS)
    + "SELECT movieId, genre, genreIndex FROM labels_seen JOIN label_table USING (genre)",
    "genre_label_table": with_(ITEMS, GENRE_LABELS) + "SELECT genre, labelCount, genreIndex FROM label_table",
    "multi_hot": with_(ITEMS, GENRE_LABELS)
    + "SELECT movieId, string_agg(genreIndex::VARCHAR, ',' ORDER BY genreIndex) AS genreIndexes, "
    + "(SELECT count(*) FROM label_table)::INTEGER AS indexSize, "
    + "string_agg(genreIndex::VARCHAR, ',' ORDER BY genreIndex) AS vectorIndexes "
    + "FROM (SELECT DISTINCT movieId, genreIndex FROM labels_seen JOIN label_table USING (genre)) GROUP BY movieId",
    "rating_count_bucket": with_(RATINGS, BUCKETS) + "SELECT movieId, ratingCount, ratingCountBucket FROM bucketed",
    "price_bucket": with_(RATINGS, PRICE_BUCKETS)
    + f"SELECT {KEYS}, coalesce(below, 0)::INTEGER AS priceBucket FROM numbered ASOF LEFT JOIN cuts ON price >= cut",
    "avg_rating_minmax": with_(RATINGS) + f"SELECT movieId, {SCALED} AS scaleAvgRating FROM ({COUNTED})",
    "rating_features": with_(RATINGS, BUCKETS)
    + "SELECT movieId, ratingCount, avgRating, round(ratingVar, 6) AS ratingVar, avgRating AS avgRatingVec, "
    + f"ratingCountBucket, {SCALED} AS scaleAvgRating FROM bucketed",
    "user_sequences": with_(EVENTS)
    + "SELECT userId, segment, string_agg(movieId::VARCHAR, ' ' ORDER BY k) AS movieIdStr FROM ("
    + "SELECT userId, movieId, k, ((k - 1) // 1000)::INTEGER AS segment FROM (SELECT userId, movieId, "
    + "row_number() OVER (PARTITION BY userId ORDER BY timestamp, eventId) AS k FROM e WHERE rating >= 3.5)"
    + ") GROUP BY userId, segment",
    "item_pairs": with_(EVENTS, steps("e", "timestamp, eventId")) + "SELECT src, dst, cnt FROM pairs",
    "order_item_pairs": with_(RATINGS, steps("r", LINE_ORDER)) + "SELECT src, dst, cnt FROM pairs",
    "transition_probs": with_(EVENTS, steps("e", "timestamp, eventId"), EDGES) + "SELECT * FROM edges",
    "item_distribution": with_(EVENTS, steps("e", "timestamp, eventId"), NODES) + "SELECT * FROM nodes",
    "random_walks": EVENT_WALKS + "SELECT walk_id, step, item FROM walk",
    "order_random_walks": LINE_WALKS + "SELECT walk_id, step, item FROM walk",
    "hash_split": with_(RATINGS) + f"SELECT {KEYS}, {SPLIT} FROM r",
    "user_vectors": with_(RATINGS, VECTORS, USER_SUMS)
    + "SELECT userId, position, round(value, 4) + 0.0 AS value FROM user_dims",
    "similar_vectors": with_(VECTORS)
    + "SELECT item, round(list_cosine_similarity(vector, (SELECT vector FROM vectors WHERE item = "
    + f"{QUERY_ITEM})), 6) AS similarity FROM vectors WHERE item <> {QUERY_ITEM} "
    + "ORDER BY list_cosine_similarity(vector, (SELECT vector FROM vectors WHERE item = "
    + f"{QUERY_ITEM})) DESC, item LIMIT 20",
    "similar_vectors_batch": with_(VECTORS)
    + "SELECT query, item, round(similarity, 6) AS similarity FROM ("
    + "SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, item) AS k FROM ("
    + "SELECT q.item AS query, v.item AS item, list_cosine_similarity(q.vector, v.vector) AS similarity "
    + f"FROM vectors q JOIN vectors v ON q.item <> v.item WHERE q.item % {QUERY_STEP} = 0)) WHERE k <= 20",
    "similar_catalogue_recall": f"SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % {QUERY_STEP} = 0",
    "dot_crosses": with_(*GENRE_SAMPLES, VECTORS, USER_SUMS)
    + f""",
user_sum AS (SELECT userId, list(value ORDER BY position) AS userVector FROM user_dims GROUP BY userId),
genre_dims AS (
  SELECT genre, position, avg(vector[position + 1]) AS value
  FROM (SELECT DISTINCT movieId, unnest(string_split(genres, '|')) AS genre FROM items)
  JOIN vectors ON item = movieId CROSS JOIN dims GROUP BY genre, position
),
genre_mean AS (SELECT genre, list(value ORDER BY position) AS vector FROM genre_dims GROUP BY genre),
joined AS (
  SELECT {KEYS}, s.userId, coalesce(v.vector, {ZEROS}) AS iv, coalesce(userVector, {ZEROS}) AS uv,
         coalesce(a.vector, {ZEROS}) AS ig, coalesce(b.vector, {ZEROS}) AS ug
  FROM samples s LEFT JOIN vectors v ON v.item = s.movieId LEFT JOIN user_sum u ON u.userId = s.userId
  LEFT JOIN genre_mean a ON a.genre = movieGenre1 LEFT JOIN genre_mean b ON b.genre = userGenre1
)
SELECT {KEYS}, userId, round(list_dot_product(iv, uv), 4) + 0.0 AS itemUserDot,
       round(list_dot_product(iv, ug), 4) + 0.0 AS itemUserGenreDot, round(list_dot_product(ig, uv), 4) + 0.0 AS itemGenreUserDot,
       round(list_dot_product(ig, ug), 4) + 0.0 AS itemGenreUserGenreDot
FROM joined""",
    "hashed_cross": with_(*UP_TO_FEATURED, past(LIKED_LIST))
    + f"SELECT {KEYS}, userId, liked[1] AS userRatedMovie1, "
    + draw("movieId || ':' || coalesce(liked[1]::VARCHAR, '')")
    + " % 10000 AS crossBucket FROM past",
    "genre_vocab_lookup": with_(ITEMS)
    + "SELECT movieId, "
    + ", ".join(f"{position_in_vocabulary(f'movieGenre{i}')} AS movieGenre{i}Index" for i in range(1, 4))
    + " FROM item_info",
    "genre_indicators": with_(ITEMS)
    + "SELECT movieId, "
    + ", ".join(f"{slots(f'movieGenre{i}')} AS movieGenre{i}Slots" for i in range(1, 4))
    + " FROM item_info",
    "id_bucket": with_(RATINGS)
    + f"SELECT {KEYS}, movieId AS bucket FROM r",
    "rating_rmse": with_(RATINGS, STATS)
    + "SELECT round(sqrt(avg((movieAvgRating - rating) * (movieAvgRating - rating))), 6) AS rmse "
    + "FROM r JOIN stats USING (movieId)",
    "score_evaluation": with_(RATINGS, STATS)
    + "SELECT round(avg(-ln(least(greatest(CASE WHEN label = 1 THEN movieAvgRating / 5 ELSE 1 - movieAvgRating / 5 END, "
    + "1e-15), 1 - 1e-15))), 6) AS loss, "
    + "round(avg(CASE WHEN label = (CASE WHEN movieAvgRating >= 2.5 THEN 1 ELSE 0 END) THEN 1.0 ELSE 0.0 END), 6) "
    + "AS accuracy FROM r JOIN stats USING (movieId)",
    "distinct_users": with_(RATINGS) + "SELECT DISTINCT userId FROM r",
    "numeric_vector": with_(*UP_TO_FEATURED, past(NUMBERS), WARM)
    + f"SELECT {KEYS}, userId, releaseYear AS x0, movieRatingCount AS x1, movieAvgRating AS x2, "
    + "movieRatingStddev AS x3, userRatingCount AS x4, userAvgReleaseYear AS x5, userReleaseYearStddev AS x6, "
    + "userAvgRating AS x7, userRatingStddev AS x8 FROM samples",
    "pretrained_columns": with_(RATINGS, VECTORS)
    + f"SELECT {KEYS}, userId, {STORED_VECTOR_SIZE} AS size, "
    + ", ".join(f"round(coalesce(vector[{i + 1}], 0), 6) AS x{i}" for i in range(4))
    + " FROM r LEFT JOIN vectors ON item = movieId",
    "first_users": with_(RATINGS) + "SELECT DISTINCT userId FROM r ORDER BY userId LIMIT 3",
    "als_scores": with_(RATINGS, ALS_SIDES, ALS_SCORED)
    + "SELECT orderKey, lineNumber, suppKey, userId::INTEGER AS userIdInt, movieId::INTEGER AS movieIdInt, "
    + "rating AS ratingFloat, true AS finite FROM scored",
    "als_half_step": with_(RATINGS, VECTORS)
    + """
, sums AS (
  SELECT userId, sum(vector[1] * vector[1]) + 0.01 * count(*) AS a, sum(vector[1] * vector[2]) AS b,
         sum(vector[2] * vector[2]) + 0.01 * count(*) AS d, sum(rating * vector[1]) AS p, sum(rating * vector[2]) AS q
  FROM r JOIN vectors ON item = movieId GROUP BY userId
)
SELECT userId, round((d * p - b * q) / (a * d - b * b), 5) + 0.0 AS x, round((a * q - b * p) / (a * d - b * b), 5) + 0.0 AS y
FROM sums""",
    "item_information": with_(EVENTS)
    + """
, placed AS (
  SELECT userId, movieId, k, (k - 1) // 1000 AS segment FROM (
    SELECT userId, movieId, row_number() OVER (PARTITION BY userId ORDER BY timestamp, eventId) AS k FROM e WHERE rating >= 3.5)
),
near AS (
  SELECT p.movieId AS a, q.movieId AS b FROM placed p JOIN placed q
  ON p.userId = q.userId AND p.segment = q.segment AND q.k BETWEEN p.k + 1 AND p.k + 5
),
counted AS (SELECT a, b, count(*) AS n FROM (SELECT a, b FROM near UNION ALL SELECT b, a FROM near) GROUP BY a, b),
marginal AS (SELECT a AS item, sum(n) AS n FROM counted GROUP BY a),
ratios AS (
  SELECT c.a, c.b, c.n * (SELECT sum(n)::DOUBLE FROM counted) / (x.n::DOUBLE * y.n) AS ratio
  FROM counted c JOIN marginal x ON x.item = c.a JOIN marginal y ON y.item = c.b
)
SELECT a, b, round(ln(ratio), 6) AS weight FROM ratios WHERE ratio > 1""",
    "als_fit": with_(RATINGS)
    + f"SELECT count(*) AS scored, true AS belowMean FROM (SELECT {SPLIT} FROM r) WHERE split = 'train'",
    "als_rmse": with_(RATINGS, ALS_SIDES, ALS_SCORED)
    + "SELECT count(*) AS scored, true AS finite FROM scored",
    "als_item_factors": with_(RATINGS, ALS_SIDES)
    + f"SELECT id::BIGINT AS item, {VECTOR_CHECK} FROM train_items",
    "als_user_factors": with_(RATINGS, ALS_SIDES)
    + f"SELECT id::BIGINT AS item, {VECTOR_CHECK} FROM train_users",
    "als_top_items": top_lists("SELECT id FROM train_users", "train_items"),
    "als_top_users": top_lists("SELECT id FROM train_items", "train_users"),
    "als_user_subset": top_lists(first_three("userId", "train_users"), "train_items"),
    "als_item_subset": top_lists(first_three("movieId", "train_items"), "train_users"),
    "als_cv": "SELECT unnest(range(0, 10))::INTEGER AS fold, 0.01::DOUBLE AS regularization, true AS finite",
    "item2vec_vectors": with_(EVENTS) + f"SELECT item, {VECTOR_CHECK} FROM ({EVENT_VOCABULARY})",
    "deepwalk_vectors": EVENT_DEEPWALKS + f"SELECT item, {VECTOR_CHECK} FROM ({WALK_VOCABULARY})",
    "item2vec_user_vectors": with_(EVENTS)
    + f"SELECT userId, {VECTOR_CHECK}, bool_or(movieId IN ({EVENT_VOCABULARY})) AS filled FROM e GROUP BY userId",
    "similar_items": with_(RATINGS) + similar_ranks(LINE_VOCABULARY),
    "deepwalk_similar_items": LINE_DEEPWALKS + similar_ranks(WALK_VOCABULARY),
    "ctr_mlp": SCORED_CHECK,
    "neural_cf": SCORED_CHECK,
    "wide_deep": SCORED_CHECK,
    "fm": SCORED_CHECK,
    "two_tower": SCORED_CHECK,
    "stored_vectors_topk": with_(RATINGS, VECTORS, USER_SUMS)
    + ", users AS (SELECT userId, list(value ORDER BY position) AS vector FROM user_dims GROUP BY userId), "
    + "scored AS (SELECT userId, item AS movieId, list_dot_product(u.vector, v.vector) AS s FROM users u, vectors v), "
    + "best AS (SELECT *, row_number() OVER (PARTITION BY userId ORDER BY s DESC, movieId) AS rank FROM scored) "
    + "SELECT userId, rank::INTEGER AS rank, movieId, round(s, 4) AS score FROM best WHERE rank <= 10",
    "users_of_items_topk": with_(RATINGS, VECTORS, USER_SUMS)
    + ", users AS (SELECT userId, list(value ORDER BY position) AS vector FROM user_dims GROUP BY userId), "
    + "scored AS (SELECT item AS movieId, userId, list_dot_product(v.vector, u.vector) AS s FROM users u, vectors v "
    + f"WHERE item % {QUERY_STEP} = 0), "
    + "best AS (SELECT *, row_number() OVER (PARTITION BY movieId ORDER BY s DESC, userId) AS rank FROM scored) "
    + "SELECT movieId, rank::INTEGER AS rank, userId, round(s, 4) AS score FROM best WHERE rank <= 10",
}
