"""Near duplicates by the Jaccard similarity of word shingles.

1. Every different set of shingles gets BANDS hashes, each of ROWS minima of the
   set under hash functions of their own. Sets of similarity s share a band with
   probability 1 - (1 - s**ROWS)**BANDS: all but 3 in a million pairs at 0.8.
   The length of a text plays no part, so short texts need no rule of their own.
2. Sets that share a band are candidates; links to the least set of each band
   give components of candidates, without pairing a band's sets.
3. Only within such a component, the sets themselves meet, and the similarity of
   any two that are not joined yet is computed. A component of more than
   PART_SHINGLES shingles is cut into parts, each two of which are compared in a
   group of their own.
4. Components of the links that reach the similarity are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tastemill.llm.common import map_text, saved
from tastemill.llm.components import components
from tastemill.llm.simhash import SEED, first_of_each, hex_digits
from tastemill.operators.skew import fits_broadcast

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
# Shingles of the sets that one task compares with each other at a time, about.
PART_SHINGLES = 1_000_000
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64)
FACTORS, TERMS = _DRAWN[0] * np.uint64(2) + np.uint64(1), _DRAWN[1]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted hashes of a text's different word shingles; a shorter text is one shingle, a blank one none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, "<u8")
    cut = map(b" ".join, zip(*(tokens[i:] for i in range(words)))) if len(tokens) >= words else [b" ".join(tokens)]
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), cut), "<u8"))


def set_key(hashes: np.ndarray) -> int:
    """A name for a set of shingles, as a signed integer."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), seed=SEED) - (1 << 63)


def bands(hashes: np.ndarray) -> list[int]:
    """A set's band hashes, as signed integers; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 4_096):
        least = np.minimum(least, (hashes[start : start + 4_096] * FACTORS + TERMS).min(1))
    return [xxhash.xxh64_intdigest(row.tobytes(), seed=i) - (1 << 63) for i, row in enumerate(least.reshape(BANDS, ROWS))]


def similar_links(keys: np.ndarray, sets: list[np.ndarray], side: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the pairs of sets that reach ``similarity``.

    side: 0 and 1 for the two parts of a cut component, which are compared across
    only; -1 for sets compared with all others.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    every, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    every = np.unique(every, return_inverse=True)[1]
    marked = np.zeros(len(every), np.int32)
    root = np.arange(n)
    left, right = [], []
    for i in range(n - 1):
        free = (root != root[i]) & (np.arange(n) > i) & ((side != side[i]) | (side[i] < 0))
        free &= np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]) - 1e-9
        if not free.any():
            continue
        own = every[starts[i] : starts[i] + sizes[i]]
        marked[own] = 1
        shared = np.add.reduceat(marked[every], starts)
        marked[own] = 0
        for j in np.nonzero(free & (shared >= similarity * (sizes + sizes[i] - shared) - 1e-9))[0].tolist():
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                left.append(i)
                right.append(j)
    return keys[np.array(left, int)], keys[np.array(right, int)]


def _verified(members: DataFrame, similarity: float, part_shingles: int) -> DataFrame:
    """Links ``u``, ``v`` between the sets of each component ``root``: columns ``root``, ``key``, ``shingles``."""
    members = saved(members)
    size = F.octet_length("shingles") / 8
    parts = members.groupBy("root").agg(F.ceil(F.sum(size) / part_shingles).cast("int").alias("parts"))
    parts = parts.where("parts > 1")
    side = F.broadcast(parts) if fits_broadcast(parts) else parts
    dealt = members.join(side, "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("key", F.lit("part")), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "root",
        F.least("own", "other").alias("low"),
        F.greatest("own", "other").alias("high"),
        F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
        "key",
        "shingles",
    )
    keys, schema = ["root", "low", "high"], StructType.fromDDL("u bigint, v bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        group, held = None, {}

        def links() -> pa.RecordBatch:
            # Rows of one id and text come several times.
            names = np.array(list(held), np.int64)
            sets = [np.frombuffer(s, "<u8") for s, _ in held.values()]
            u, v = similar_links(names, sets, np.array([x for _, x in held.values()]), similarity)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=arrow)

        for batch in batches:
            for root, low, high, where, key, own in zip(*(c.to_pylist() for c in batch.columns)):
                if (root, low, high) != group:
                    if len(held) > 1:
                        yield links()
                    group, held = (root, low, high), {}
                held[key] = own, where
        if len(held) > 1:
            yield links()

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def similar_groups(
    documents: DataFrame,
    *,
    words: int = WORDS,
    similarity: float = SIMILARITY,
    part_shingles: int = PART_SHINGLES,
    id_column: str = "doc_id",
) -> DataFrame:
    """Group of every row of ``documents``.

    Columns: the id, ``fingerprint`` (16 hex digits that name the set of
    shingles) and ``component_id``, the smallest id reachable over pairs of
    texts whose sets of shingles have a Jaccard similarity of at least
    ``similarity`` (0.8 or more: the bands are chosen for that). Null and blank
    texts have no shingles and form one group. Repeated rows stay repeated. A
    null id names a group only if all its rows have none. An empty table gives
    an empty one, other columns are not read.
    """

    def describe(block: pa.RecordBatch) -> dict[str, object]:
        sets = [shingles(t, words) for t in block.column("text").to_pylist()]
        return {id_column: block.column(id_column), "key": [set_key(s) for s in sets], "bands": [bands(s) for s in sets]}

    kind = documents.schema[id_column].dataType.simpleString()
    found = saved(map_text(documents, [id_column, "text"], f"{id_column} {kind}, key bigint, bands array<bigint>", describe))
    nodes = saved(found.groupBy("key").agg(F.min(id_column).alias("least"), F.first("bands").alias("bands")))
    banded = nodes.select("key", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    near = components(banded.join(shared, "band").where("key <> first").select(F.col("key").alias("u"), F.col("first").alias("v")))
    placed = near.select(F.col("u").alias("key"), F.col("v").alias("root"))
    placed = placed.unionByName(near.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct())
    # Each set comes from the text of its least id, whose rows may have other texts too.
    wanted = saved(placed.join(nodes.select("key", "least"), "key").select("key", "root", F.col("least").alias("__least")))
    side = F.broadcast(wanted) if fits_broadcast(wanted) else wanted
    rows = documents.select(F.col(id_column).alias("__id"), "text").join(side, F.col("__id").eqNullSafe(F.col("__least")))

    def gather(block: pa.RecordBatch) -> dict[str, object]:
        sets = [shingles(t, words) for t in block.column("text").to_pylist()]
        right = [set_key(s) == k for s, k in zip(sets, block.column("key").to_pylist())]
        held = block.filter(pa.array(right, pa.bool_()))
        own = [s.tobytes() for s, r in zip(sets, right) if r]
        return {"key": held.column("key"), "root": held.column("root"), "shingles": own}

    members = map_text(rows, ["key", "root", "text"], "key bigint, root bigint, shingles binary", gather)
    links = components(_verified(members, similarity, part_shingles))
    rooted = nodes.join(links.select(F.col("u").alias("key"), F.col("v").alias("root")), "key", "left")
    rooted = rooted.select("key", "least", F.coalesce("root", "key").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(named, "root").select("key", "component_id")
    return found.join(named, "key", "left").select(id_column, hex_digits("key").alias("fingerprint"), "component_id")


def one_of_each_group(documents: DataFrame, *, id_column: str = "doc_id", **limits: float) -> DataFrame:
    """One row of ``documents`` for each group of ``similar_groups``, as ``simhash.one_of_each`` chooses it."""
    return first_of_each(documents, similar_groups(documents, id_column=id_column, **limits), id_column)
