"""SimHash near-duplicates: pigeonhole blocks, then the Hamming distance.

A fingerprint's 64 bits are cut into six blocks. Two fingerprints that differ in
at most three bits agree on at least three whole blocks, so every such pair
meets under one of the twenty ways to choose three blocks, about 32 bits each.
Only different fingerprints are compared: copies share one.

Within a bucket the distances are computed on arrays, and only the links of a
spanning forest leave it, so a bucket of n fingerprints gives fewer than n rows
and no pair is lost to the components. A bucket that is larger than
``BUCKET_ROWS`` is cut into parts, and each two parts are compared in a group of
their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tastemill.llm.common import map_text, saved
from tastemill.llm.components import components
from tastemill.operators.skew import fits_broadcast, hot_keys

SEED = 42
BLOCKS = 6
# Fingerprints that one task compares with each other at a time.
BUCKET_ROWS = 8_192
SAMPLE = 64


def fingerprint(text: str | None, words: int = 3) -> int:
    """The SimHash of a text's word shingles, repeats included, as an unsigned integer."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words))))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), "<u8")
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 65_536):
        part = hashes[start : start + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, words: int = 3, id_column: str = "doc_id") -> DataFrame:
    """The id, ``fp``, the fingerprint as a signed 64-bit integer, and ``n_words`` of every row."""

    def make(block: pa.RecordBatch) -> dict[str, object]:
        texts = block.column("text").to_pylist()
        found = np.array([fingerprint(t, words) for t in texts], "<u8")
        counts = [len(t.encode().split()) if t else 0 for t in texts]
        return {id_column: block.column(id_column), "fp": found.view("<i8"), "n_words": counts}

    kind = documents.schema[id_column].dataType.simpleString()
    return map_text(documents, [id_column, "text"], f"{id_column} {kind}, fp bigint, n_words bigint", make)


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks of all choices of whole blocks on which a close pair can agree."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    single = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [reduce(int.__or__, chosen) for chosen in combinations(single, blocks - distance)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _bucket_links(fps: np.ndarray, side: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the close pairs of one bucket.

    side: 0 and 1 for the two parts of a cut bucket, which are compared across
    only; -1 for a bucket compared within itself.
    """
    n = len(fps)
    root = np.arange(n)
    left, right = [], []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    step = max(1, 4_000_000 // n)
    for start in range(0, n, step):
        near = np.bitwise_count(fps[start : start + step, None] ^ fps[None, :]) <= distance
        rows, cols = np.nonzero(near)
        rows += start
        apart = (rows < cols) & ((side[rows] != side[cols]) | (side[rows] < 0))
        for a, b in zip(rows[apart].tolist(), cols[apart].tolist()):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
                left.append(a)
                right.append(b)
    return fps[np.array(left, int)], fps[np.array(right, int)]


def close_links(distinct: DataFrame, distance: int = 3, blocks: int = BLOCKS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links ``a``, ``b`` that join all different fingerprints ``fp`` within ``distance`` bits.

    Every component of the full link graph is joined; within a bucket, links
    that would close a cycle are left out.
    """
    masks = block_masks(distance, blocks)
    distinct = saved(distinct)
    keyed = distinct.select(
        "fp",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).cast("tinyint").alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits"))
                    for i, m in enumerate(masks)
                ]
            )
        ).alias("key"),
    ).select("fp", "key.mask", "key.bits")
    # Large buckets are found on one fingerprint in SAMPLE; this decides only how the work is dealt out.
    sampled = keyed.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0)
    large = hot_keys(sampled, ["mask", "bits"], max(1, bucket_rows // SAMPLE))
    if large is None:
        members = keyed.withColumn("parts", F.lit(1))
    else:
        large = large.select(
            F.col("__hot_mask").alias("mask"),
            F.col("__hot_bits").alias("bits"),
            F.ceil(F.col("__n") * SAMPLE / bucket_rows).cast("int").alias("parts"),
        )
        side = F.broadcast(large) if fits_broadcast(large) else large
        members = keyed.join(side, ["mask", "bits"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    members = members.withColumn("own", F.pmod(F.xxhash64("fp", F.lit("part")), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = members.withColumn("other", other).select(
        "fp",
        "mask",
        "bits",
        F.least("own", "other").alias("low"),
        F.greatest("own", "other").alias("high"),
        F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    keys = ["mask", "bits", "low", "high"]
    schema = StructType.fromDDL("a bigint, b bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        held: list[np.ndarray] = []

        def links(rows: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
            sizes = np.diff(starts, append=len(rows))
            first = starts[sizes == 2]
            x, y = rows[first, 0], rows[first + 1, 0]
            close = np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= distance
            close &= (rows[first, 5] != rows[first + 1, 5]) | (rows[first, 5] < 0)
            a, b = [x[close]], [y[close]]
            more = sizes > 2
            for start, size in zip(starts[more].tolist(), sizes[more].tolist()):
                group = rows[start : start + size]
                x, y = _bucket_links(np.ascontiguousarray(group[:, 0]).view(np.uint64), group[:, 5], distance)
                a.append(x.view(np.int64))
                b.append(y.view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], schema=arrow)

        def groups(rows: np.ndarray) -> np.ndarray:
            changed = (rows[1:, 1:5] != rows[:-1, 1:5]).any(1)
            return np.concatenate([[0], np.nonzero(changed)[0] + 1])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1))
            if len(held) > 1 and (held[0][0, 1:5] == held[-1][-1, 1:5]).all():
                continue
            rows = np.ascontiguousarray(np.concatenate(held))
            starts = groups(rows)
            if len(starts) > 1:
                yield links(np.ascontiguousarray(rows[: starts[-1]]), starts[:-1])
            held = [rows[starts[-1] :]]
        if held:
            rows = np.ascontiguousarray(np.concatenate(held))
            yield links(rows, groups(rows))

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def near_duplicates(
    documents: DataFrame,
    *,
    words: int = 3,
    distance: int = 3,
    blocks: int = BLOCKS,
    least_words: int = 0,
    id_column: str = "doc_id",
) -> DataFrame:
    """Fingerprint and component of every row of ``documents``.

    Columns: the id, ``fingerprint`` (16 lowercase hex digits) and
    ``component_id``, the smallest id reachable over links of at most
    ``distance`` differing bits, itself included. Texts of fewer than
    ``least_words`` words are linked to equal fingerprints only. A null or blank text has
    fingerprint zero and is linked like any other; a text of fewer words than a
    shingle is one shingle. Repeated rows stay repeated and share a component. A
    null id is never a component's name unless all its rows have none; then the
    component is null. An empty table gives an empty one, other columns are not
    read.
    """
    found = saved(fingerprints(documents, words, id_column))
    nodes = found.groupBy("fp").agg(F.min(id_column).alias("least"), F.max("n_words").alias("n_words"))
    links = components(
        close_links(nodes.where(F.col("n_words") >= least_words).select("fp"), distance, blocks).select(F.col("a").alias("u"), F.col("b").alias("v"))
    )
    rooted = nodes.join(links.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(named, "root").select("fp", "component_id")
    return found.join(named, "fp", "left").select(id_column, hex_digits("fp").alias("fingerprint"), "component_id")


def hex_digits(column: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def one_of_each(documents: DataFrame, *, id_column: str = "doc_id", **limits: int) -> DataFrame:
    """One row of ``documents`` for each component: the one of the smallest id, with all its columns.

    Of several rows with that id one stays. A component without any id keeps one row.
    """
    return first_of_each(documents, near_duplicates(documents, id_column=id_column, **limits), id_column)


def first_of_each(documents: DataFrame, found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """As ``one_of_each``, for components ``found`` as ``near_duplicates`` gives them."""
    first = saved(found.where(F.col(id_column).eqNullSafe(F.col("component_id"))).groupBy(id_column, "fingerprint").count())
    # The fingerprint tells apart rows without an id.
    repeated = not first.groupBy(id_column).agg(F.sum("count").alias("n")).where("n > 1").isEmpty()
    chosen = first.select(F.col(id_column).alias("__first"))
    kept = documents.join(chosen.distinct(), documents[id_column].eqNullSafe(F.col("__first")), "left_semi")
    if not repeated:
        return kept
    named = first.where(F.col(id_column).isNotNull())
    with_id = kept.where(F.col(id_column).isNotNull()).dropDuplicates([id_column])
    if named.count() == first.count():
        return with_id
    return with_id.unionByName(kept.where(F.col(id_column).isNull()).dropDuplicates(["text"]))
