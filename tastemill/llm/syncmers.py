"""Document fingerprints from closed syncmers, with SQL functions only.

A k-mer of K words is a closed syncmer if the least of its inner words, by hash,
stands at one of its edges. Whether it is one depends on the k-mer alone, so
equal passages give equal anchors wherever they stand. An anchor is combined
with the distance to the next one, which makes matches positional: two texts
share an element where they share an anchor and what lies up to the next.

The fingerprint holds the elements of all anchors of the whole text. The likeness of two
fingerprints is the exact Jaccard similarity of their elements. ``anchor_table``
has the anchors with their places, and ``shared_spans`` the passages that pairs
of documents share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.llm.common import saved

K = 4
SPACE = r"[\x20\x09-\x0D]+"


def _with(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def placed_elements(text: Column) -> Column:
    """Every anchor as (``element``, ``start``, ``size``): a 64-bit hash, its first word's place from 0, and words.

    An element covers its k-mer and all up to the next anchor's first word. A
    text of fewer than K words is one element; a blank one has none.
    """
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    no_place = F.array().cast("array<struct<element: bigint, start: int, size: int>>")

    def placed(element: Column, start: Column, size: Column) -> Column:
        return F.struct(element.alias("element"), start.cast("int").alias("start"), size.cast("int").alias("size"))

    def anchors(hashes: Column) -> Column:
        at = lambda i: F.get(hashes, i)

        def closed(i: Column) -> Column:
            edge = F.least(at(i), at(i + (K - 1)))
            inner = F.least(*[at(i + j) for j in range(1, K - 1)])
            return edge <= inner

        def element(places: Column, i: Column, n: Column) -> Column:
            gap = F.coalesce(F.get(places, n + 1), i) - i
            return placed(F.xxhash64(*[at(i + j) for j in range(K)], gap), i, F.greatest(gap, F.lit(K)))

        places = F.filter(F.sequence(F.lit(0), F.size(hashes) - K), closed)
        found = _with(places, lambda p: F.transform(p, lambda i, n: element(p, i, n)))
        short = F.array(placed(F.xxhash64(hashes), F.lit(0), F.size(hashes)))
        return F.coalesce(F.when(F.size(hashes) >= K, found).when(F.size(hashes) > 0, short), no_place)

    return _with(F.transform(words, lambda w: F.xxhash64(w)), anchors)


def elements(text: Column) -> Column:
    """All elements of a text, as a sorted array of different 64-bit hashes."""
    return F.sort_array(F.array_distinct(F.transform(placed_elements(text), lambda e: e["element"])))


def as_string(elements: Column) -> Column:
    """Sixteen hex digits for each element."""
    return F.array_join(F.transform(elements, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1; two empty fingerprints are alike, an empty one is like no other."""
    shared = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - shared
    return F.when(either == 0, 1.0).otherwise(F.round(shared / F.greatest(either, F.lit(1)), 6))


def anchor_table(documents: DataFrame, *, id_column: str = "doc_id") -> DataFrame:
    """The anchors of every document, one row for each: id, ``element``, ``start``, ``size``.

    Null and blank texts have none; repeated rows have theirs repeated. Rows
    come from one document each, without a shuffle.
    """
    found = documents.select(id_column, F.explode(placed_elements(F.coalesce("text", F.lit("")))).alias("e"))
    return found.select(id_column, "e.element", "e.start", "e.size")


def shared_spans(documents: DataFrame, pairs: DataFrame, *, id_column: str = "doc_id") -> DataFrame:
    """The longest runs of words that given pairs of documents share at one shift of places.

    ``pairs`` has ``left_id`` and ``right_id``; ids of ``documents`` are different
    from each other. Each row has both ids, ``left_start``, ``right_start`` and
    ``n_words``. An element that occurs several times in a document is matched
    at its first place. Elements that touch or overlap at the same shift make
    one run. Null ids match nothing.
    """
    wanted = pairs.select("left_id", "right_id").distinct()
    placed = anchor_table(documents, id_column=id_column).groupBy(id_column, "element", "size").agg(F.min("start").alias("start"))
    left = placed.select(F.col(id_column).alias("left_id"), "element", F.col("start").alias("left_start"), "size")
    right = placed.select(F.col(id_column).alias("right_id"), "element", F.col("start").alias("right_start"), "size")
    both = left.join(wanted, "left_id").join(right, ["right_id", "element", "size"])
    pair = ["left_id", "right_id", "shift"]
    met = both.withColumn("shift", F.col("right_start") - F.col("left_start"))
    order = Window.partitionBy(*pair).orderBy("left_start")
    end = F.max(F.col("left_start") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    breaks = met.withColumn("new", (F.coalesce(end, F.lit(-1)) < F.col("left_start")).cast("int"))
    runs = breaks.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        runs.groupBy(*pair, "run")
        .agg(F.min("left_start").alias("left_start"), F.max(F.col("left_start") + F.col("size")).alias("end"))
        .select(
            "left_id",
            "right_id",
            "left_start",
            (F.col("left_start") + F.col("shift")).alias("right_start"),
            (F.col("end") - F.col("left_start")).alias("n_words"),
        )
    )


def neighbours(documents: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """For each different row, the place of the next one in descending id: ``key``, ``wanted_by``, ``half``.

    Rows of one id follow each other by the hash of their texts, null ids come
    last, and after the last row comes the first. Only ids and lengths are
    sorted, in ranges; a range's rows are numbered within it.
    """
    rows = documents.groupBy(id_column, "key").agg(F.first("n_chars").alias("n_chars"))
    order = [F.col(id_column).desc_nulls_last(), F.col("key").desc()]
    # The ranges' bounds come from a sample, so the ranges are written down first.
    dealt = saved(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # One row for each range.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("offset")
    numbered = saved(dealt.join(offsets, "part").select("key", "n_chars", place.cast("long").alias("place")))
    total = numbered.count()
    previous = numbered.select(
        F.col("key").alias("wanted_by"),
        F.floor(F.col("n_chars") / 2).cast("int").alias("half"),
        (F.col("place") % F.lit(max(total, 1)) + 1).alias("place"),
    )
    return numbered.select("key", "place").join(previous, "place").select("key", "wanted_by", "half")


def edited_fingerprints(documents: DataFrame, *, id_column: str = "doc_id") -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness.

    The edited text has its last half (rounded down, in code points) replaced by
    as many of the first code points of the next document's text, or all of
    them. Columns: the id, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next`` and ``next_id``. A null text counts
    as empty. The next document is the next lower id; null ids come last and the
    first follows the last; rows of one id are ordered by a hash of their text;
    a repeated row shares the outcome of its copy. A single document is followed
    by itself. An empty table gives an empty one; other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col(id_column), text.alias("text"))
    rows = rows.withColumn("key", F.xxhash64(id_column, "text"))
    lengths = rows.select(id_column, "key", F.length("text").cast("long").alias("n_chars"))
    chain = neighbours(lengths, id_column)
    # Each text goes once to the row it is next to; as text, as its elements would take more room.
    heads = (
        rows.dropDuplicates(["key"])
        if not lengths.groupBy("key").count().where("count > 1").isEmpty()
        else rows
    )
    # Both joins read the same columns, so that the texts are shuffled once for both.
    heads = heads.join(chain, "key").select(
        F.col("wanted_by").alias("key"),
        F.col(id_column).alias("next_id"),
        "half",
        F.col("text").alias("next_text"),
    )
    joined = rows.join(heads, "key")
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.col("half")), F.substring("next_text", F.lit(1), F.col("half")))
    found = joined.select(
        id_column,
        n.cast("long").alias("n_chars"),
        F.sha2(edited, 256).alias("edited_sha256"),
        elements(F.col("text")).alias("own"),
        elements(edited).alias("edited"),
        elements(F.col("next_text")).alias("following"),
        "next_id",
    )
    return found.select(
        id_column,
        "n_chars",
        "edited_sha256",
        as_string(F.col("own")).alias("fingerprint"),
        as_string(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
        "next_id",
    )
