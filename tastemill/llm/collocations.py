"""Phrases of words that occur together, from a weighted De Bruijn graph.

Nodes are grams of LONGEST - 1 words, edges grams of LONGEST words with the number
of their occurrences as weight.

1. Word pairs are counted. A phrase that counts holds no rarer pair, so
   pieces are cut between the words of each rare pair, without losing a phrase.
2. At each place of what is left, the longest gram that starts there is counted:
   an edge, or near the end of a piece a shorter gram, the end's correction.
3. Counts of shorter grams follow without reading texts again: a gram starts
   wherever an edge or longer gram that begins with it starts (the flow out of its
   node), and at the piece ends that have it.
4. Where a gram's whole flow goes on through one longer gram, to the right or
   to the left, the gram is inside a unary path: paths are compacted, and only the
   gram at the end of the compaction stays a phrase.
"""

from __future__ import annotations

from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.llm.common import map_text, written
from tastemill.operators.skew import lookup_join

LONGEST = 5
LEAST = 100
TOP = 2_000
NO_LANG = "und"
# Bits of the table of frequent pairs that every task holds: 16 MB, whatever the corpus. Where more pairs
# than that are frequent, some rare pairs are kept too, which costs time and changes no count.
PAIR_BITS = 27
# Words that one task remembers the numbers of.
REMEMBERED = 1_000_000

# A-Z in lower case, ends of pieces as line ends, tabs as blanks.
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
MIX, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Words:
    """Numbers for words, with their names and hashes by number; 0 is the end of a piece."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = {b"\n": 0}
        self.names: list[str] = []
        self.hashes = np.empty(0, np.uint64)

    def number(self, text: str | None) -> np.ndarray:
        raw = (text or "").encode("utf-8", "surrogatepass").translate(PLAIN).replace(b"\n", b" \n ")
        numbers = self.numbers
        tokens = [w for w in raw.split(b" ") if w]
        return np.fromiter([numbers.setdefault(w, len(numbers)) for w in tokens], np.int64, len(tokens))

    def by_lang(self, block: pa.RecordBatch) -> list[tuple[str, np.ndarray]]:
        """For each language of a block, the numbers of all its words, 0 between pieces and around texts."""
        if len(self.numbers) > REMEMBERED:
            self.clear()
        found: dict[str, list[np.ndarray]] = {}
        end = np.zeros(1, np.int64)
        for lang, text in zip(block.column("lang").to_pylist(), block.column("text").to_pylist()):
            found.setdefault(NO_LANG if lang is None else lang, [end]).extend((self.number(text), end))
        new = list(islice(self.numbers, len(self.names), None))
        self.names += [w.decode("utf-8", "surrogatepass") for w in new]
        self.hashes = np.append(self.hashes, np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new)))
        return [(lang, np.concatenate(parts)) for lang, parts in found.items()]

    def pairs(self, ids: np.ndarray, lang: str) -> np.ndarray:
        """A hash of the language and of each word with the one after it."""
        own = self.hashes[ids]
        salt = np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")))
        mixed = ((own[:-1] ^ salt) * MIX) ^ (own[1:] + MIX2)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * MIX2
        return mixed ^ (mixed >> np.uint64(32))


def frequent_pairs(documents: DataFrame, least: int = LEAST, bits: int = PAIR_BITS) -> np.ndarray:
    """A table of ``2**bits`` bits in which the hash of every pair of words that occurs ``least`` times is set.

    Pairs are counted by hash, over all documents. Chunks of the table are put
    together where the counts are, and only set chunks travel.
    """
    words = Words()

    def make(block: pa.RecordBatch) -> dict[str, object]:
        pairs, counts = [], []
        for lang, ids in words.by_lang(block):
            own = words.pairs(ids, lang)[(ids[:-1] > 0) & (ids[1:] > 0)]
            found, c = np.unique(own, return_counts=True)
            pairs.append(found)
            counts.append(c)
        return {"pair": np.concatenate(pairs).view(np.int64), "c": np.concatenate(counts)}

    counted = map_text(documents, ["lang", "text"], "pair bigint, c bigint", make)
    # A pair's place in the table is its highest bits.
    frequent = counted.groupBy("pair").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    slot = F.shiftrightunsigned("pair", 64 - bits)
    word = frequent.select(
        F.shiftright(slot, 6).alias("place"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63).cast("long")).cast("int")).alias("bit")
    )
    # At most as many rows as the table has words, whatever the corpus.
    rows = word.groupBy("place").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[rows["place"].to_numpy()] = rows["bits"].to_numpy()
    return table.view(np.uint64)


def edges(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = PAIR_BITS) -> DataFrame:
    """The longest gram that starts at each word, counted: ``lang``, ``gram``, ``size`` (its words), ``c``.

    Grams of ``longest`` words are the graph's edges, shorter ones stand at the end of
    a piece. Pieces are cut between the words of pairs that are not in ``frequent_pairs``.
    """
    shared = documents.sparkSession.sparkContext.broadcast(frequent_pairs(documents, least, bits))
    words = Words()

    def make(block: pa.RecordBatch) -> dict[str, object]:
        table = shared.value
        made: dict[str, list] = {"lang": [], "gram": [], "size": [], "c": []}
        for lang, ids in words.by_lang(block):
            slot = words.pairs(ids, lang) >> np.uint64(64 - bits)
            held = (table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)
            joined = np.append((held > 0) & (ids[:-1] > 0) & (ids[1:] > 0), False)
            # How many words of the same piece stand from here on, up to the longest gram.
            size, more = (ids > 0).astype(int), joined.copy()
            for k in range(1, longest):
                size += more
                more = more & np.append(joined[k:], np.zeros(min(k, len(joined)), bool))
            for k in range(1, longest + 1):
                starts = np.nonzero(size == k)[0]
                found, counts = np.unique(ids[starts[:, None] + np.arange(k)], axis=0, return_counts=True)
                made["lang"] += [lang] * len(found)
                made["gram"] += [" ".join([words.names[i] for i in g]) for g in found.tolist()]
                made["size"] += [k] * len(found)
                made["c"] += counts.tolist()
        return made

    counted = map_text(documents, ["lang", "text"], "lang string, gram string, size int, c bigint", make)
    return counted.groupBy("lang", "gram", "size").agg(F.sum("c").alias("c"))


def _words(n: Column) -> Column:
    """The first ``n`` words of a gram, the last ``-n`` if ``n`` is negative."""
    return F.call_function("substring_index", F.col("gram"), F.lit(" "), n)


def gram_counts(longest_grams: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """Counts of the grams of every size that occur ``least`` times: ``lang``, ``gram``, ``size``, ``c``.

    A gram's count is the flow out of its node, which is the sum of the longer grams
    that begin with it, and the piece ends that have it.
    """
    level = longest_grams.where(F.col("size") == longest)
    levels = [level]
    for size in range(longest - 1, 0, -1):
        flow = level.select("lang", F.substring_index("gram", " ", size).alias("gram"), F.lit(size).alias("size"), "c")
        ends = longest_grams.where(F.col("size") == size)
        # Each level is read by the next one and by the result.
        level = written(flow.unionByName(ends).groupBy("lang", "gram", "size").agg(F.sum("c").alias("c")))
        levels.append(level)
    return written(reduce(DataFrame.unionByName, levels).where(F.col("c") >= least))


def compacted(grams: DataFrame) -> DataFrame:
    """Grams of two words or more whose flow divides; those inside unary paths are left out.

    A gram goes if one word more, after or before it, gives a gram as frequent. A
    longer gram that holds it as often has such a gram between, so one word suffices.
    """
    fewer = F.col("size") - 1
    longer = grams.where("size > 2")
    ahead = longer.select("lang", _words(fewer).alias("gram"), "c")
    back = longer.select("lang", _words(-fewer).alias("gram"), "c")
    onward = ahead.unionByName(back).groupBy("lang", "gram").agg(F.max("c").alias("onward"))
    joined = grams.where("size > 1").join(onward, ["lang", "gram"], "left")
    return joined.where(F.col("onward").isNull() | (F.col("onward") < F.col("c"))).drop("onward")


def _key(gram: Column) -> Column:
    # No word holds a line end.
    return F.concat(gram, F.lit("\n"), F.col("lang"))


def collocations(
    documents: DataFrame, *, least: int = LEAST, longest: int = LONGEST, top: int = TOP, bits: int = PAIR_BITS
) -> DataFrame:
    """The phrases of each language that hold together most.

    A candidate has 2 to ``longest`` words and occurs ``a >= least`` times within
    pieces of text. Cut after its first k words, its parts occur ``l`` and ``r`` times;
    with ``n`` words in the language, the score is ``floor(1000 * a * n / (l * r))``
    at the cut where that is least (the smallest k of equals). A candidate inside a
    longer one that is as frequent goes. Columns: ``lang``, ``rank``, ``phrase`` (words
    with a blank between), ``a``, ``l``, ``r``, ``n``, ``score``; the first ``top`` of
    each language by falling score, falling ``a`` and the phrase's bytes.

    A null text counts as empty, a null language as ``und``. Repeated rows count as
    often as they occur, texts of any length are read whole. An empty table gives an
    empty one; other columns are not read. Counts below 10**15 are exact.
    """
    counted = written(edges(documents, least, longest, bits))
    # One longest gram starts at each word, so all their counts are the number of words.
    n = counted.groupBy("lang").agg(F.sum("c").alias("n"))
    grams = gram_counts(counted, least, longest)
    held = compacted(grams).select("lang", "gram", "size", F.col("c").alias("a"))
    cuts = held.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("first", _key(_words(F.col("k"))))
    cuts = cuts.withColumn("rest", _key(_words(F.col("k") - F.col("size"))))
    counts = grams.select(_key(F.col("gram")).alias("key"), "c")
    cuts = lookup_join(cuts, counts.select(F.col("key").alias("first"), F.col("c").alias("l")), "first", "inner")
    cuts = lookup_join(cuts, counts.select(F.col("key").alias("rest"), F.col("c").alias("r")), "rest", "inner")
    cuts = lookup_join(cuts, written(n), "lang", "inner")
    # Products may pass 64 bits.
    score = F.expr(
        "(1000 * CAST(a AS DECIMAL(15, 0)) * CAST(n AS DECIMAL(17, 0))) DIV (CAST(l AS DECIMAL(17, 0)) * CAST(r AS DECIMAL(17, 0)))"
    )
    least_cut = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "gram", "a", "n").agg(least_cut)
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "gram")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", F.col("gram").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
