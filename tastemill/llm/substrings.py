"""Substring deduplication on a compacted De Bruijn graph of word k-mers.

Nodes are word k-mers. Only the node of the least hash among all nodes inside
a window of ``span`` words is kept as the window's anchor; equal windows have
equal anchors, wherever they stand. Consecutive windows with one anchor form an
edge: a path of the graph that doesn't branch, taken as a whole. So a text of n
words gives about 2n / (span - k + 2) edges instead of n.

Edges are counted and joined by their anchor:

* an anchor met once: nothing in its windows repeats;
* an edge with the same words met again: all its windows repeat, the path is
  compact and taken whole;
* an anchor at which paths branch: the windows of one edge of each kind are
  looked up by their source coordinates and compared one by one.

Groups are only ever counted and joined, so one passage in a third of all texts
is no single task; what repeats most is what compacts best.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.llm.common import map_text, written

SPAN = 35
K = 8
BASE = np.uint64(0x9E3779B97F4A7C15)
REMEMBERED = 500_000


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in UTF-8; ``bytes.split`` cuts at exactly these."""
    return text.encode().split() if text else []


class Hasher:
    """Hashes words, remembering them, and sequences of words."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def words(self, texts: list[list[bytes]]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        missing: set[bytes] = set()
        for words in texts:
            missing.update(words)
        for word in missing.difference(known):
            known[word] = xxhash.xxh64_intdigest(word)
        total = sum(map(len, texts))
        return np.fromiter((h for words in texts for h in map(known.__getitem__, words)), np.uint64, total)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit sums, so that their order is that of a hash."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def sequence_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` words from each word on."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n].copy()
    for j in range(1, size):
        total *= BASE
        total += hashes[j : n + j]
    return mixed(total)


def edges_of(hashes: np.ndarray, starts: np.ndarray, span: int, k: int) -> dict[str, np.ndarray]:
    """Edges of texts whose word hashes stand one after the other from ``starts`` on."""
    windows = len(hashes) - span + 1
    if windows <= 0:
        none = np.zeros(0, np.int64)
        return {"doc": none, "start": none, "size": none, "anchor": none, "content": none}
    node = sequence_hashes(hashes, k)
    width = span - k + 1
    view = np.lib.stride_tricks.sliding_window_view(node, width)
    anchor = np.empty(windows, np.int64)
    for a in range(0, windows, 100_000):
        anchor[a : a + 100_000] = view[a : a + 100_000].argmin(1)
    anchor += np.arange(windows)
    doc = np.searchsorted(starts, np.arange(windows), "right") - 1
    inside = np.arange(windows) + span <= np.append(starts, len(hashes))[doc + 1]
    new = np.ones(windows, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(inside & new)
    # Within a text, windows that are inside come before those that aren't.
    ends = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
    whole = sequence_hashes(hashes, span)
    size = ends - first + 1
    content = mixed(whole[first] * np.uint64(3) + whole[ends] * BASE + size.astype(np.uint64))
    return {
        "doc": doc[first],
        "start": first - starts[doc[first]],
        "size": size,
        "anchor": node[anchor[first]].view(np.int64),
        "content": content.view(np.int64),
    }


def _block_words(texts: list[str | None]) -> tuple[list[list[bytes]], np.ndarray]:
    words = [words_of(t) for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    return words, np.concatenate([[0], np.cumsum(counts)[:-1]])


def edges(documents: DataFrame, span: int, k: int) -> DataFrame:
    """All edges: the text's ``key``, the first window's ``start``, the number of windows ``size``."""
    hasher = Hasher()

    def make(block: pa.RecordBatch) -> dict[str, object]:
        words, starts = _block_words(block.column("text").to_pylist())
        found = edges_of(hasher.words(words), starts, span, k)
        keys = np.array(block.column("key").to_pylist(), np.int64)
        return {"key": keys[found["doc"]] if len(keys) else keys, **{c: found[c] for c in ("start", "size", "anchor", "content")}}

    return map_text(documents, ["key", "text"], "key bigint, start int, size int, anchor bigint, content bigint", make)


def _kept(words: list[bytes], ranges: list[tuple[int, int]], span: int) -> tuple[int, bytes]:
    """How many words the windows of ``ranges`` (start, size) cover, and the others joined."""
    steps = np.zeros(len(words) + 1, np.int64)
    for start, size in ranges:
        steps[start] += 1
        steps[start + size - 1 + span] -= 1
    covered = np.cumsum(steps[:-1]) > 0
    return int(covered.sum()), b" ".join([w for w, c in zip(words, covered.tolist()) if not c])


def without_repeats(
    documents: DataFrame, *, span: int = SPAN, k: int = K, keep_text: bool = False, id_column: str = "doc_id"
) -> DataFrame:
    """Cut every word out of a text that a repeated window of ``span`` words covers.

    A window repeats if its word sequence also starts anywhere else, in the same
    text or another; windows are judged on the input. Columns: the id,
    ``n_words``, ``n_removed``, ``kept_sha256`` and, with ``keep_text``, ``kept``
    (the kept words, joined by one space). A null or blank text has no words and
    keeps the empty string. Repeated rows stay, and repeat each other; null ids
    stay null; an empty table gives an empty one; other columns are not read.

    Only edges and the texts with branches that are still undecided are written
    between the steps; every text is shuffled once.
    """
    keyed = documents.select(F.col(id_column).alias("id"), "text", F.xxhash64(id_column, "text").alias("key"))
    found = written(edges(keyed, span, k))
    met = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    again = written(found.join(met, "anchor", "left_semi"))
    kinds = again.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "start", "size")).alias("one")
    )
    branches = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    compact = again.join(kinds.where("n > 1").select("anchor", "content"), ["anchor", "content"], "left_semi")
    # Of each kind of edge at a branch, one is compared; the windows of those met once are undecided.
    compared = kinds.join(branches, "anchor", "left_semi").select("one.key", "anchor", "one.start", "one.size", "n")
    parts = compact.select("key", F.struct("start", "size", F.lit(None).cast("bigint").alias("anchor"), F.lit(False).alias("open")).alias("part"))
    parts = parts.unionByName(
        compared.select("key", F.struct("start", "size", "anchor", (F.col("n") == 1).alias("open")).alias("part"))
    )
    parts = parts.groupBy("key").agg(F.collect_list("part").alias("parts"))
    hasher = Hasher()

    def judge(block: pa.RecordBatch) -> dict[str, object]:
        """Final rows of texts without undecided windows; the others wait, with their windows."""
        out: dict[str, list] = {c: [] for c in ("n_words", "n_removed", "kept", "rest", "ranges", "windows")}
        for text, parts in zip(block.column("text").to_pylist(), block.column("parts").to_pylist()):
            words = words_of(text)
            compact, windows, waits = [], [], False
            at_branches = [p for p in parts or () if p["anchor"] is not None]
            if at_branches:
                whole = sequence_hashes(hasher.words([words]), span).view(np.int64)
                for p in at_branches:
                    waits |= p["open"]
                    places = range(p["start"], p["start"] + p["size"])
                    windows += [(p["anchor"], whole[i], i) for i in places]
            compact = [(p["start"], p["size"]) for p in parts or () if p["anchor"] is None]
            removed, kept = _kept(words, compact, span) if compact and not waits else (0, b" ".join(words))
            out["n_words"].append(len(words))
            out["n_removed"].append(removed)
            out["kept"].append(None if waits else kept.decode() if keep_text else hashlib.sha256(kept).hexdigest())
            out["rest"].append(text if waits else None)
            out["ranges"].append(compact if waits else None)
            out["windows"].append(windows)
        return out | {"id": block.column("id"), "key": block.column("key")}

    kind = documents.schema[id_column].dataType.simpleString()
    judged = written(
        map_text(
            keyed.join(parts, "key", "left"),
            ["id", "key", "text", "parts"],
            f"id {kind}, key bigint, n_words bigint, n_removed bigint, kept string, rest string, "
            "ranges array<struct<start:int,size:int>>, windows array<struct<anchor:bigint,window:bigint,place:int>>",
            judge,
        )
    )
    windows = judged.select("key", F.explode("windows").alias("w")).select("key", "w.*")
    twice = windows.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    places = windows.join(twice, ["anchor", "window"], "left_semi").groupBy("key").agg(F.collect_set("place").alias("places"))
    waiting = judged.where("kept is null").select("id", "key", F.col("rest").alias("text"), "ranges").join(places, "key", "left")

    def finish(block: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {c: [] for c in ("n_words", "n_removed", "kept")}
        columns = [block.column(c).to_pylist() for c in ("text", "ranges", "places")]
        for text, ranges, places in zip(*columns):
            words = words_of(text)
            covered = [(r["start"], r["size"]) for r in ranges] + [(p, 1) for p in places or ()]
            removed, kept = _kept(words, covered, span)
            out["n_words"].append(len(words))
            out["n_removed"].append(removed)
            out["kept"].append(kept.decode() if keep_text else hashlib.sha256(kept).hexdigest())
        return out | {"id": block.column("id")}

    ended = map_text(
        waiting,
        ["id", "text", "ranges", "places"],
        f"id {kind}, n_words bigint, n_removed bigint, kept string",
        finish,
    )
    rows = judged.where("kept is not null").select(*ended.columns).unionByName(ended)
    digest = F.sha2("kept", 256) if keep_text else F.col("kept")
    columns = [F.col("id").alias(id_column), "n_words", "n_removed", digest.alias("kept_sha256")]
    return rows.select(*columns, *(["kept"] if keep_text else []))
