"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton is built from the normalised benchmark items. Training words are
streamed through it; at each word it knows the longest item passage that ends
there. A word inside any occurrence of a window (``window`` consecutive item
words, or the whole of a shorter item) is hit.

Items are dealt into blocks of a bounded number of words, and tasks build their
automata. One automaton at a time passes through the driver, as bytes, and is broadcast; the
documents are streamed through one after the other, and what each finds is kept with
the rows. Before the streaming, arrays rule out stretches that can't hold a window: each two
neighbouring words of a window are neighbours in an item.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastemill.llm.common import map_text, saved, written

# Over UTF-8: bytes from 0x80 on belong to words.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
# Item words in one automaton.
BLOCK_WORDS = 500_000
# Longer items are cut into pieces that overlap by a window less one word.
PIECE_WORDS = 20_000


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8, A-Z in lower case (``bytes.lower`` changes nothing else)."""
    return WORD.findall(text.encode().lower()) if text else []


class Automaton:
    """Generalised suffix automaton of word sequences, each with an item id.

    ``pieces`` are (item id, words, whole); the words of one item may come in
    overlapping pieces, and only a whole item can be shorter than a window.
    """

    def __init__(self, pieces: list[tuple[object, list[bytes], bool]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.items = [p[0] for p in pieces]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = array("q", [-1]), array("q", [0])
        coded = [[self.ids.setdefault(w, len(self.ids)) for w in words] for _, words, _ in pieces]
        for codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        # Windows by the state that holds them: (length, items).
        self.ends: dict[int, dict[int, set[int]]] = {}
        shortest = window
        for k, codes in enumerate(coded):
            size = min(window, len(codes))
            shortest = min(shortest, size or window)
            state = length = 0
            for c in codes:
                state, length = self.next[state][c], length + 1
                if length >= size:
                    holder = self._holder(state, size)
                    self.ends.setdefault(holder, {}).setdefault(size, set()).add(k)
        self.shortest = shortest
        # The nearest state with windows on the way to the root, itself included.
        self.marked = array("q", [-1]) * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.marked[state] = state if state in self.ends else self.marked[self.link[state]]
        pairs = {a * len(self.ids) + b for codes in coded for a, b in zip(codes, codes[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.single = {codes[0] for codes in coded if len(codes) == 1 and window >= 1}

    def _extend(self, last: int, c: int) -> int:
        """Add a word after ``last``; the state of the longer sequence."""
        following, link, length = self.next, self.link, self.length
        if c in following[last]:
            q = following[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = new
            p = link[p]
        if p >= 0:
            q = following[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _holder(self, state: int, size: int) -> int:
        """The state of the suffix of ``size`` words."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def stream(self, codes: list[int], start: int, hit: np.ndarray, found: set[int]) -> None:
        """Follow coded words; mark hit words from ``start`` on and collect pieces with windows."""
        following, link, length, marked, ends = self.next, self.link, self.length, self.marked, self.ends
        state = matched = 0
        for i, c in enumerate(codes, start + 1):
            while state and c not in following[state]:
                state = link[state]
                matched = length[state]
            step = following[state].get(c)
            if step is None:
                continue
            state, matched = step, matched + 1
            holder = marked[state]
            while holder > 0:
                for size, pieces in ends[holder].items():
                    if size <= matched:
                        hit[i - size : i] = True
                        found.update(pieces)
                holder = marked[link[holder]]

    def search(self, texts: list[list[bytes]]) -> list[tuple[np.ndarray, set[object]]]:
        """For each text's words: which are hit, and the items with windows in it."""
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.concatenate([[0], np.cumsum(counts)])
        get = self.ids.get
        codes = np.fromiter((get(w, -1) for words in texts for w in words), np.int64, int(starts[-1]))
        hit = np.zeros(len(codes), bool)
        found: dict[int, set[int]] = {}
        if not len(codes) or not self.ids:
            return [(hit[a:b], set()) for a, b in zip(starts[:-1], starts[1:])]
        # joined[i]: word i and the one before it are neighbours in an item and in a text.
        both = (codes[1:] >= 0) & (codes[:-1] >= 0)
        wanted = codes[:-1] * len(self.ids) + codes[1:]
        joined = np.zeros(len(codes) + 1, bool)
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, wanted[both]), len(self.pairs) - 1)
            joined[1:-1][both] = self.pairs[at] == wanted[both]
        joined[starts] = False
        edges = np.flatnonzero(np.diff(np.concatenate([[0], joined.view(np.int8)])))
        firsts, lasts = edges[::2] - 1, edges[1::2]
        long = lasts - firsts >= max(2, self.shortest)
        stretches = list(zip(firsts[long].tolist(), lasts[long].tolist()))
        if self.single:
            alone = np.flatnonzero(np.isin(codes, np.array(sorted(self.single))))
            stretches += [(i, i + 1) for i in alone.tolist()]
        doc_of = np.searchsorted(starts, [a for a, _ in stretches], "right") - 1 if stretches else []
        for (a, b), doc in zip(stretches, doc_of):
            self.stream(codes[a:b].tolist(), a, hit, found.setdefault(int(doc), set()))
        items = self.items
        return [
            (hit[a:b], {items[k] for k in found.get(d, ())})
            for d, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist()))
        ]


def item_pieces(benchmark: DataFrame, window: int, item_column: str) -> DataFrame:
    """Items as (``item``, ``words``, ``whole``) in overlapping pieces of bounded length."""

    def make(block: pa.RecordBatch) -> dict[str, object]:
        item, words, whole = [], [], []
        for name, text in zip(block.column(0).to_pylist(), block.column(1).to_pylist()):
            found = words_of(text)
            for start in range(0, max(1, len(found) - window + 1), PIECE_WORDS):
                piece = found[start : start + PIECE_WORDS + window - 1]
                if piece and name is not None:
                    item.append(str(name))
                    words.append(piece)
                    whole.append(len(found) <= PIECE_WORDS)
        return {"item": item, "words": words, "whole": whole}

    return map_text(benchmark, [item_column, "text"], "item string, words array<binary>, whole boolean", make)


def item_automata(benchmark: DataFrame, window: int, block_words: int, item_column: str) -> tuple[DataFrame, int]:
    """The automata as ``(block, automaton)`` with pickled bytes, each built in a task, and the number of blocks.

    Repeated pieces count once, so equal items don't gather in one block. A
    block without pieces has no row.
    """
    pieces = saved(item_pieces(benchmark, window, item_column).distinct())
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    n = int(total // block_words) + 1

    def build(block: pa.Table) -> pa.Table:
        rows = sorted(zip(*(block.column(c).to_pylist() for c in ("item", "words", "whole"))))
        made = pickle.dumps(vars(Automaton(rows, window)), pickle.HIGHEST_PROTOCOL)
        return pa.table({"block": block.column("block")[:1], "automaton": pa.array([made], pa.binary())})

    numbered = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(n)).cast("int"))
    return saved(numbered.groupBy("block").applyInArrow(build, "block int, automaton binary")), n


def _streamed(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int,
    block_words: int,
    item_column: str,
    schema: T.StructType | str,
    finish: Callable[[pa.RecordBatch, list[list[bytes]], list[np.ndarray], list[set[str]]], dict[str, object]],
) -> DataFrame:
    """``finish`` of blocks of documents, their words, which of these are hit, and the items found.

    All automata but the last are followed in passes of their own; the spans and
    items found so far are written down with the rows, and the automaton is
    released before the next one is read.
    """
    spark = documents.sparkSession
    automata, n = item_automata(benchmark, window, block_words, item_column)
    columns, hits_name, items_name = documents.columns, "__hit_spans", "__hit_items"
    carried = T.StructType([
        *documents.schema.fields,
        T.StructField(hits_name, T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField(items_name, T.ArrayType(T.StringType())),
    ])

    def searched(shared: object, held: list, block: pa.RecordBatch) -> tuple[list, list, list]:
        # Rebuilt once in each task.
        if not held:
            held.append(_unpickled(shared.value))
        texts = [words_of(t) for t in block.column("text").to_pylist()]
        hits = [np.zeros(len(t), bool) for t in texts]
        items: list[set] = [set() for _ in texts]
        if hits_name in block.schema.names:
            for hit, found, spans, names in zip(hits, items, block.column(hits_name).to_pylist(), block.column(items_name).to_pylist()):
                found.update(names)
                for first, end in spans:
                    hit[first:end] = True
        for d, (hit, found) in enumerate(held[0].search(texts) if held[0] else ()):
            hits[d] |= hit
            items[d] |= found
        return texts, hits, items

    def passing(shared: object) -> Callable[[pa.RecordBatch], dict[str, object]]:
        held: list = []

        def make(block: pa.RecordBatch) -> dict[str, object]:
            _, hits, items = searched(shared, held, block)
            made = {c: block.column(c) for c in columns}
            return {**made, hits_name: [[list(s) for s in _spans(h)] for h in hits], items_name: [sorted(s) for s in items]}

        return make

    def last(shared: object) -> Callable[[pa.RecordBatch], dict[str, object]]:
        held: list = []
        return lambda block: finish(block, *searched(shared, held, block))

    rows = documents
    for i in range(n):
        found = automata.where(F.col("block") == i).first()
        shared = spark.sparkContext.broadcast(bytes(found["automaton"]) if found else b"")
        if i == n - 1:
            return map_text(rows, rows.columns, schema, last(shared))
        rows = written(map_text(rows, rows.columns, carried, passing(shared)))
        shared.unpersist()


def _unpickled(data: bytes) -> Automaton | None:
    """The automaton of pickled bytes, None of no bytes."""
    if not data:
        return None
    automaton = Automaton.__new__(Automaton)
    vars(automaton).update(pickle.loads(data))
    return automaton


def _spans(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).tolist()
    return list(zip(edges[::2], edges[1::2]))


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    id_column: str = "doc_id",
    item_column: str = "item_id",
) -> DataFrame:
    """Hit words and matching items of every document.

    Columns: the id, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` (the
    item ids sorted as strings, comma-joined), ``contaminated``. A null or
    wordless text has no words and no hits; null and wordless items have no
    windows, and a null item id names no item. Repeated rows of either table
    stay what they are. Without documents the result is empty, without items
    nothing is hit. Other columns are not read.
    """
    kind = documents.schema[id_column].dataType.simpleString()

    def finish(block: pa.RecordBatch, texts: list, hits: list, items: list) -> dict[str, object]:
        n_hit = [int(h.sum()) for h in hits]
        return {
            id_column: block.column(id_column),
            "n_words": [len(t) for t in texts],
            "n_hit": n_hit,
            "n_items": [len(s) for s in items],
            "items_sha256": [hashlib.sha256(",".join(sorted(s)).encode()).hexdigest() for s in items],
            "contaminated": [n > 0 for n in n_hit],
        }

    schema = f"{id_column} {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    return _streamed(documents.select(id_column, "text"), benchmark, window, block_words, item_column, schema, finish)


def decontaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = WINDOW,
    most_coverage: float = 0.5,
    block_words: int = BLOCK_WORDS,
    item_column: str = "item_id",
) -> DataFrame:
    """``documents`` without benchmark passages, in the columns they had.

    Hit spans are cut out of the text, with the white space before them; a
    document of which more than ``most_coverage`` of the words is hit is
    removed. Texts without hits, null ones included, stay unchanged. ``n_chars``,
    if there, is set to the new number of code points. Clashing extra columns
    pass through.
    """
    names = documents.columns
    count = next((c for c in names if c == "n_chars"), None)

    def cleaned(text: str, hit: np.ndarray) -> str | None:
        raw = text.encode()
        places = [m.span() for m in WORD.finditer(raw.lower())]
        if hit.sum() > most_coverage * len(places):
            return None
        kept, at = [], 0
        for first, end in _spans(hit):
            kept.append(raw[at : places[first][0]].rstrip())
            at = places[end - 1][1]
        return b"".join([*kept, raw[at:]]).strip().decode()

    def finish(block: pa.RecordBatch, texts: list, hits: list, items: list) -> dict[str, object]:
        whole = block.column("text").to_pylist()
        new, keep = [], []
        for text, hit in zip(whole, hits):
            result = cleaned(text, hit) if hit.any() else text
            keep.append(result is not None or text is None)
            new.append(result)
        chosen = block.filter(pa.array(keep, pa.bool_()))
        made = {c: chosen.column(c) for c in names}
        made["text"] = [t for t, k in zip(new, keep) if k]
        if count:
            old = chosen.column(count).to_pylist()
            same = [bool(h.any()) for h, k in zip(hits, keep) if k]
            made[count] = [len(t) if changed else n for t, n, changed in zip(made["text"], old, same)]
        return made

    return _streamed(documents, benchmark, window, block_words, item_column, documents.schema, finish)
