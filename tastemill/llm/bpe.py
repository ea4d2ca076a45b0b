"""Byte-level BPE: encoding by a segment tree over pair ranks, and decoding.

The merges of one pre-token are found with a segment tree whose leaves hold the
ranks of adjacent pairs. A leaf's key is ``rank * width + position``, so the
root is the leftmost pair of the lowest rank. A merge changes three leaves, each
with logarithmically many parents, until no pair with a rank is left.

Trees of many pre-tokens of similar length are kept as the rows of one array
and advance together; a very long pre-token has a tree of its own.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tastemill.llm.common import map_text

# Fixed value: the pattern of byte-level pre-tokens, as published with the vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Pre-tokens up to this many bytes share an array of trees.
WIDEST = 64
# Pre-tokens whose ids a worker remembers before it starts anew.
REMEMBERED = 700_000
NONE = np.int64(1) << 50


def byte_symbols() -> list[str]:
    """The printable character by which vocabulary files write each byte."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


@dataclass
class Vocabulary:
    """What encoding and decoding need of a vocabulary file; a few MB, whatever the corpus."""

    byte_ids: np.ndarray
    pairs: np.ndarray  # left id * size + right id, sorted
    ranks: np.ndarray
    merged: np.ndarray
    size: int
    tokens: list[bytes]
    special: dict[str, int]
    by_pair: dict[int, tuple[int, int]] = field(repr=False)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """Read a ``tokenizers`` JSON file of kind byte-level BPE."""
        with open(path, encoding="utf-8") as source:
            content = json.load(source)
        vocab = content["model"]["vocab"]
        special = {t["content"]: t["id"] for t in content["added_tokens"]}
        size = max([*vocab.values(), *special.values()]) + 1
        symbols = byte_symbols()
        as_byte = {c: b for b, c in enumerate(symbols)}
        tokens = [b""] * size
        for token, i in vocab.items():
            tokens[i] = bytes(as_byte[c] for c in token)
        for token, i in special.items():
            tokens[i] = token.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in content["model"]["merges"]]
        by_pair = {}
        for rank, (a, b) in enumerate(merges):
            by_pair.setdefault(vocab[a] * size + vocab[b], (rank, vocab[a + b]))
        pairs = np.array(sorted(by_pair), dtype=np.int64)
        return cls(
            byte_ids=np.array([vocab[c] for c in symbols], dtype=np.int64),
            pairs=pairs,
            ranks=np.array([by_pair[p][0] for p in pairs.tolist()], dtype=np.int64),
            merged=np.array([by_pair[p][1] for p in pairs.tolist()], dtype=np.int64),
            size=size,
            tokens=tokens,
            special=special,
            by_pair=by_pair,
        )

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair in ``pairs``, or -1."""
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, at, -1)


def encode_rows(pieces: list[bytes], width: int, vocabulary: Vocabulary) -> list[bytes]:
    """Ids of pre-tokens of at most ``width`` bytes (a power of two), as little-endian bytes."""
    n = len(pieces)
    flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
    lengths = np.fromiter(map(len, pieces), np.int64, n)
    position = np.arange(width)
    alive = position < lengths[:, None]
    ids = np.where(alive, vocabulary.byte_ids[flat], -1)
    after = np.where(position + 1 < lengths[:, None], position + 1, width)
    before = np.broadcast_to(position - 1, (n, width)).copy()

    def keys(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        found = vocabulary.lookup(left, right)
        return np.where(found >= 0, vocabulary.ranks[found] * width + at, NONE)

    tree = np.full((n, 2 * width), NONE)
    pair = np.zeros((n, width), bool)
    pair[:, :-1] = alive[:, 1:]
    rows, cols = np.nonzero(pair)
    tree[rows, width + cols] = keys(ids[rows, cols], ids[rows, cols + 1], cols)
    level = width
    while level > 1:
        level //= 2
        tree[:, level : 2 * level] = np.minimum(
            tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2]
        )

    def put(rows: np.ndarray, at: np.ndarray, key: np.ndarray) -> None:
        node = at + width
        tree[rows, node] = key
        while node.size and node[0] > 1:
            node = node // 2
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    rows = np.nonzero(tree[:, 1] < NONE)[0]
    while rows.size:
        left = tree[rows, 1] % width
        right = after[rows, left]
        found = vocabulary.lookup(ids[rows, left], ids[rows, right])
        ids[rows, left] = vocabulary.merged[found]
        beyond = after[rows, right]
        after[rows, left] = beyond
        alive[rows, right] = False
        put(rows, right, NONE)
        has = beyond < width
        key = np.full(rows.size, NONE)
        key[has] = keys(ids[rows[has], left[has]], ids[rows[has], beyond[has]], left[has])
        before[rows[has], beyond[has]] = left[has]
        put(rows, left, key)
        previous = before[rows, left]
        has = previous >= 0
        r, p = rows[has], previous[has]
        put(r, p, keys(ids[r, p], ids[r, left[has]], p))
        rows = rows[tree[rows, 1] < NONE]

    kept = ids[alive].astype("<u4").tobytes()
    ends = np.cumsum(alive.sum(1)) * 4
    starts = np.concatenate([[0], ends[:-1]])
    return [kept[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def encode_long(piece: bytes, vocabulary: Vocabulary) -> bytes:
    """Ids of one pre-token of any length."""
    ids = vocabulary.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
    n, size, by_pair = len(ids), vocabulary.size, vocabulary.by_pair
    width = 1 << max(n - 1, 1).bit_length()
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    none = int(NONE)

    def key(a: int, b: int) -> int:
        found = by_pair.get(ids[a] * size + ids[b]) if a >= 0 and b >= 0 else None
        return none if found is None else found[0] * width + a

    tree = [none] * (2 * width)
    for i in range(n - 1):
        tree[width + i] = key(i, i + 1)
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(at: int, value: int) -> None:
        node = at + width
        tree[node] = value
        while node > 1:
            node //= 2
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                break
            tree[node] = least

    while tree[1] < none:
        left = tree[1] % width
        right = after[left]
        ids[left] = by_pair[ids[left] * size + ids[right]][1]
        ids[right] = -1
        after[left] = beyond = after[right]
        if beyond >= 0:
            before[beyond] = left
        put(right, none)
        put(left, key(left, beyond))
        if before[left] >= 0:
            put(before[left], key(before[left], left))
    return np.array([i for i in ids if i >= 0], dtype="<u4").tobytes()


class Encoder:
    """Encodes texts; remembers the ids of pre-tokens it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.find = regex.compile(PIECES).findall
        self.split = regex.compile("|".join(map(regex.escape, vocabulary.special))).split if vocabulary.special else None
        self.known: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        by_width: dict[int, list[str]] = {}
        for piece in pieces:
            n = len(piece.encode())
            if n > WIDEST:
                self.known[piece] = encode_long(piece.encode(), self.vocabulary)
            else:
                by_width.setdefault(max(2, 1 << (n - 1).bit_length()), []).append(piece)
        for width, group in by_width.items():
            for start in range(0, len(group), 50_000):
                part = group[start : start + 50_000]
                self.known.update(zip(part, encode_rows([p.encode() for p in part], width, self.vocabulary)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        special = self.vocabulary.special
        cut = []
        for text in texts:
            if special and any(s in text for s in special):
                marks = regex.findall("|".join(map(regex.escape, special)), text)
                cut.append(([self.find(part) for part in self.split(text)], marks))
            else:
                cut.append(([self.find(text)], ()))
        missing: set[str] = set()
        for parts, _ in cut:
            for pieces in parts:
                missing.update(pieces)
        self.learn(missing.difference(self.known))
        ids, known = [], self.known.__getitem__
        for parts, marks in cut:
            out = b"".join(map(known, parts[0]))
            for mark, pieces in zip(marks, parts[1:]):
                out += special[mark].to_bytes(4, "little") + b"".join(map(known, pieces))
            ids.append(out)
        return ids

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        tokens = self.vocabulary.tokens.__getitem__
        return b"".join(map(tokens, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode_documents(
    documents: DataFrame, vocabulary_path: str, *, keep_ids: bool = False, id_column: str = "doc_id"
) -> DataFrame:
    """Encode every whole text, decode it again, and return digests of both.

    Columns: the id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, with
    ``keep_ids``, ``ids`` (little-endian unsigned 32-bit integers). A null text
    counts as empty and has no tokens; repeated rows stay repeated, null ids stay
    null, and an empty table gives an empty one. Other columns are not read. The
    vocabulary is broadcast: its size doesn't depend on the documents.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(vars(Vocabulary.read(vocabulary_path)))
    state: list[Encoder] = []

    def make(block: pa.RecordBatch) -> dict[str, object]:
        if not state:
            state.append(Encoder(Vocabulary(**shared.value)))
        encoder = state[0]
        texts = [t or "" for t in block.column("text").to_pylist()]
        ids = encoder.encode(texts)
        made = {
            id_column: block.column(id_column),
            "n_tokens": [len(i) // 4 for i in ids],
            "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
            "decoded_sha256": [hashlib.sha256(encoder.decode(i).encode()).hexdigest() for i in ids],
        }
        return made | ({"ids": ids} if keep_ids else {})

    kind = documents.schema[id_column].dataType.simpleString()
    schema = f"{id_column} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_text(documents, [id_column, "text"], schema + ", ids binary" * keep_ids, make)
