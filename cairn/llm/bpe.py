"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

Each piece that the split pattern finds is encoded separately.  A piece's tree has a leaf per byte position; the leaf of a
live position holds ``rank * width + position`` of the pair that starts there, so that the root is the leftmost pair of
minimum rank.  A merge replaces the left part, kills the right one, and updates three leaves (the merged position, the dead
one, the live neighbour before) and their ancestors: O(log width).  The trees of many distinct pieces stand side by side
as rows of one array, and one round merges once in each; a long piece is merged by itself, by the same tree.

Spark deals out whole documents; nothing is shuffled.  Memory per task: a slice of text, and a piece cache of at most
``CACHE`` entries, which only saves time.

Defined results: null text counts as empty; a very long text is read whole, and a piece of n bytes takes n log n steps; ids are of any type; empty text gives no ids and the digests of no bytes; repeated rows each give
their own row; extra columns of the input do not matter, as only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblock import slices

CACHE = 300_000
STEP = 1 << 15
#: Pieces so long that fewer than FEW trees fit in a step are merged one by one.
FEW = 64
#: The split pattern of the public rank files, and for texts that hold only code points below U+0250 (without number forms and
#: odd separators) a quicker pattern that finds the same pieces.
PUBLIC_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_LATIN = re.compile(rf" ?[{_LETTERS}]++|'(?:[stmd]|re|ve|ll)| ?[0-9]++| ?[^\s{_LETTERS}0-9]++|\s+(?!\S)|\s+").findall
_NOT_LATIN = re.compile("[\x1c-\x1f\x85²³¹¼½¾ɐ-\U0010ffff]").search
_INF = np.int64(1) << np.int64(62)
_NONE = np.int64(1) << np.int64(40)


class Codec:
    """Ranks, the table of mergeable pairs, and the pieces encoded so far."""

    def __init__(self, ranks_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks_file.splitlines())}
        self.general = regex.compile(pattern).findall
        self.latin = _LATIN if pattern == PUBLIC_PATTERN else self.general
        self.token = {str(rank): token for token, rank in self.ranks.items()}
        self.byte_rank = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.known: dict[str, str] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the pair of ids, _NONE where they do not merge."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def merged(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece after all its merges."""
        out: list = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            by_width.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, rows in by_width.items():
            step = max(1, STEP // width)
            if step < FEW:
                for i in rows:
                    out[i] = self._merge_long(pieces[i], width)
                continue
            for k in range(0, len(rows), step):
                some = rows[k : k + step]
                for i, ids in zip(some, self._merge_rows([pieces[i] for i in some], width)):
                    out[i] = ids
        return out

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[list[int]]:
        n = len(pieces)
        length = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        position = np.arange(width)
        live = position < length[:, None]
        ids = np.where(live, self.byte_rank[raw], -1)
        after = np.broadcast_to(position + 1, (n, width)).copy()
        before = np.broadcast_to(position - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), _INF)
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        pair = (rank < _NONE) & live[:, 1:]
        tree[:, width : 2 * width - 1] = np.where(pair, rank * width + position[:-1], _INF)
        low = width
        while low > 1:
            np.minimum(tree[:, low : 2 * low : 2], tree[:, low + 1 : 2 * low : 2], out=tree[:, low // 2 : low])
            low //= 2
        rows = np.flatnonzero(tree[:, 1] < _INF)
        while len(rows):
            root = tree[rows, 1]
            at = root % width
            dead = after[rows, at]
            following = after[rows, dead]
            previous = before[rows, at]
            new = root // width
            ids[rows, at] = new
            ids[rows, dead] = -1
            after[rows, at] = following
            has_next, has_previous = following < length[rows], previous >= 0
            before[rows[has_next], following[has_next]] = at[has_next]
            rank = self._rank(new, ids[rows, np.minimum(following, width - 1)])
            tree[rows, width + at] = np.where(has_next & (rank < _NONE), rank * width + at, _INF)
            tree[rows, width + dead] = _INF
            rank = self._rank(ids[rows, np.maximum(previous, 0)], new)
            tree[rows[has_previous], width + previous[has_previous]] = np.where(rank < _NONE, rank * width + previous, _INF)[has_previous]
            node = np.stack((at, dead, np.where(has_previous, previous, at))) + width
            while node[0, 0] > 1:
                node >>= 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            rows = rows[tree[rows, 1] < _INF]
        flat, ends = ids[ids >= 0].tolist(), np.cumsum((ids >= 0).sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _merge_long(self, piece: bytes, width: int) -> list[int]:
        """One piece by itself: the same tree and links in lists, a merge at a time, as arrays pay only for many rows."""
        n, ranks = len(piece), self.pairs
        ids = [int(self.byte_rank[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none = int(_INF)
        tree = [none] * (2 * width)
        for i in range(n - 1):
            if (rank := ranks.get(ids[i] << 20 | ids[i + 1])) is not None:
                tree[width + i] = rank * width + i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(leaf: int, value: int) -> None:
            node = width + leaf
            if tree[node] == value:
                return
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    return
                tree[node] = least

        while (root := tree[1]) < none:
            new, at = divmod(root, width)
            dead = after[at]
            following, previous = after[dead], before[at]
            ids[at], ids[dead], after[at] = new, -1, following
            put(dead, none)
            rank = None
            if following < n:
                before[following] = at
                rank = ranks.get(new << 20 | ids[following])
            put(at, none if rank is None else rank * width + at)
            if previous >= 0:
                rank = ranks.get(ids[previous] << 20 | new)
                put(previous, none if rank is None else rank * width + previous)
        return [x for x in ids if x >= 0]

    def split(self, text: str) -> list[str]:
        return self.general(text) if _NOT_LATIN(text) else self.latin(text)

    def learn(self, pieces: Iterable[str]) -> None:
        """Put the ids of each piece, in decimal and joined by commas, into the cache."""
        new = [(p, p.encode()) for p in pieces]
        rest = []
        for piece, raw in new:
            rank = self.ranks.get(raw)
            if rank is None:
                rest.append((piece, raw))
            else:
                self.known[piece] = str(rank)
        for (piece, _), ids in zip(rest, self.merged([raw for _, raw in rest])):
            self.known[piece] = ",".join(map(str, ids))

    def encoded(self, texts: list[str]) -> list[str]:
        """Ids of each text, in decimal and joined by commas."""
        split = [self.split(t) for t in texts]
        new = set().union(*split) - self.known.keys()
        if len(self.known) + len(new) > CACHE:
            self.known = {}
            new = set().union(*split)
        self.learn(new)
        known = self.known.__getitem__
        return [",".join(map(known, pieces)) for pieces in split]

    def decoded(self, ids: str) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.split(","))) if ids else b""


_codecs: dict[str, Codec] = {}


def _codec(ranks_file: bytes, pattern: str) -> Codec:
    """A Python worker keeps its codec from task to task."""
    key = hashlib.sha256(ranks_file + pattern.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks_file, pattern)
    return _codecs[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, ids: bool = True) -> DataFrame:
    """Rows ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, the ids as ``array<int>``.

    The rank file is read once on the driver and broadcast: its size is that of the vocabulary, whatever the corpus.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())
    key_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                encoded = codec.encoded([t or "" for t in part.column("text").to_pylist()])
                columns = {
                    "doc_id": part.column("doc_id"),
                    "n_tokens": pa.array([x.count(",") + 1 if x else 0 for x in encoded], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in encoded], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(codec.decoded(x)).hexdigest() for x in encoded], pa.string()),
                }
                if ids:
                    columns["ids"] = pa.array([np.fromstring(x, np.int32, sep=",") if x else np.zeros(0, np.int32) for x in encoded], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id {key_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Adds ``decoded``, the bytes of the array ``ids``; null ids give no bytes."""
    ranks = encoded.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())

    @F.pandas_udf("binary")
    def joined(ids: pd.Series) -> pd.Series:
        codec = _codec(ranks.value, pattern)
        return ids.map(lambda x: codec.decoded(",".join(map(str, x))) if x is not None else b"")

    return encoded.withColumn("decoded", joined("ids"))
