"""Encoding with a public byte-level BPE vocabulary.

Text is cut into pieces by the vocabulary's pattern; each distinct piece is encoded once in a
worker. Its bytes are the leaves of a segment tree whose inner nodes hold the smallest (rank,
position) of the pairs below them, so the root is the leftmost pair of lowest rank. A merge changes
the pairs of the live neighbours only: a few point updates of logarithmic cost. The trees of all new
pieces of a size class are advanced together as rows of one array; few very long pieces are advanced
one after the other.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies and the one that is used; both are parameters of every operator.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
#: Fixed value: the pattern that cuts text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A worker keeps the ids of at most so many distinct pieces of at most so many characters.
CACHE_PIECES, CACHE_CHARS = 400_000, 64
#: Fewer pieces than this of a size class are encoded one by one.
ROWS_AT_ONCE = 12
NONE = np.int64(1) << 62


def byte_letters() -> dict[int, str]:
    """The printable letter of each byte in byte-level vocabularies: itself if printable, else the next free code from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


class Bpe:
    """A byte-level BPE vocabulary; ``encode`` gives the ids of a text without special tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        letters = byte_letters()
        self.bytes = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] << 20 | vocab[b]] = (rank, vocab[a + b])
        self._hash()
        self.cut = regex.compile(PATTERN).findall
        self.cache: dict[str, list[int]] = {}

    def _hash(self) -> None:
        """Pairs in an open-addressing table, for looking up many at once."""
        self.bits = max(4, (4 * len(self.merges)).bit_length())
        self.table = np.full(1 << self.bits, -1, dtype=np.int64)
        self.rank = np.zeros(1 << self.bits, dtype=np.int64)
        self.merged = np.zeros(1 << self.bits, dtype=np.int64)
        mask, probes = (1 << self.bits) - 1, 1
        for key, (rank, merged) in self.merges.items():
            i, n = self._slot(key), 1
            while self.table[i] >= 0:
                i, n = (i + 1) & mask, n + 1
            self.table[i], self.rank[i], self.merged[i] = key, rank, merged
            probes = max(probes, n)
        self.probes = probes

    def _slot(self, key: int) -> int:
        return ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if there is no merge) and merged id of pairs; ids below 0 never merge."""
        key = left << 20 | right
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        rank = np.full(len(key), NONE, dtype=np.int64)
        merged = np.zeros(len(key), dtype=np.int64)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        for _ in range(self.probes):
            if not len(todo):
                break
            slot = at[todo]
            held = self.table[slot]
            hit = held == key[todo]
            found = todo[hit]
            rank[found], merged[found] = self.rank[slot[hit]], self.merged[slot[hit]]
            todo = todo[~hit & (held >= 0)]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return rank, merged

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece."""
        out: list[list[int]] = [[] for _ in pieces]
        classes: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if len(p) == 1:
                out[i] = [int(self.bytes[p[0]])]
            elif p:
                classes.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(i)
        for width, rows in classes.items():
            if len(rows) < ROWS_AT_ONCE or width > 4096:
                for i in rows:
                    out[i] = self.encode_one(pieces[i])
                continue
            step = max(ROWS_AT_ONCE, (1 << 21) // width)
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                for i, ids in zip(part, self._many([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    def _many(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """Segment trees of pieces of at most ``width`` bytes (a power of two), one row each."""
        n = len(pieces)
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width)
        sym = self.bytes[raw]
        sym[np.arange(width)[None, :] >= sizes[:, None]] = -1
        shift = width.bit_length()
        low = (1 << shift) - 1
        rank, _ = self.pairs(sym[:, :-1].ravel(), sym[:, 1:].ravel())
        tree = np.full((n, 2 * width), NONE, dtype=np.int64)
        leaves = np.where(rank < NONE, rank << shift | np.tile(np.arange(width - 1), n), NONE)
        tree[:, width : 2 * width - 1] = leaves.reshape(n, width - 1)
        k = width
        while k > 1:
            tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
            k //= 2
        nxt = np.tile(np.arange(1, width + 1), (n, 1))
        prv = np.tile(np.arange(-1, width - 1), (n, 1))
        rows = np.arange(n)
        levels = width.bit_length() - 1
        while True:
            root = tree[rows, 1]
            rows = rows[root < NONE]
            if not len(rows):
                break
            p = tree[rows, 1] & low
            q = nxt[rows, p]
            _, merged = self.pairs(sym[rows, p], sym[rows, q])
            sym[rows, p] = merged
            sym[rows, q] = -1
            after = nxt[rows, q]
            nxt[rows, p] = after
            inner = after < width
            prv[rows[inner], after[inner]] = p[inner]
            before = prv[rows, p]
            right = np.where(inner, sym[rows, np.minimum(after, width - 1)], -1)
            left = np.where(before >= 0, sym[rows, np.maximum(before, 0)], -1)
            r1, _ = self.pairs(merged, right)
            r0, _ = self.pairs(left, merged)
            tree[rows, width + q] = NONE
            tree[rows, width + p] = np.where(r1 < NONE, r1 << shift | p, NONE)
            has = before >= 0
            tree[rows[has], width + before[has]] = np.where(r0[has] < NONE, r0[has] << shift | before[has], NONE)
            nodes = [width + q, width + p, width + np.where(has, before, p)]
            for _ in range(levels):
                for j in range(3):
                    node = nodes[j] = nodes[j] >> 1
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
        live = sym >= 0
        flat = sym[live].tolist()
        ends = np.cumsum(live.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def encode_one(self, piece: bytes) -> list[int]:
        """The same for one piece, by a scalar segment tree."""
        n = len(piece)
        width = max(2, 1 << (n - 1).bit_length())
        sym = self.bytes[np.frombuffer(piece, dtype=np.uint8)].tolist()
        get = self.merges.get
        none = (1 << 60, 0)
        big = 1 << 62
        shift = width.bit_length()
        low = (1 << shift) - 1
        tree = [big] * (2 * width)
        for i in range(n - 1):
            if m := get(sym[i] << 20 | sym[i + 1]):
                tree[width + i] = m[0] << shift | i
        for k in range(width - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            i += width
            tree[i] = value
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                v = a if a < b else b
                if tree[i] == v:
                    break
                tree[i] = v
                i >>= 1

        while tree[1] < big:
            p = tree[1] & low
            q = nxt[p]
            sym[p] = get(sym[p] << 20 | sym[q], none)[1]
            after = nxt[q]
            nxt[p] = after
            sym[q] = -1
            put(q, big)
            if after < n:
                prv[after] = p
                m = get(sym[p] << 20 | sym[after])
                put(p, m[0] << shift | p if m else big)
            else:
                put(p, big)
            if (before := prv[p]) >= 0:
                m = get(sym[before] << 20 | sym[p])
                put(before, m[0] << shift | before if m else big)
        return [s for s in sym if s >= 0]

    def learn(self, pieces: list[str]) -> dict[str, list[int]]:
        """The cache, after it has all ``pieces``."""
        cache = self.cache
        new = [p for p in set(pieces) if p not in cache]
        if len(cache) + len(new) > CACHE_PIECES:
            cache = self.cache = {}
            new = list(set(pieces))
        if new:
            cache.update(zip(new, self.encode_pieces([p.encode("utf-8", "replace") for p in new])))
        return cache

    def forget_long(self) -> None:
        if len(self.cache) > CACHE_PIECES // 2:
            self.cache = {p: x for p, x in self.cache.items() if len(p) <= CACHE_CHARS}

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for null and empty texts. Strings of special tokens are ordinary text."""
        if not text:
            return []
        pieces = self.cut(text)
        cache = self.learn(pieces)
        return list(chain.from_iterable(map(cache.__getitem__, pieces)))


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """The vocabulary, read once in each process."""
    return Bpe(path)


#: At most so many characters are encoded before rows are handed on.
CHUNK_CHARS = 2_000_000


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > CHUNK_CHARS:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def _each(bpe: Bpe, texts: list[str | None]) -> tuple[list[list[str]], dict[str, list[int]]]:
    pieces = [bpe.cut(t) if t else [] for t in texts]
    bpe.forget_long()
    return pieces, bpe.learn(list(chain.from_iterable(pieces)))


def encode_column(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) for every row: the ids of its text, without special tokens.

    Null and empty texts get an empty list. Repeated rows give repeated rows; other columns are
    ignored. One narrow pass, no shuffle. The vocabulary file must be readable on every worker.
    """
    path = f"{folder}/{vocabulary}"
    rows = df.select(key, F.col(text).alias("__text"))
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _chunks(texts):
                pieces, cache = _each(bpe, texts[a:b])
                get = cache.__getitem__
                flat = np.fromiter(chain.from_iterable(map(get, chain.from_iterable(pieces))), dtype=np.int32)
                sizes = [sum(map(len, map(get, p))) for p in pieces]
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(offsets, flat)], names=[key, "ids"])

    return rows.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_column(df: DataFrame, keys: list[str], text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(keys.., tokens): the number of ids of each row's text; 0 for null and empty texts."""
    path = f"{folder}/{vocabulary}"
    rows = df.select(*keys, F.col(text).alias("__text"))
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            sizes: list[int] = []
            for a, b in _chunks(texts):
                pieces, cache = _each(bpe, texts[a:b])
                get = cache.__getitem__
                sizes += [sum(map(len, map(get, p))) for p in pieces]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(sizes, type=pa.int64())], names=[*keys, "tokens"])

    return rows.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", tokens bigint")
