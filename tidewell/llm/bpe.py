"""Byte-level BPE encoding and decoding on padded numpy matrices.

The pieces of a batch of texts are collected once each, put into buckets by length and encoded
together. A bucket is a matrix of token ids, a row for each piece, padded to the width of the
bucket. In each round every row merges its leftmost pair of minimum rank. Ranks of pairs come from
an open-addressing hash table in numpy arrays; rows without a further merge leave the matrix and the
matrix is narrowed to its longest row (compaction).

Defined cases: a null text counts as empty and has no ids; an empty table gives an empty one. Texts are
encoded whole. A piece of more than ``LONG`` bytes (a run without a break) takes a heap instead of a
matrix row, with equal ids: a row would cost the square of its length.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = np.int32(2**31 - 1)
#: Cells of a matrix, at most; bounds the memory of a round.
CELLS = 1 << 19
#: Pieces of more bytes are merged one at a time with a heap: in a matrix their cost is quadratic.
LONG = 1024
#: Characters of texts whose pieces are looked up together, about.
BLOCK = 1 << 21
#: Pieces a worker remembers, and their bytes.
REMEMBERED, REMEMBERED_BYTES = 400_000, 1 << 26


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """Pairs of ids to the rank of what they make, as an open-addressing hash table."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        left, right, made = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        ids = np.array(made, np.int32)
        bits = max(8, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1), np.uint64)
        self.made = np.full(1 << bits, NONE, np.int32)
        self.probes = 0
        at = self._slot(keys)
        while len(keys):
            self.probes += 1
            free = self.keys[at] == np.uint64(2**64 - 1)
            slot, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[slot >= 0]
            self.keys[at[first]], self.made[at[first]] = keys[first], ids[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ids, at = keys[rest], ids[rest], (at[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NONE where a pair makes no token or a side is padding (negative)."""
        out = np.full(left.shape, NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = (left.ravel()[todo].astype(np.uint64) << np.uint64(32)) | right.ravel()[todo].astype(np.uint64)
        at, flat = self._slot(keys), out.ravel()
        for _ in range(self.probes):
            there = self.keys[at]
            hit = there == keys
            flat[todo[hit]] = self.made[at[hit]]
            open_ = ~hit & (there != np.uint64(2**64 - 1))
            if not open_.any():
                break
            todo, keys, at = todo[open_], keys[open_], (at[open_] + 1) & self.mask
        return flat.reshape(left.shape)


class Codec:
    """Encodes pieces by ranks and decodes ids."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.pairs = PairTable(ranks)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.token = {rank: token for token, rank in ranks.items()}

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[k] = [whole]
            elif len(piece) > LONG:
                out[k] = self._one(piece)
            elif piece:
                buckets.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(k)
        for width, members in buckets.items():
            step = max(1, CELLS // width)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                for k, ids in zip(part, self._matrix([pieces[k] for k in part], width), strict=True):
                    out[k] = ids
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> list[list[int]]:
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        column = np.arange(width)
        ids = np.where(column < lengths[:, None], self.of_byte[raw], np.int32(-1))
        ranks = self.pairs(ids[:, :-1], ids[:, 1:])
        rows, out = np.arange(len(pieces)), [[]] * len(pieces)
        while len(rows):
            at = ranks.argmin(1)  # the first of equal ranks
            best = ranks[np.arange(len(rows)), at]
            ended = best == NONE
            if ended.any():
                for k, row, n in zip(rows[ended].tolist(), ids[ended].tolist(), lengths[ended].tolist(), strict=True):
                    out[k] = row[:n]
                stay = ~ended
                rows, lengths, at, best = rows[stay], lengths[stay], at[stay], best[stay]
                if not len(rows):
                    break
                most = int(lengths.max())
                ids, ranks = ids[stay, :most], ranks[stay, : most - 1]
            line, most = np.arange(len(rows)), ids.shape[1]
            after = column[None, : most - 1] > at[:, None]
            ids[line, at] = best
            moved = np.where(after, ids[:, 1:], ids[:, :-1])
            shifted = np.where(after[:, : most - 2], ranks[:, 1:], ranks[:, :-1])
            lengths = lengths - 1
            ids = np.concatenate([moved, np.full((len(rows), 1), -1, np.int32)], 1) if most == 2 else moved
            ranks = shifted if most > 2 else np.full((len(rows), 1), NONE, np.int32)
            for side in (-1, 0):
                a = at + side
                ok = np.flatnonzero((a >= 0) & (a < ranks.shape[1]))
                ranks[ok, a[ok]] = self.pairs(ids[ok, a[ok]], ids[ok, a[ok] + 1])
        return out

    def _one(self, piece: bytes) -> list[int]:
        """The same merges for one very long piece: a linked list and a heap, n log n."""
        ids = [int(self.of_byte[b]) for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        token, ranks = self.token, self.ranks
        size = [1] * n

        def rank(a: int) -> int | None:
            b = after[a]
            return ranks.get(token[ids[a]] + token[ids[b]]) if b < n else None

        heap = [(r, a, 1, 1) for a in range(n - 1) if (r := rank(a)) is not None]
        heapq.heapify(heap)
        while heap:
            r, a, left, right = heapq.heappop(heap)
            b = after[a]
            if size[a] != left or b >= n or size[b] != right:
                continue
            ids[a], size[a], size[b], after[a] = r, left + right, 0, after[b]
            if after[b] < n:
                before[after[b]] = a
            for c in (before[a], a):
                if c >= 0 and (x := rank(c)) is not None:
                    heapq.heappush(heap, (x, c, size[c], size[after[c]]))
        return [ids[a] for a in range(n) if size[a]]


class Encoder:
    """Texts to ids, with a bounded memory of pieces seen before."""

    def __init__(self, path: str, pattern: str) -> None:
        self.codec = Codec(load_ranks(path))
        self.find = regex.compile(pattern).findall
        self.seen: dict[str, tuple[str, bytes, int]] = {}
        self.bytes = 0

    def pieces(self, texts: list[str]) -> Iterator[list[tuple[str, bytes, int]]]:
        """For each text its pieces as (ids joined by commas, bytes decoded from the ids, number of ids)."""
        at = 0
        while at < len(texts):
            block, size = [], 0
            while at < len(texts) and size < BLOCK:  # new pieces of many texts share their matrices
                block.append(self.find(texts[at]))
                size += len(texts[at])
                at += 1
            every, seen = set().union(*block), self.seen
            new = [p for p in every if p not in seen]
            if len(seen) + len(new) > REMEMBERED or self.bytes > REMEMBERED_BYTES:
                seen.clear()
                new, self.bytes = list(every), 0
            for p, ids in zip(new, self.codec.encode([p.encode() for p in new]), strict=True):
                seen[p] = (",".join(map(str, ids)), self.codec.decode(ids), len(ids))
                self.bytes += len(seen[p][0]) + len(seen[p][1])
            for parts in block:
                yield [seen[p] for p in parts]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def encode_texts(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes every whole text.

    Returns a row for each row of df: the key, ``ids`` (array of int) and ``decoded`` (binary, the
    bytes that the ids stand for). A null text counts as empty and has no ids. Repeated rows stay
    repeated; other columns of df, whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            ids, decoded = [], []
            for parts in enc.pieces([x or "" for x in batch.column(1).to_pylist()]):
                ids.append([int(i) for p in parts for i in p[0].split(",")])
                decoded.append(b"".join([p[1] for p in parts]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())], ["k", "ids", "decoded"])

    kind = df.select(F.col(key)).schema[0].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, ids array<int>, decoded binary").withColumnRenamed("k", key)


def digest_texts(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As encode_texts, but returns n_tokens, ids_sha256 and decoded_sha256 (lowercase hex) of each row.

    The digests are taken where the ids are, so that the ids of long texts never leave the worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            n, ids, decoded = [], [], []
            for parts in enc.pieces([x or "" for x in batch.column(1).to_pylist()]):
                n.append(sum([p[2] for p in parts]))
                ids.append(hashlib.sha256(",".join([p[0] for p in parts]).encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join([p[1] for p in parts])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["k", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.select(F.col(key)).schema[0].dataType.simpleString()
    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("k", key)
