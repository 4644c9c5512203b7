"""Hashes of words and of runs of words, for many texts at once.

Words are runs of bytes outside \\x20 and \\x09-\\x0D. The distinct words of a block are found exactly
(as a dictionary) and each is hashed once by a real string hash, so that no construction of letters
makes two words one. A run's hash is put together from those of its halves, mixed at every step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

#: Bytes of texts worked on together, about.
BLOCK = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbered(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of all texts, one after the other, as numbers of distinct words; these; and where each text's begin."""
    raw = np.frombuffer(b" ".join(texts), np.uint8)
    edge = np.diff(~_SPACE[raw], prepend=False, append=False) if len(raw) else np.zeros(0, bool)
    cuts = np.flatnonzero(edge)
    begin, end = cuts[::2], cuts[1::2]
    letters = raw[~_SPACE[raw]] if len(raw) else raw
    offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(letters.tobytes())]).dictionary_encode()
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    return found.indices.to_numpy().astype(np.int64), found.dictionary, np.append(np.searchsorted(begin, starts[:-1]), len(begin))


def words(texts: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """Hashes of the words of all texts, one after the other; and where each text's begin (one more than texts)."""
    numbers, distinct, starts = numbered(texts)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()], np.uint64)
    return (hashes[numbers] if len(numbers) else np.zeros(0, np.uint64)), starts.tolist()


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of so many words, text boundaries disregarded."""
    n = len(hashes)
    if n < length or not length:
        return np.zeros(0, np.uint64)
    out, have, power, size = None, 0, hashes, 1
    while True:  # of runs of 1, 2, 4, ... words those that the length is made of
        if length & size:
            out = power.copy() if out is None else mixed(out[: n - have - size + 1] * _LEFT + power[have : n - size + 1] * _RIGHT)
            have += size
        if have == length:
            return mixed(out + np.uint64(length))
        power = mixed(power[: len(power) - size] * _LEFT + power[size:] * _RIGHT + np.uint64(size))
        size *= 2


def blocks(texts: list[str | None], most: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as bytes in blocks of about so many bytes, each with the number of its first text."""
    at, block, size = 0, [], 0
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        if block and size + len(raw) > most:
            yield at, block
            at, block, size = k, [], 0
        block.append(raw)
        size += len(raw)
    if block:
        yield at, block
