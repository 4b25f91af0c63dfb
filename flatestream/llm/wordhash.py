"""Vectorised words, shingles and MinHash over the UTF-8 buffers of Arrow string columns.

A word is a run of bytes other than 0x20 and 0x09-0x0D with A-Z lower-cased. The hash of a word is a polynomial over
its bytes modulo 2**64, finished with a mixer; all words of a block come from one prefix sum, without a Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BLOCK_BYTES = 1 << 20
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += np.uint64(32)
LOWER += np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + 1)
        for key, base in (("up", int(BASE)), ("down", pow(int(BASE), -1, 1 << 64))):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole rows in blocks of about `limit` bytes: (first row, end row, bytes, offsets from the block's start). Null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in page order, and the index of the first word of each row (one more entry than rows)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    up, down = powers(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(LOWER[data] * up[:n], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(start, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles (a row of 1 to k-1 words: its whole sequence as one), and the first of each row."""
    n = np.diff(first)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_first = np.concatenate([[0], np.cumsum(counts)])
    if not out_first[-1]:
        return np.zeros(0, np.uint64), out_first
    place = np.arange(out_first[-1]) - np.repeat(out_first[:-1], counts) + np.repeat(first[:-1], counts)
    length = np.repeat(np.minimum(n, k), counts)
    out = length.astype(np.uint64)
    last = len(hashes) - 1
    for j in range(k):
        step = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[np.minimum(place + j, last)])
        out = step if not (length <= j).any() else np.where(length > j, step, out)
    return out, out_first


def minhash(values: np.ndarray, first: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """rows x len(seeds) minima of 32-bit permutations; rows without values are all ones."""
    rows = len(first) - 1
    out = np.full((rows, len(seeds)), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return out
    x = (values >> np.uint64(32)).astype(np.uint32)
    starts = first[:-1][full]
    for i, (flip, factor) in enumerate(seeds):
        t = (x ^ flip) * factor
        t ^= t >> np.uint32(16)
        out[full, i] = np.minimum.reduceat(t, starts)
    return out


def seeds(n: int, seed: int = 7) -> np.ndarray:
    found = np.random.default_rng(seed).integers(0, 1 << 32, (n, 2), np.uint64).astype(np.uint32)
    found[:, 1] |= np.uint32(1)
    return found
