"""Words of whole batches of texts, and hashes over them, as numpy arrays.

A word is a run of characters other than space and \\x09-\\x0D. All six separators are ASCII, so the
UTF-8 bytes can be cut without decoding. Word hashes are Karp-Rabin polynomials modulo 2^64 taken
from prefix sums (hash of bytes lo..hi = (c[hi] - c[lo]) / p^lo), then mixed; hashes of windows of
words are the same polynomial over the word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEPARATORS = b" \t\n\x0b\x0c\r"
BLOCK = 2 << 20
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each (null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of the public splitmix64 generator (fixed constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(max(n, 1), base, np.uint64)
    p[0] = 1
    return np.cumprod(p)


class Hasher:
    """Power tables that grow to the largest block seen in a task."""

    def __init__(self):
        self.tables = {}

    def table(self, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if base not in self.tables or len(self.tables[base][0]) < n:
            n = max(n, 1 << 16)
            self.tables[base] = _powers(base, n), _powers(pow(base, -1, 1 << 64), n)
        return self.tables[base]

    def _spans(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        is_word = np.ones(256, bool)
        is_word[list(SEPARATORS)] = False
        word = is_word[data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        full = at[1:] > at[:-1]
        heads, tails = at[:-1][full], at[1:][full] - 1
        first[heads], last[tails] = word[heads], word[tails]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def _words(self, data: np.ndarray, at: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
        if lower:
            data = np.where((data >= 65) & (data <= 90), data | 32, data)
        lo, hi = self._spans(data, at)
        p, inv = self.table(BYTE_BASE, len(data) + 1)
        c = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:len(data)], out=c[1:])
        return mix((c[hi] - c[lo]) * inv[lo]), np.searchsorted(lo, at)

    def words(self, data: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word of the texts ``data[at[i]:at[i + 1]]`` and the word offsets of each
        text. A text longer than a block is cut after separators."""
        if len(data) <= BLOCK or len(at) > 2:
            return self._words(data, at, lower)
        is_separator = np.zeros(256, bool)
        is_separator[list(SEPARATORS)] = True
        found, lo = [], 0
        while lo < len(data):
            hi = min(len(data), lo + BLOCK)
            if hi < len(data):
                cut = np.flatnonzero(is_separator[data[lo:hi]])
                while not len(cut) and hi < len(data):     # one word longer than a block
                    hi = min(len(data), hi + BLOCK)
                    cut = np.flatnonzero(is_separator[data[lo:hi]])
                if hi < len(data):
                    hi = lo + int(cut[-1]) + 1
            found.append(self._words(data[lo:hi], np.array([0, hi - lo]), lower)[0])
            lo = hi
        hashes = np.concatenate(found)
        return hashes, np.array([0, len(hashes)])

    def windows(self, words: np.ndarray, k: int) -> np.ndarray:
        """Karp-Rabin hash of every ``k`` consecutive words (one per start; texts not regarded)."""
        n = len(words)
        if n < k:
            return np.zeros(0, np.uint64)
        p, inv = self.table(WORD_BASE, n + 1)
        c = np.zeros(n + 1, np.uint64)
        np.cumsum(words * p[:n], out=c[1:])
        return mix((c[k:] - c[:-k]) * inv[:n - k + 1])


def blocks(texts: pa.Array | pa.ChunkedArray, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of consecutive texts of at most ``limit`` bytes together, or of a
    single longer one."""
    data, at = utf8(texts)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j, data[at[i]:at[j]], at[i:j + 1] - at[i]
        i = j


def starts_inside(offsets: np.ndarray, k: int) -> np.ndarray:
    """Which of the ``offsets[-1] - k + 1`` windows of ``k`` words lie within one text."""
    n = int(offsets[-1])
    if n < k:
        return np.zeros(0, bool)
    end = np.repeat(offsets[1:], np.diff(offsets))
    return np.arange(n - k + 1) + k <= end[:n - k + 1]


def bucket_cuts(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of equally wide buckets of the hash range begins among sorted hashes."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))


def deltas(hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences, low bytes first: the zero high bytes compress away."""
    d = np.diff(hashes, prepend=np.uint64(0))
    return d.view(np.uint8).reshape(-1, 8).T.tobytes()


def from_deltas(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel())
