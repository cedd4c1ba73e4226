"""Words, word hashes and word k-grams of Arrow text columns, in numpy.

A word is a maximal run of ``0-9``, ``A-Z`` (lower-cased), ``a-z`` and characters
beyond ASCII.  All of it works on the UTF-8 bytes of a slice of documents at once:
the column's own Arrow buffer, without Python strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
NO_GRAM = np.uint64(0xFFFFFFFFFFFFFFFF)

_U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = _U(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all bits."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about ``limit`` bytes; null reads as empty.

    A longer text makes a slice of its own; texts are never cut.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offs = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Words:
    """The words of a slice: byte ranges, hashes, and where each document's words begin."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, kind: np.ndarray = IS_WORD, lower: bool = True):
        self.data = LOWER[data] if lower else data
        n = len(data)
        cls = kind[data].astype(np.uint8)
        edge = np.zeros(n + 1, bool)
        edge[1:n] = cls[1:] != cls[:-1]
        edge[offs] = True  # words never cross documents
        at = np.flatnonzero(edge)
        runs = at[:-1]
        inside = cls[runs] > 0 if n else np.zeros(0, bool)
        self.starts = runs[inside]
        self.ends = at[1:][inside]
        self.first = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.first)
        up, down = _power(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * up[:n], out=total[1:])
        self.hashes = mixed((total[self.ends] - total[self.starts]) * down[self.starts])

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def left(self) -> np.ndarray:
        """For each word, how many words its document has from it on."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))

    def grams(self, k: int) -> np.ndarray:
        """The hash of the k words from each word on; NO_GRAM where fewer are left."""
        n = len(self.hashes)
        out = np.full(n, NO_GRAM, np.uint64)
        if n >= k:
            h = self.hashes[: n - k + 1].copy()
            for j in range(1, k):
                h *= _STEP
                h += self.hashes[j : n - k + 1 + j]
            h = mixed(h + _U(k))
            h[h == NO_GRAM] = _U(0)
            out[: n - k + 1] = h
            out[self.left() < k] = NO_GRAM
        return out

    def text(self, lo: int, hi: int) -> list[str]:
        return [bytes(self.data[self.starts[i] : self.ends[i]]).decode("utf-8", "replace") for i in range(lo, hi)]


def shingle_sets(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): each document's k-word shingles; fewer words, but not none, are one shingle.

    Document ``i`` has ``hashes[bounds[i]:bounds[i + 1]]``, in order of the text, repeats kept.
    """
    g = words.grams(k)
    keep = g != NO_GRAM
    doc = words.doc_of()
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        extra = []
        for d in short:
            h = _U(0)
            with np.errstate(over="ignore"):
                for x in words.hashes[words.first[d] : words.first[d + 1]]:
                    h = h * _STEP + x
            extra.append(h)
        whole = mixed(np.array(extra, np.uint64) + words.counts[short].astype(np.uint64))
        at = words.first[short]
        g[at] = whole
        keep[at] = True
    kept_doc = doc[keep]
    return g[keep], np.searchsorted(kept_doc, np.arange(len(words.counts) + 1))
