"""Vectorised text kernels that run inside Spark tasks on Arrow batches.

Texts are handled as the concatenated UTF-8 bytes that Arrow already holds, so one
numpy pass covers many documents. Words are maximal runs of bytes other than
``[\\x20\\x09-\\x0D]``; that test is safe on bytes because those values never occur
inside a multi-byte UTF-8 sequence. A word's identity is a 64-bit multilinear hash: a
random value for each byte times a random weight for its place, summed and finished with
an avalanche step; all sets and counts in the operators are over these hashes.

A null text counts as an empty one. Batches are cut into chunks of about a quarter
of a megabyte at document borders, so memory (about 40 bytes for each byte of a chunk) depends on
the chunk or on the longest single document, never on the batch or the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on a copy."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, dtype=np.uint64) + _GOLD
        x ^= x >> _S30
        x *= _M1
        x ^= x >> _S27
        x *= _M2
        x ^= x >> _S31
    return x


SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x5EED)) | np.uint64(1)
_BYTE_LINE = BYTE.copy()
_BYTE_LINE[10] = 0
_BYTE_WORD = BYTE.copy()
_BYTE_WORD[SEPARATOR] = 0
_BYTE_FOLD = _BYTE_WORD.copy()
_BYTE_FOLD[65:91] = _BYTE_WORD[97:123]

_weights: dict[int, np.ndarray] = {}


def weights(n: int, seed: int = 0) -> np.ndarray:
    """At least n random odd 64-bit numbers, the same ones for each seed."""
    if seed not in _weights or len(_weights[seed]) < n:
        _weights[seed] = mix(np.arange(max(n, 4096), dtype=np.uint64) ^ mix(np.array(seed + 0x9E37, dtype=np.uint64))) | np.uint64(1)
    return _weights[seed]


def span_hashes(table: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
    """Hash of every span [starts, ends) of data; spans are in order and do not overlap. Without ends they reach to the next start."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    tiles = ends is None
    ends = np.append(starts[1:], len(data)) if tiles else ends
    size = ends - starts
    if tiles and not starts[0]:
        byte = data
    else:
        byte = data[np.arange(size.sum()) + np.repeat(starts - (np.cumsum(size) - size), size)]
    first = np.cumsum(size) - size
    place = np.arange(len(byte)) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        x = table[byte]
        x *= weights(int(size.max()), seed)[place]
        run = np.zeros(len(starts), dtype=np.uint64)
        full = np.flatnonzero(size)
        if len(full):
            run[full] = np.add.reduceat(x, first[full])
        return mix(run)


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, byte offsets from 0) for runs of rows of about CHUNK bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def totals(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of flags within [bounds[i], bounds[i + 1])."""
    run = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=run[1:])
    return run[bounds[1:]] - run[bounds[:-1]]


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    solid = ~SEPARATOR[data]
    before = np.ones(len(data) + 1, dtype=bool)
    before[1:] = ~solid
    before[offsets] = True
    return np.flatnonzero(solid & before[:-1])


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the word offsets of the documents. fold: A-Z count as a-z."""
    starts = word_starts(data, offsets)
    return span_hashes(_BYTE_FOLD if fold else _BYTE_WORD, data, starts), np.searchsorted(starts, offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and hash of every line, and the line offsets of the documents; a line that is empty at a text's end is left out."""
    first = np.zeros(len(data) + 1, dtype=bool)
    first[1:] = np.concatenate([data == 10]) if len(data) else first[1:]
    first[offsets[:-1]] = True
    first = first[: len(data)]
    starts = np.flatnonzero(first)
    return starts, span_hashes(_BYTE_LINE, data, starts), np.searchsorted(starts, offsets)


def owners(bounds: np.ndarray) -> np.ndarray:
    """The document of every item, from the documents' item offsets."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def windows(hashes: np.ndarray, bounds: np.ndarray, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of k words within a document, and their offsets by document.

    short: a document with 1 to k - 1 words gives one hash of all its words.
    """
    n, owner = len(hashes), owners(bounds)
    with np.errstate(over="ignore"):
        if n >= k:
            acc = np.zeros(n - k + 1, dtype=np.uint64)
            for j in range(k):
                acc = acc * _BASE + hashes[j : n - k + 1 + j]
            valid = owner[: n - k + 1] == owner[k - 1 :]
            out, own = mix(acc[valid]), owner[: n - k + 1][valid]
        else:
            out, own = np.zeros(0, dtype=np.uint64), owner[:0]
        if short:
            count = np.diff(bounds)
            few = np.flatnonzero((count > 0) & (count < k))
            extra = np.zeros(len(few), dtype=np.uint64)
            for j in range(k - 1):
                has = count[few] > j
                extra[has] = extra[has] * _BASE + hashes[bounds[few[has]] + j]
            out, own = np.concatenate([out, mix(extra ^ np.uint64(k))]), np.concatenate([own, few])
            order = np.argsort(own, kind="stable")
            out, own = out[order], own[order]
    return out, np.searchsorted(own, np.arange(len(bounds)))


def distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of every document, and their offsets."""
    owner = owners(bounds)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[new], o[new]
    return h, np.searchsorted(o, np.arange(len(bounds)))


def minima(hashes: np.ndarray, bounds: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """MinHash values, documents x k, unsigned 32 bits; documents without items get all ones."""
    n = len(bounds) - 1
    out = np.full((n, k), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        odd = mix(np.arange(2 * k, dtype=np.uint64) + np.uint64(1000 * seed + 77))
        at = bounds[full]
        low, shift = hashes.astype(np.uint64), np.uint64(32)
        with np.errstate(over="ignore"):
            for j in range(k):
                x = (low ^ odd[2 * j]) * (odd[2 * j + 1] | np.uint64(1))
                out[full, j] = np.minimum.reduceat((x >> shift).astype(np.uint32), at)
    return out
