"""Vectorised work on the UTF-8 buffers of Arrow string columns: words, hashes and ragged arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is taken alone.
BATCH_BYTES = 1 << 20

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for each byte; in the second table A-Z have the values of a-z.
BYTE_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = BYTE_VALUES[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    while len(_powers[0]) < n:
        k = len(_powers[0])
        for j, base in enumerate((_BASE, _INVERSE)):
            _powers[j] = np.concatenate([_powers[j], _powers[j] * _U(pow(base, k, 1 << 64))])
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def row_slices(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold at most so many bytes, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop
    release_memory()


def release_memory() -> None:
    """Gives freed memory back to the system, which else stays with a worker that Spark keeps for later tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if ends else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes that are not white space (0x20, 0x09-0x0D): starts, ends, and words in each text."""
    inside = ~IS_SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[first] = inside[first]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[last] = inside[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False, window: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order of their starts and do not overlap.

    Polynomial sums are made a window of bytes at a time, so that memory does not follow the length of a text.
    """
    values = FOLDED_VALUES if fold else BYTE_VALUES
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, low + window, side="right")))
        high = ends[stop - 1]
        up, down = powers(int(high - low) + 1)
        sums = np.zeros(int(high - low) + 1, np.uint64)
        np.cumsum(values[data[low:high]] * up[:-1], out=sums[1:])
        s, e = starts[at:stop] - low, ends[at:stop] - low
        out[at:stop] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = stop
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def offsets_of(counts: np.ndarray) -> np.ndarray:
    """0 and the running sums."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def shingles(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of n words of each text, and windows in each text.

    A text with fewer words, but some, has one: its whole sequence. One without words has none.
    """
    offsets = offsets_of(counts)
    total = len(words)
    if not total:
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    rolled = np.zeros(total, np.uint64)
    for k in range(min(n, total)):
        rolled[: total - k] += mix(words[k:] + _U(k + 1)) if k else mix(words + _U(1))
    whole = np.maximum(counts - n + 1, 0)
    keep = ranges(offsets[:-1], whole)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if not len(short):
        return mix(rolled[keep] * _U(3) + _U(n)), whole
    # the sums of a short text must not reach into the next one
    made = np.array([int(mix(np.array([sum(int(mix(words[offsets[i] + j : offsets[i] + j + 1] + _U(j + 1))[0]) for j in range(counts[i])) * 3 + int(counts[i]) & (2**64 - 1)], np.uint64))[0]) for i in short], np.uint64)
    sizes = whole.copy()
    sizes[short] = 1
    out = np.empty(int(sizes.sum()), np.uint64)
    at = offsets_of(sizes)
    out[ranges(at[:-1], whole)] = mix(rolled[keep] * _U(3) + _U(n))
    out[at[short]] = made
    return out, sizes


def distinct_sorted(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in order, and how many."""
    out, sizes, at = [], np.zeros(len(counts), np.int64), 0
    for i, n in enumerate(counts.tolist()):
        if n:
            s = np.sort(values[at : at + n])
            if n > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            out.append(s)
            sizes[i] = len(s)
            at += n
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes
