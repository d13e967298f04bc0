"""Whole batches of texts as numpy arrays, without a Python object per word.

Texts stay the UTF-8 bytes of an Arrow column.  Words, pieces and their hashes
are found with array operations on those bytes; a hash is a polynomial of the
bytes modulo 2**64, taken from running sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes that one numpy pass covers; temporaries are about fifty times as many.
WINDOW = 1 << 20
#: Bytes of text that one chunk holds, unless a single text is longer.
CHUNK = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, WINDOW + 4096)
        made = []
        for base in (_BASE, _INVERSE):
            x = np.full(size, base, U64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _powers = (made[0], made[1])
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every bit of the input reaches every bit of the result."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, last row + 1, bytes, offsets); a null text is empty.

    A chunk holds about ``limit`` bytes; one longer text makes a chunk alone.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and each text's first word's number.

    The third array has one entry more than there are texts.
    """
    inside = ~_SPACE[data]
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = ~inside[:-1]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ~inside[1:]
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; spans must be in order and must not overlap."""
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + WINDOW, "right")))
        base, top = int(starts[at]), int(ends[to - 1])
        power, inverse = _powers_to(top - base + 1)
        sums = np.zeros(top - base + 1, U64)
        np.cumsum(_BYTE[data[base:top]] * power[: top - base], out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(U64)
        at = to
    return mix(out)


def hash_words(texts: list[bytes]) -> np.ndarray:
    """The hash that :func:`span_hashes` gives for each of these byte strings."""
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    return span_hashes(np.frombuffer(b"".join(texts), np.uint8), ends - lengths, ends)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words within each text.

    A text of fewer words has one shingle of all its words, a text without
    words has none.  Returns the hashes and each text's first shingle's number.
    """
    counts = np.diff(first)
    many = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(many, out=at[1:])
    total = int(at[-1])
    # word number of each shingle's first word
    word = np.repeat(first[:-1] - at[:-1], many) + np.arange(total)
    left = np.repeat(first[1:], many) - word
    out = np.zeros(total, U64)
    for k in range(width):
        here = np.minimum(word + k, max(len(hashes) - 1, 0))
        part = mix(hashes[here] + U64(0x632BE59BD9B4E019 * (k + 1) % 2**64)) if total else out
        out += np.where(left > k, part, U64(k + 1))
    return mix(out), at


def factorize(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the hashes, and for each code where it is first met."""
    import pandas as pd

    codes, found = pd.factorize(hashes)
    where = np.empty(len(found), np.int64)
    where[codes[::-1]] = np.arange(len(hashes) - 1, -1, -1)
    return codes, where


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive entries of ``first``; an empty segment is 0."""
    sums = np.zeros((len(values) + 1, *values.shape[1:]), np.result_type(values.dtype, np.int64) if values.dtype.kind in "iub" else np.float64)
    np.cumsum(values, axis=0, dtype=sums.dtype, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
