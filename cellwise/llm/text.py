"""Vectorised hashing of words and byte strings in Arrow text columns.

Texts stay in their Arrow buffer; all work is done on NumPy arrays over runs of rows of
bounded size, so memory does not follow the batch or the longest text by more than a
constant factor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
WORD_STEP = np.uint64(0xA24BAED4963EE407)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLDEN)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _kind(sort, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """The class of each byte (0: between words; a word is a run of one class) and its value."""
    return np.array([int(sort(b)) for b in range(256)], np.uint8), BYTE_VALUES[_LOWER] if fold else BYTE_VALUES


def _blank(b: int) -> bool:
    return b == 0x20 or 0x09 <= b <= 0x0D


def _plain(b: int) -> bool:
    return b >= 0x80 or chr(b).isalnum()


# Words between blanks, and words of letters, digits and bytes from 0x80; A-Z as a-z.
BLANK_WORDS = _kind(lambda b: not _blank(b), True)
PLAIN_WORDS = _kind(_plain, True)
# Words as in PLAIN_WORDS and runs of other visible bytes, in their own case.
TOKENS = _kind(lambda b: 0 if _blank(b) else 1 if _plain(b) else 2, False)

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, at, data = column.buffers()
    wide = np.int64 if column.type in (pa.large_string(), pa.large_binary()) else np.int32
    offsets = np.frombuffer(at, wide)[column.offset : column.offset + len(column) + 1] if at else np.zeros(1, wide)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8), offsets.astype(np.int64)


def runs(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding at most ``limit`` bytes, or a single longer row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def _word_hashes(data: np.ndarray, starts: np.ndarray, kind) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of ``data``; ``starts``: where rows begin."""
    sort, values = kind
    inside = sort[data]
    turn = inside[1:] != inside[:-1]
    turn[starts[(starts > 0) & (starts < len(data))] - 1] = True
    filled = inside > 0
    first, last = filled.copy(), filled
    first[1:] &= turn
    last[:-1] &= turn
    at, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * power[:-1], out=sums[1:])
    return mix((sums[end] - sums[at]) * inverse[at] + (end - at).astype(np.uint64)), at


def hash_words(data: np.ndarray, offsets: np.ndarray, kind) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of rows back to back, and the number of words of each row.

    A row longer than ``SLICE_BYTES`` is hashed in pieces that end outside words.
    """
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for a, b in runs(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        if b - a > 1 or hi - lo <= SLICE_BYTES:
            got, at = _word_hashes(data[lo:hi], offsets[a:b] - lo, kind)
            hashes.append(got)
            counts[a:b] = np.diff(np.append(np.searchsorted(at, offsets[a:b] - lo), len(at)))
            continue
        while lo < hi:
            end = min(lo + SLICE_BYTES, hi)
            while end < hi and kind[0][data[end]] and kind[0][data[end]] == kind[0][data[end - 1]]:
                more = np.flatnonzero(kind[0][data[end : end + 4096]] != kind[0][data[end - 1]])
                end = min(end + (int(more[0]) if len(more) else 4096), hi)
            got, _ = _word_hashes(data[lo:end], np.zeros(1, np.int64), kind)
            hashes.append(got)
            counts[a] += len(got)
            lo = end
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive words, rows aside."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    count = len(words) - n + 1
    total = words[:count].copy()
    for k in range(1, n):
        total *= WORD_STEP
        total += words[k : k + count]
    return mix(total)


def digest64(rows: np.ndarray) -> np.ndarray:
    """64-bit hash of every row of a byte matrix."""
    total = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        total *= np.uint64(_BASE)
        total += BYTE_VALUES[rows[:, k]]
    return mix(total)
