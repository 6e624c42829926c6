"""Words and word shingles of whole Arrow string columns as 64-bit hashes, in NumPy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_tables: list[np.ndarray] = []
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> list[np.ndarray]:
    """The first powers of the base and of its inverse, ``n`` of them at least; tables for longer texts are not kept."""
    if _tables and len(_tables[0]) >= n:
        return _tables
    size = max(n, 1 << 20)
    made = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64)))) for b in (_BASE, _INVERSE)]
    if size == 1 << 20:
        _tables[:] = made
    return made


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column without nulls, and the n + 1 bounds of its rows."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from each start to its end; for spans below a thousand bytes, as longer ones can be made to agree."""
    n = len(data)
    power, inverse = _powers(max(n, 1))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start])


def piece_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hashes of the bytes from each start to its end, as sums of mixed pieces of eight bytes. Unlike ``span_hashes``, which is
    a polynomial and made for overlapping spans, it has no algebra that texts could be built against, whatever their length;
    other salts give independent hashes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    pieces = np.maximum(-(-size // 8), 1)
    first = np.cumsum(pieces) - pieces
    nth = np.arange(pieces.sum()) - np.repeat(first, pieces)
    at = np.repeat(start, pieces) + 8 * nth
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    value = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))[at].astype(np.uint64)  # eight bytes from any byte on
    value &= _MASKS[np.minimum(np.repeat(end, pieces) - at, 8)]
    key = mix(np.arange(int(pieces.max()), dtype=np.uint64) * np.uint64(2) + np.uint64((2 * salt + 1) * 0xD6E8FEB86659FD93 % (1 << 64)))
    total = np.add.reduceat(mix(value ^ key[nth]), first)
    return mix(total + mix(size.astype(np.uint64) + np.uint64(salt)))


def edges(gap: np.ndarray, bounds: np.ndarray, split: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs outside ``gap``; runs end where a row ends, and between bytes i and i + 1 if ``split[i]``."""
    n = len(gap)
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = gap[:-1], gap[1:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    before[inner] = True
    after[inner - 1] = True
    if split is not None:
        before[1:] |= split
        after[:-1] |= split
    return np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (no ASCII white space; A-Z lower-cased) and the bounds of each row's words."""
    data, bounds = text_bytes(column)
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    if lower:
        data = LOWER[data]
    start, end = edges(SPACE[data], bounds)
    return piece_hashes(data, start, end), np.searchsorted(start, bounds)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row, in order; fewer words are one shingle."""
    factor = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    count = np.diff(bounds)
    out = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    ends = np.concatenate(([0], np.cumsum(out)))
    first = np.repeat(bounds[:-1] - ends[:-1], out) + np.arange(ends[-1])
    total = np.zeros(len(first), np.uint64)
    length = np.repeat(np.minimum(count, k), out)
    for j in range(k):
        total += np.where(j < length, words[np.minimum(first + j, max(len(words) - 1, 0))], np.uint64(0)) * factor[j] if len(words) else np.uint64(0)
    return mix(total + length.astype(np.uint64)), ends
