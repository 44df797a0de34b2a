"""Words, n-grams and rolling hashes over Arrow string columns, vectorised with numpy.

A text is its UTF-8 bytes. Words are maximal runs of bytes other than space and 0x09-0x0D, which is what
``bytes.split()`` cuts. Hashes are 64-bit polynomials modulo 2^64 with a final mix.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 20
POSITION_BITS = np.uint64(24)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def release() -> None:
    """Give back what a finished task function held: tables kept between calls, Arrow's free pool and the allocator's free pages.

    Workers are reused by later stages, whose own needs would come on top.
    """
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffer(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; a null is an empty text."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    array = array.fill_null("")
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int32)[array.offset:array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer row is a range of its own."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each row the index of its first word (n + 1 bounds)."""
    inside = ~SPACE[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[first] = inside[first]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[last] = inside[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        tables = []
        for base in (BASE, BASE_INVERSE):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=np.uint64))
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    power, _ = _power_table(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=sums[1:])
    return sums


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every byte range [start, end)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = prefix_sums(data)
    _, inverse = _power_table(len(data))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from every position on."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(data)
    _, inverse = _power_table(len(data))
    return mix((sums[k:] - sums[:-k]) * inverse[:len(sums) - k])


def item_gram_hashes(items: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k items (word hashes) from every position on."""
    n = len(items) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * np.uint64(BASE) + items[j:j + n]
    return mix(total)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def minimizer_runs(grams: np.ndarray, valid: np.ndarray, width: int, block: int = 1 << 23) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive valid windows that choose the same gram, the smallest (leftmost if tied) of `width`.

    Returns first window, last window and chosen position of each run. Equal windows choose the gram at the
    same place in them, wherever they stand, so windows that share a text share a gram hash.
    """
    firsts, lasts, chosen = [], [], []
    total = min(len(valid), len(grams) - width + 1)
    for at in range(0, max(total, 0), block):
        stop = min(at + block, total)
        part = grams[at:stop + width - 1]
        order = ((part >> POSITION_BITS) << POSITION_BITS) | np.arange(len(part), dtype=np.uint64)
        pos = (sliding_min(order, width) & np.uint64((1 << 24) - 1)).astype(np.int64) + at
        ok = valid[at:stop]
        new = ok.copy()
        new[1:] &= ~ok[:-1] | (pos[1:] != pos[:-1])
        over = ok.copy()
        over[:-1] &= ~ok[1:] | (pos[1:] != pos[:-1])
        first = np.flatnonzero(new)
        firsts.append(first + at)
        lasts.append(np.flatnonzero(over) + at)
        chosen.append(pos[first])
    if not firsts:
        none = np.zeros(0, np.int64)
        return none, none, none
    return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(chosen)


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of every run of true values."""
    edge = np.diff(np.concatenate(([False], flags, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
