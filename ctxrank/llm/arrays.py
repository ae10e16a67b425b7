"""Texts of an Arrow batch as byte arrays: words, windows and their 64-bit hashes.

Everything here works on one slice of a batch at a time, so memory follows the
slice (``SLICE_BYTES``, or one longer text) and not the batch or the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def byte_table(members: str) -> np.ndarray:
    """A flag per byte value, true for those between the pairs of ``members``."""
    table = np.zeros(256, bool)
    for low, high in zip(members[::2], members[1::2]):
        table[ord(low) : ord(high) + 1] = True
    return table


# Words without the ASCII white space 0x20 and 0x09-0x0D.
NOT_SPACE = ~byte_table("\x20\x20\x09\x0d")
# Words of ASCII letters and digits and of everything outside ASCII.
ALPHANUMERIC = byte_table("09AZaz\x80\xff")

_values = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * 2 + 1
_folded = _values.copy()
_folded[65:91] = _values[97:123]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of a 64-bit hash over all its bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _prepare(n: int) -> None:
    global _powers, _inverses
    if len(_powers) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        base = np.full(size, _BASE, np.uint64)
        base[0] = 1
        _powers = np.cumprod(base, dtype=np.uint64)
        base[1:] = pow(_BASE, -1, 1 << 64)
        _inverses = np.cumprod(base, dtype=np.uint64)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    rows = np.frombuffer(offsets, np.int64 if wide else np.int32) if len(column) else np.zeros(1, int)
    rows = rows[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), rows


def _c_library():
    """glibc, or None where there is another C library."""
    library = ctypes.CDLL(None)
    return library if hasattr(library, "malloc_trim") else None


def release_memory() -> None:
    """Give freed memory back to the system; a worker that is used again would keep its peak."""
    pa.default_memory_pool().release_unused()
    if (library := _c_library()) is not None:
        library.malloc_trim(0)


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) for runs of rows of about ``size`` bytes."""
    data, rows = text_buffers(column)
    at, n = 0, len(rows) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(rows, rows[at] + size, "right")) - 1)
        yield at, end, data[rows[at] : rows[end]], rows[at : end + 1] - rows[at]
        at = end
    release_memory()


def prefix_sums(data: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """Sums from which ``window_hashes`` takes the hash of any stretch of ``data``."""
    _prepare(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_folded if fold_case else _values)[data] * _powers[: len(data)], out=sums[1:])
    return sums


def window_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each stretch [start, end), the same wherever its bytes stand."""
    return mix((sums[ends] - sums[starts]) * _inverses[starts])


def words(data: np.ndarray, rows: np.ndarray, members: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, and the row of each; words never cross rows."""
    inside = members[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    begin, end = rows[:-1], rows[1:]
    full = end > begin
    first[begin[full]] = inside[begin[full]]
    last[end[full] - 1] = inside[end[full] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(rows, starts, "right") - 1


def sequence_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive values; entry i stands for values i to i + k - 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, k, np.uint64)
    for j in range(k):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + n]
    return mix(total)


def signed(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as the long column with the same bits."""
    return pa.array(values.view(np.int64))
