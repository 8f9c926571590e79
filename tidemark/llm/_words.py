"""Word spans and 64-bit hashes over whole texts, vectorised with numpy.

A batch of texts is one byte buffer with row offsets (Arrow's own layout). Words are maximal runs
of bytes of a class, never across two rows; all classes used here keep every non-ASCII byte together,
so working on UTF-8 bytes gives the same words as working on code points.

A span's hash mixes its bytes eight at a time, each step not linear in the bytes; spans of more than `LONG` bytes
take BLAKE2. So equal hashes of different spans are a matter of chance (2**-64 a pair), not of their form. Memory is
about ten bytes a byte of the longest text, and nothing is kept between batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
LONG = 512
_P = np.uint64(0x9E3779B97F4A7C55)
_Q = np.uint64(0xD1342543DE82EF95)
#: The low bytes of a word of eight that belong to a span.
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def table(*ranges: tuple[int, int]) -> np.ndarray:
    """A flag for each byte value: True inside one of the inclusive ranges."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: `[^\x20\x09-\x0D]+`
SPACED = ~table((0x20, 0x20), (0x09, 0x0D))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, applied after lower-casing A-Z
ALNUM = ~table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; a run exceeds `most` bytes only as a single row."""
    data, offsets = buffers(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of bytes for which `inside` holds, cut at row boundaries."""
    flags = inside[data]
    if not len(flags):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins, ends = flags.copy(), flags.copy()
    begins[1:] &= ~flags[:-1]
    ends[:-1] &= ~flags[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(flags))]
    begins[cuts] = flags[cuts]
    ends[cuts - 1] = flags[cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, "right") - 1


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, the same wherever they stand."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * _Q + _P)
    if not len(size):
        return out
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    at = np.flatnonzero((size > 0) & (size <= LONG))
    done = 0
    while len(at):
        left = size[at] - done
        out[at] = mix((out[at] ^ (eight[starts[at] + done] & _MASK[np.minimum(left, 8)])) * _P)
        done += 8
        at = at[left > 8]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def runs(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each k consecutive words of one row, and the index of the first word of each."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[:n] == rows[k - 1 :])
    acc = np.zeros(len(at), np.uint64)
    for j in range(k):
        acc = acc * _Q + hashes[at + j]
    return mix(acc + np.uint64(k)), at


def bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Offsets into `rows` (sorted row numbers) of each of n rows."""
    return np.searchsorted(rows, np.arange(n + 1))
