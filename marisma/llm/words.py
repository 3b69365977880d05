"""Words of Arrow text columns as numpy arrays: positions, 64-bit hashes, distinct shingles.

A column is handled in slices of a few megabytes of text, so memory follows the
slice (or one longer text), not the batch.  A hash only finds candidates; what
is reported is confirmed on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_S29, _S32 = np.uint64(29), np.uint64(32)
_LOW = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], dtype="<u8")

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def byte_class(inside) -> np.ndarray:
    """Truth per byte value; every byte of a non-ASCII character is treated alike."""
    return np.array([b >= 128 or inside(b) for b in range(256)])


#: letters a-z, digits and everything beyond ASCII
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
#: everything but white space
SOLID = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S32)) * _C1
    h = (h ^ (h >> _S29)) * _C2
    return h ^ (h >> _S32)


@dataclass
class Words:
    """Words of consecutive texts: text i owns words first[i]:first[i + 1]."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.begin[i] : self.end[i]].tobytes()


def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    loads = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    left = end - begin
    h = left.astype(np.uint64) * _C3
    at = np.arange(len(begin))
    step = 0
    while len(at):
        part = loads[begin[at] + step] & _LOW[np.minimum(left[at] - step, 8)]
        h[at] = mix(h[at] ^ part)
        step += 8
        at = at[left[at] > step]
    return h


def split_words(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> Words:
    """data: bytes of the texts; bounds: where each begins, and the end of the last."""
    data = LOWER[data]
    solid = inside[data]
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    edge = bounds[:-1][bounds[:-1] < bounds[1:]]
    opens[edge] = solid[edge]
    edge = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    closes[edge] = solid[edge]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(data, begin, end, _hashes(data, begin, end), np.searchsorted(begin, bounds))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, bounds) of consecutive rows; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = (column.fill_null("") if column.null_count else column).cast(pa.large_binary())
    _, offsets, values = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1)
        yield row, last, data[bounds[row] : bounds[last]], bounds[row : last + 1] - bounds[row]
        row = last


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words, by the position of the first."""
    out = h[: len(h) - k + 1] * _C1
    for j in range(1, k):
        out = mix(out) + h[j : len(h) - k + 1 + j] * _C3
    return mix(out)
