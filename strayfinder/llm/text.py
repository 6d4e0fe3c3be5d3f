"""Byte-level helpers for Arrow text columns: words, hashes and bounded slices of a batch.

All arrays describe one slice of rows laid end to end, so numpy works on the whole slice at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 22
PIECE_BYTES = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _table(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: bytes of a word: everything but space and \t \n \v \f \r
WORD = ~_table((0x20, 0x20), (0x09, 0x0D))
#: bytes that begin a code point
LEADING = ~_table((0x80, 0xBF))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of ``batch`` with about ``limit`` bytes of text each (one row may hold more)."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes.astype(np.int64)) - sizes) // limit
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]))
    for low, high in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(int(low), int(high - low))


def flatten(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the n+1 offsets between them; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset :][: len(column) + 1]
    values = column.buffers()[2]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal True runs, cut at row borders."""
    if not len(inside):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edges = offsets[(offsets > 0) & (offsets < len(inside))]
    before = np.empty(len(inside), dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(inside), dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def per_row(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """n+1 bounds of each row in sorted ``positions``."""
    return np.searchsorted(positions, offsets).astype(np.int64)


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on uint64 that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, count: int) -> np.ndarray:
    out = np.full(max(count, 1), base & _MASK, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the multiplier and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < count:
            size = max(count, PIECE_BYTES)
            self.up, self.down = powers(_MULTIPLIER, size), powers(pow(_MULTIPLIER, -1, 1 << 64), size)
        return self.up, self.down


_POWERS = _Powers()


def multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``count`` powers of the hash multiplier, and of its inverse."""
    return _POWERS.of(count)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte span; spans are sorted and may only overlap within a piece."""
    out = np.empty(len(starts), dtype=np.uint64)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + PIECE_BYTES, "right")))
        base = int(starts[low])
        up, down = multipliers(int(ends[high - 1]) - base + 1)
        part = data[base : int(ends[high - 1])].astype(np.uint64) + np.uint64(1)
        part *= up[: len(part)]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)))
        first, last = starts[low:high] - base, ends[low:high] - base
        out[low:high] = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
        low = high
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the n+1 bounds of the rows in them."""
    starts, ends = runs(WORD[data], offsets)
    return starts, ends, per_row(starts, offsets)


def row_of(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def window_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """Hash of ``width`` consecutive tokens from each start; windows may cross rows."""
    count = max(len(tokens) - width + 1, 0)
    out = np.full(count, width, dtype=np.uint64)
    for j, factor in enumerate(powers(0xD6E8FEB86659FD93, width + 1)[1:]):
        out += tokens[j : j + count] * factor
    return mix(out)


def inner(bounds: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows of ``width`` that stay inside their row."""
    total = int(bounds[-1])
    room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(total)
    return np.flatnonzero(room >= width)


def shingle_hashes(tokens: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles and their rows; a row of fewer words has one, of all its words."""
    starts = inner(bounds, width)
    rows = row_of(bounds)
    hashes = [window_hashes(tokens, width)[starts]]
    owners = [rows[starts]]
    sizes = np.diff(bounds)
    for short in range(1, width):
        at = np.flatnonzero(sizes == short)
        if len(at):
            whole = window_hashes(tokens, short)
            hashes.append(whole[bounds[:-1][at]])
            owners.append(at)
    return np.concatenate(hashes), np.concatenate(owners)
