"""Vectorised text kernels: numpy passes over the buffers of Arrow string columns.

A batch of texts is one byte buffer plus offsets, so words, word hashes, shingles and lines are found
with array operations over the whole batch; there is no loop over words. All hashes are 64 bits wide and
the same in every process.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
_GOLD = U64(0x9E3779B97F4A7C15)
_BASE = U64(0x5851F42D4C957F2D)  # odd, so that it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = (x + _GOLD).astype(U64, copy=False)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=U64))


def byte_class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


#: The white space of the contracts, and what separates decontamination words.
WHITE = byte_class(b" \t\n\x0b\x0c\r")
NOT_ALNUM = byte_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Values that a block of span hashes reads at once, and the width from which a span is hashed by itself.
_BLOCK, _WIDE = 1 << 18, 256


def _powers(base: int) -> np.ndarray:
    """base**i modulo 2**64 for i up to the block and the widest span that begins in it."""
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate(([U64(1)], np.full(_BLOCK + _WIDE, U64(base)))), dtype=U64)


_POWERS, _INVERSES = _powers(int(_BASE)), _powers(pow(int(_BASE), -1, 1 << 64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """A hash of each span data[start:end] of integers; spans are in order and may overlap.

    Spans under 256 values are sums of powers, made in blocks, over the table's value for each integer (without
    a table: its mix). Wider ones go to xxh3 one by one: sums of powers modulo 2**64 are equal for some pairs
    of long texts, and need tables as long as the span. So memory is bounded, whatever the widths.
    """
    out = np.empty(len(starts), dtype=U64)
    width = ends - starts
    wide = np.flatnonzero(width >= _WIDE)
    for i in wide.tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    short = np.flatnonzero(width < _WIDE) if len(wide) else slice(None)
    own, stop, found, i = starts[short], ends[short], np.empty(len(starts) - len(wide), dtype=U64), 0
    while i < len(own):
        lo = int(own[i])
        j = max(i + 1, int(np.searchsorted(own, lo + _BLOCK, side="left")))
        hi = max(lo, int(stop[i:j].max()))
        part = data[lo:hi]
        sums = np.zeros(hi - lo + 1, dtype=U64)
        np.cumsum((mix(part.astype(U64)) if table is None else table[part]) * _POWERS[: hi - lo], out=sums[1:])
        s, e = own[i:j] - lo, stop[i:j] - lo
        found[i:j] = (sums[e] - sums[s]) * _INVERSES[s] + (e - s).astype(U64) * _GOLD
        i = j
    out[short] = found
    return mix(out)


class Texts:
    """A column of texts as one byte array and offsets; nulls are empty texts."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
        if column.null_count:
            column = column.fill_null(b"")
        _, offsets, data = column.buffers()
        off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.bytes = raw[off[0] : off[-1]]
        self.offsets = off - off[0]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, separators: np.ndarray = WHITE, lower: bool = True) -> Words:
        data = LOWER[self.bytes] if lower else self.bytes
        inside = ~separators[data]
        n = len(data)
        begin, end = inside.copy(), np.zeros(n + 1, dtype=bool)
        begin[1:] &= ~inside[:-1]
        end[1:n] = inside[:-1] & ~inside[1:]
        end[n] = n > 0 and inside[-1]
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        joined = cuts[inside[cuts] & inside[cuts - 1]]
        begin[joined] = True
        end[joined] = True
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end)
        return Words(data, starts, ends, np.searchsorted(starts, self.offsets))


class Words:
    """Words of a batch: byte spans, and for document i the words first[i]:first[i + 1]."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray):
        self.data, self.starts, self.ends, self.first = data, starts, ends, first

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, BYTE_VALUES)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words and their documents' bounds; a document of fewer words is one shingle, of none is none."""
    counts = np.diff(first)
    n = len(hashes)
    rolled = np.zeros(n, dtype=U64)
    for j in range(k):
        part = np.zeros(n, dtype=U64)
        part[: max(0, n - j)] = hashes[j:]
        rolled = rolled * _BASE + part
    rolled = mix(rolled)
    within = np.arange(n, dtype=np.int64) - np.repeat(first[:-1], counts)
    left = np.repeat(counts, counts) - within
    keep = left >= k
    short = np.flatnonzero((counts > 0) & (counts < k))
    keep[first[:-1][short]] = True
    for d in short:
        rolled[first[d]] = mix(np.bitwise_xor.reduce(mix(hashes[first[d] : first[d + 1]] + np.arange(counts[d], dtype=U64))).reshape(1) + U64(counts[d]))[0]
    bounds = np.concatenate(([0], np.cumsum(keep)))[first]
    return rolled[keep], bounds


def trim() -> None:
    """Gives memory that is free back to the system: a worker that waits for its next task should be small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def batches(stream: Iterable[pa.RecordBatch], limit: int = 1 << 21, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of one have about `limit` bytes at most; one longer text is a batch of its own."""
    for batch in stream:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.cumsum(np.asarray(pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    trim()


def int64(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def list_array(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), int64(values))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by a sort: many times as fast for 64-bit hashes as a table of them."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def unique_within(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each document."""
    parts = [distinct(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    out = np.concatenate(parts) if parts else np.zeros(0, U64)
    return out, np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))
