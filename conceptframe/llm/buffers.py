"""Vectorised views of a text column: byte buffers, word spans, 64-bit word hashes.

All functions work on one block of whole documents at a time; a block holds about `BLOCK` bytes, or
one document where that alone is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 2 << 20
SEGMENT = 1 << 20
U64 = np.uint64

_ROOT = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = {"up": np.ones(1, U64), "down": np.ones(1, U64)}

SPACES = np.zeros(256, bool)  # 0x20 and 0x09-0x0D
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BETWEEN = np.zeros(256, bool)  # what neither is a digit, a-z nor a byte of a non-ASCII character
BETWEEN[:0x80] = True
BETWEEN[0x30:0x3A] = False
BETWEEN[0x61:0x7B] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * _ROOT) | U64(1)


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", block: int = BLOCK
           ) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Whole rows in blocks of about `block` bytes of text: batch, bytes, offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = bytes_of(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + block, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield (batch.slice(start, end - start), data[offsets[start]:offsets[end]],
                   offsets[start:end + 1] - offsets[start])
            start = end


def spans(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of bytes that `apart` doesn't mark, and each row's first run (plus the end)."""
    n = len(data)
    inner = np.zeros(n + 2, bool)
    np.logical_not(apart[data], out=inner[1:-1])
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, here = inner[:-1], inner[1:]
    starts = np.flatnonzero(here & (~before | edge))
    ends = np.flatnonzero(before & (~here | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = max(n, SEGMENT + 1)
        for name, root in (("up", _ROOT), ("down", _INVERSE)):
            chain = np.full(size, root, U64)
            chain[0] = 1
            _POWERS[name] = np.multiply.accumulate(chain)
    return _POWERS["up"], _POWERS["down"]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit content hash of each byte range; ranges ascend in start and end."""
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(int(np.searchsorted(ends, base + SEGMENT, "right")), at + 1)
        top = int(ends[to - 1])
        up, down = powers(top - base + 1)
        sums = np.zeros(top - base + 1, U64)
        np.cumsum(BYTE_CODES[data[base:top]] * up[:top - base], out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (sums[e] - sums[s]) * down[s] + (e - s).astype(U64)
        at = to
    return mix(out)


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of every `width` bytes; shorter by width - 1 than the data."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    starts = np.arange(n)
    return range_hashes(data, starts, starts + width)


def row_numbers(firsts: np.ndarray) -> np.ndarray:
    """Row of each run, from `spans`' third result."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated aranges."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class Vocabulary:
    """Values of byte strings, worked out once for each distinct one; bounded by emptying it.

    `work` takes a list of bytes and gives an int array; `forget` is called when all is dropped.
    Strings are told apart by a 64-bit hash. What is new gathers in a small sorted table that joins
    the large one from time to time.
    """

    def __init__(self, work, forget=None, most: int = 1_500_000):
        self.work, self.forget, self.most = work, forget, most
        self.clear()

    def clear(self) -> None:
        none = (np.zeros(0, U64), np.zeros(0, np.int64))
        self.tables = [none, none]

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """A value for each range."""
        if sum(len(keys) for keys, _ in self.tables) > self.most:
            self.clear()
            if self.forget:
                self.forget()
        if not len(hashes):
            return np.zeros(0, np.int64)
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        known = np.zeros(len(keys), bool)
        values = np.zeros(len(keys), np.int64)
        for own, of in self.tables:
            if len(own):
                at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                hit = own[at] == keys
                values[hit] = of[at[hit]]
                known |= hit
        fresh = np.flatnonzero(~known)
        if len(fresh):
            raw = data.tobytes()
            where = first[fresh]
            values[fresh] = self.work([raw[s:e] for s, e in zip(starts[where].tolist(), ends[where].tolist())])
            large, small = self.tables
            small = _merged(small, (keys[fresh], values[fresh]))
            if len(small[0]) > max(50_000, len(large[0]) // 4):
                large, small = _merged(large, small), (np.zeros(0, U64), np.zeros(0, np.int64))
            self.tables = [large, small]
        return values[inverse]


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([a[0], b[0]])
    order = np.argsort(keys, kind="stable")
    return keys[order], np.concatenate([a[1], b[1]])[order]
