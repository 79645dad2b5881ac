"""Shared numpy kernels: Arrow text buffers, word hashing, hash tables, ragged gathers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer single text is one chunk of its own.
CHUNK_BYTES = 2 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

#: ``[\x20\x09-\x0D]`` over byte values.
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES, rows: int = 8192) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts (first row, end row, bytes, offsets) of at most ``limit`` bytes, where one text allows it, and ``rows`` rows."""
    data, offsets = text_buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, i + rows, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i up to n."""
    have = _powers.get("p")
    if have is None or len(have) < n + 1:
        size = max(n + 1, (CHUNK_BYTES >> 1) + 1)
        for key, base in (("p", _P), ("q", _PINV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[key] = np.multiply.accumulate(a)
    p, q = _powers["p"], _powers["q"]
    if len(p) > 2 * CHUNK_BYTES + 1 and n <= 2 * CHUNK_BYTES:  # don't keep what one very long text needed
        _powers["p"], _powers["q"] = p[: 2 * CHUNK_BYTES + 1].copy(), q[: 2 * CHUNK_BYTES + 1].copy()
    return p[: n + 1], q[: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal spans have equal hashes wherever they stand. Never 0."""
    p, q = powers(len(data))
    acc = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=acc[1:])
    h = (acc[ends] - acc[starts]) * q[starts]
    h = mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    h[h == 0] = 1
    return h


def blank_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of each text, and n+1 word offsets by text."""
    n = len(data)
    word = ~IS_BLANK[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | cut[:n]))
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each of several runs, one after the other."""
    total = int(lengths.sum())
    base = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return base + np.arange(total, dtype=np.int64)


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def sum_by(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``rows`` in ascending order, and the sum of the ``values`` (a row of them for each) of each."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, np.int64)
    return rows[first], np.add.reduceat(values[order], first, axis=0) if len(first) else values[:0]


class HashTable:
    """Open-addressing table from non-zero 64-bit keys to positions, probed for whole arrays at once."""

    def __init__(self, capacity: int = 1 << 14):
        self.n = 0
        self._alloc(max(1 << 10, 1 << int(np.ceil(np.log2(max(2, capacity * 2))))))

    def _alloc(self, size: int) -> None:
        self.mask, self.shift = np.int64(size - 1), np.uint64(64 - int(size).bit_length() + 1)
        self.keys, self.values = np.zeros(size, np.uint64), np.zeros(size, np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is absent."""
        at = (keys >> self.shift).astype(np.int64)
        seen = self.keys[at]
        out = np.where(seen == keys, self.values[at], -1)
        left = np.flatnonzero((seen != keys) & (seen != 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            i = at[left]
            seen, want = self.keys[i], keys[left]
            hit = seen == want
            out[left[hit]] = self.values[i[hit]]
            left = left[~hit & (seen != 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Insert distinct keys that are absent."""
        if (self.n + len(keys)) * 2 > len(self.keys):
            held = self.keys != 0
            k, v = self.keys[held], self.values[held]
            self._alloc(1 << int(np.ceil(np.log2((self.n + len(keys)) * 4))))
            self.n = 0
            self._place(k, v)
        self._place(keys, values)

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        at = (keys >> self.shift).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            i = at[left]
            free = self.keys[i] == 0
            self.keys[i[free]] = keys[left[free]]
            placed = self.keys[i] == keys[left]
            self.values[i[placed]] = values[left[placed]]
            left = left[~placed]
            at[left] = (at[left] + 1) & self.mask
        self.n += len(keys)
