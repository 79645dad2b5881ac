"""Bloom filters over XXH3-128 with enhanced double hashing, for arrays of keys."""

from __future__ import annotations

import math
import struct

import numpy as np
import xxhash

from siltbed.model import InvalidFilterError

#: Fixed values of the format.
VERSION, HASH_XXH3_128, PROBE_ENHANCED_DOUBLE = 1, 1, 1
HEADER, MAX_HASHES, MAX_BITS = 12, 30, 1 << 31
_STEP_FOR_ZERO = 0x9E3779B97F4A7C15


def parameters(n: int, fpr: float) -> tuple[int, int]:
    """Bits (whole bytes) and hash functions for n keys."""
    if n <= 0 or not 0 < fpr < 1:
        raise InvalidFilterError("keys or false positive rate")
    ideal = math.ceil(-n * math.log(fpr) / math.log(2) ** 2)
    hashes = min(MAX_HASHES, max(1, math.floor(ideal / n * math.log(2) + 0.5)))
    return -(-ideal // 8) * 8, hashes


def probes(keys: list[bytes], bits: int, hashes: int) -> np.ndarray:
    """The bit positions of each key: a row of ``hashes`` of them."""
    whole = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k) for k in keys), ">u8").reshape(-1, 2).astype(np.uint64)
    step, at = whole[:, 0].copy(), whole[:, 1].copy()
    step[step == 0] = np.uint64(_STEP_FOR_ZERO)
    out = np.empty((len(keys), hashes), np.uint64)
    for i in range(hashes):
        out[:, i] = at % np.uint64(bits)
        at += step  # wraps at 2**64 before the remainder is taken
        step += np.uint64(i + 1)
    return out


class BloomFilter:
    def __init__(self, bits: int, hashes: int, data: np.ndarray | None = None):
        self.bits, self.hashes = bits, hashes
        self.data = np.zeros(bits // 8, np.uint8) if data is None else data

    @classmethod
    def of(cls, keys: list[bytes], fpr: float, expected: int | None = None) -> BloomFilter:
        out = cls(*parameters(len(keys) if expected is None else expected, fpr))
        out.add(keys)
        return out

    def add(self, keys: list[bytes]) -> None:
        at = probes(keys, self.bits, self.hashes).reshape(-1)
        np.bitwise_or.at(self.data, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def merge(self, other: BloomFilter) -> None:
        """Takes in the keys of a filter of the same shape; filters of parts of a run add up to the run's."""
        if (self.bits, self.hashes) != (other.bits, other.hashes):
            raise InvalidFilterError("filters differ in shape")
        self.data |= other.data

    def may_contain(self, keys: list[bytes]) -> np.ndarray:
        if not self.bits:
            return np.ones(len(keys), bool)
        at = probes(keys, self.bits, self.hashes)
        return ((self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    def encode(self) -> bytes:
        if not self.hashes or not self.bits or self.bits % 8 or len(self.data) * 8 != self.bits:
            raise InvalidFilterError("shape")
        return struct.pack("<BBBBQ", VERSION, HASH_XXH3_128, PROBE_ENHANCED_DOUBLE, self.hashes, self.bits) + self.data.tobytes()

    @classmethod
    def decode(cls, raw: bytes) -> BloomFilter:
        if len(raw) < HEADER:
            raise InvalidFilterError("header is short")
        version, hashing, probing, hashes, bits = struct.unpack_from("<BBBBQ", raw)
        checks = {
            "version": version == VERSION, "hash": hashing == HASH_XXH3_128, "probe": probing == PROBE_ENHANCED_DOUBLE, "hash count": 1 <= hashes <= MAX_HASHES,
            "bit count": 0 < bits <= MAX_BITS and bits % 8 == 0, "length": len(raw) - HEADER == bits // 8,
        }
        for what, fine in checks.items():
            if not fine:
                raise InvalidFilterError(what)
        return cls(bits, hashes, np.frombuffer(raw, np.uint8, offset=HEADER).copy())
