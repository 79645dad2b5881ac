"""Formats, byte for byte, and what they refuse."""

from __future__ import annotations

import os
import random
import struct

import pytest

from siltbed.functions import bloom, codecs
from siltbed.functions.codecs import Record
from siltbed.model import CorruptRunError, InvalidFilterError

FRUIT = [Record(b"apple", 1, b"red"), Record(b"banana", 2, b"yellow"), Record(b"carrot", 3, b"", True)]


def test_crc32c_known_values_and_lanes():
    assert codecs.crc32c(b"") == 0
    assert codecs.crc32c(b"123456789") == 0xE3069283
    data = os.urandom(70_001)
    table, state = codecs._crc_table().tolist(), 0xFFFFFFFF
    for b in data:
        state = (state >> 8) ^ table[(state ^ b) & 255]
    assert codecs.crc32c(data) == state ^ 0xFFFFFFFF


def test_record_layout_and_round_trip():
    raw = codecs.encode_record(FRUIT[0])
    assert raw == struct.pack("<IIQB", 5, 3, 1, 0) + b"applered"
    for r in (*FRUIT, Record(b"", 7, b""), Record("é".encode(), 2**63, b"\0")):
        assert codecs.decode_record(codecs.encode_record(r)) == (r, 17 + len(r.key) + len(r.value))


@pytest.mark.parametrize(
    ("header", "what"),
    [((1, 1, 1, 1 << 7), "flags"), ((65537, 0, 1, 0), "key length"), ((1, 67108865, 1, 0), "value length"), ((10, 10, 1, 0), "only 5 bytes remain")],
)
def test_record_rules(header, what):
    with pytest.raises(CorruptRunError, match=what):
        codecs.decode_record(struct.pack("<IIQB", *header) + b"12345")


def test_oversize_is_refused_on_write():
    with pytest.raises(ValueError):
        codecs.encode_record(Record(b"k" * 65537, 1))


@pytest.mark.parametrize("codec", [codecs.CODEC_NONE, codecs.CODEC_LZ4])
def test_block_round_trip(codec):
    rows = [Record(b"apple", 1, b"red" * 1000), Record(b"banana", 2, b"yellow" * 1000), FRUIT[2]]
    block = codecs.encode_block(rows, codec)
    assert block[0] == codec and codecs.decode_block(block) == rows
    assert codecs.decode_block(codecs.encode_block([])) == []


def test_incompressible_block_is_stored_raw():
    noise = random.Random(1).randbytes(1 << 16)
    block = codecs.encode_block([Record(b"k", 1, noise)])
    assert block[0] == codecs.CODEC_NONE and codecs.decode_block(block)[0].value == noise


def test_damaged_blocks():
    good = codecs.encode_block(FRUIT, codecs.CODEC_NONE)
    sealed = lambda body: body + struct.pack("<I", codecs.crc32c(body))
    body = good[:-4]
    bad = [
        good[:8], good[:9] + bytes([good[9] ^ 1]) + good[10:], good[:-1] + bytes([good[-1] ^ 1]),
        sealed(bytes([99]) + body[1:]), sealed(body[:1] + struct.pack("<I", len(body) - 5 + 1) + body[5:]), sealed(body[:1] + struct.pack("<I", len(body) - 4) + body[5:] + b"\xff"),
        sealed(b"\0" + struct.pack("<I", 4) + struct.pack("<I", 100)),
    ]
    for raw in bad:
        with pytest.raises(CorruptRunError):
            codecs.decode_block(raw)


def test_compression():
    phrase = b"a phrase of many letters.." * 4096
    packed = codecs.compress(phrase, codecs.CODEC_LZ4)
    assert len(packed) < len(phrase) and codecs.decompress(packed, len(phrase), codecs.CODEC_LZ4) == phrase
    with pytest.raises(ValueError):
        codecs.compress(phrase, 99)
    with pytest.raises(CorruptRunError):
        codecs.decompress(phrase, len(phrase), 99)
    assert codecs.should_compress(100, 87, 0.13) and not codecs.should_compress(100, 90, 0.125) and not codecs.should_compress(-1, 0, 0)


def test_bloom_quality_and_codec():
    present, missing = [b"present-%d" % i for i in range(1000)], [b"missing-%d" % i for i in range(1000)]
    f = bloom.BloomFilter.of(present, 0.01)
    assert f.may_contain(present).all() and (~f.may_contain(missing)).sum() >= 900
    raw = f.encode()
    again = bloom.BloomFilter.decode(raw)
    assert again.encode() == raw and again.may_contain(present).all()
    half = bloom.BloomFilter(f.bits, f.hashes)
    half.add(present[:500])
    rest = bloom.BloomFilter(f.bits, f.hashes)
    rest.add(present[500:])
    half.merge(rest)
    assert half.encode() == raw


def test_bloom_positions_by_hand():
    import xxhash

    h = xxhash.xxh3_128_intdigest(b"apple")
    at, step, want = h & (2**64 - 1), h >> 64, []
    for i in range(7):
        want.append(at % 9592)
        at, step = (at + step) % 2**64, (step + i + 1) % 2**64
    assert bloom.probes([b"apple"], 9592, 7)[0].tolist() == want


@pytest.mark.parametrize(("n", "p"), [(0, 0.01), (10, 0.0), (10, 1.0)])
def test_bloom_arguments(n, p):
    with pytest.raises(InvalidFilterError):
        bloom.parameters(n, p)


def test_bloom_damage():
    raw = bytearray(bloom.BloomFilter.of([b"a"], 0.01).encode())
    with pytest.raises(InvalidFilterError):
        bloom.BloomFilter.decode(bytes(raw[:11]))
    for at, value in ((0, 99), (1, 99), (2, 99), (3, 0), (3, 31), (4, raw[4] + 8)):
        bad = bytearray(raw)
        bad[at] = value
        with pytest.raises(InvalidFilterError):
            bloom.BloomFilter.decode(bytes(bad))
