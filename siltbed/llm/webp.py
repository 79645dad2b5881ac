"""Lossless WebP: a reader of the whole VP8L format and a writer, over numpy arrays.

The reader decodes prefix codes (simple, normal, and several groups chosen by an
entropy image), literals, back-references with the short-distance map and the
colour cache, and inverts the predictor, cross-colour, subtract-green and
palette transforms. Symbols are read one by one from lookup tables; transforms
are inverted by array operations where a sample doesn't wait for its neighbour.

The writer stores a payload as pixels of four 8-bit samples (alpha, red, green,
blue). Runs of at least three pixels that occurred before become back-references, other
pixels that the colour cache holds its symbols, and the rest literals, all in Huffman codes of up
to ``LIMIT`` bits; red, blue and alpha share one where it hardly costs bits. Whether there is a palette (of up to 256 colours, in a picture of any
size), subtract-green or neither, and how large the cache is, is decided by the
estimated bits of each. Small pictures go through the array operations together, which changes no file.

``store`` and the query take null texts as empty; an empty text is stored as one
unit of padding; an empty table gives an empty result. A very long text becomes a
wider picture, from ``MOST_PIXELS`` on several pictures of one width, one file after the
other, so the memory needed has a bound beside the text itself. Equal texts
give equal bytes; where two forms tie, the plainer one is taken. Ids only pass through, nulls
too. Repeated rows give repeated results; kept columns named like a result are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import operator
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltbed.llm.arrays import chunks, offsets_of, ragged

UNIT = 576
MAX_SIDE = 1 << 14
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
#: Fixed values of the format: the order in which code length code lengths are stored.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Fixed values of the format: (dx, dy) of the 120 short distance codes.
SHORT_DISTANCES = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
_CACHE_MULTIPLIER = 0x1E35A7BD
_ALPHABETS = (256 + 24, 256, 256, 256, 40)


class WebPError(ValueError):
    """Bytes that are not a lossless WebP image."""


# ---------------------------------------------------------------- reading


class _Bits:
    """Least significant bit first."""

    def __init__(self, data: bytes):
        self.data, self.end = data, 8 * len(data)
        self.words = np.frombuffer(data + b"\0" * (16 - len(data) % 4), "<u4").tolist()
        self.held = self.n = self.next = 0

    def fill(self) -> None:
        """Holds at least 32 bits; beyond the end they are zeros."""
        if self.n < 32:
            self.held |= (self.words[self.next] if self.next < len(self.words) else 0) << self.n
            self.n, self.next = self.n + 32, self.next + 1

    def read(self, n: int) -> int:
        self.fill()
        value = self.held & ((1 << n) - 1)
        self.held, self.n = self.held >> n, self.n - n
        return value

    @property
    def at(self) -> int:
        return 32 * self.next - self.n

    def between(self, begin: int, end: int) -> int:
        """The bits of a span as one number."""
        return (int.from_bytes(self.data[begin >> 3 : (end + 7) >> 3], "little") >> (begin & 7)) & ((1 << (end - begin)) - 1)

    def skip_to(self, at: int) -> None:
        self.next, self.held, self.n = at >> 5, 0, 0
        self.fill()
        self.held, self.n = self.held >> (at & 31), self.n - (at & 31)

    def check(self) -> None:
        if self.at > self.end:
            raise WebPError("truncated")


@functools.lru_cache(maxsize=32)
def _reversed(n: int) -> np.ndarray:
    """The numbers of n bits with their bits in reverse order."""
    out = np.zeros(1 << n, np.int64)
    for k in range(n):
        out |= ((np.arange(1 << n) >> k) & 1) << (n - 1 - k)
    return out


@functools.lru_cache(maxsize=8)
def _in_reverse(n: int) -> Callable[[list[int]], tuple[int, ...]]:
    """Takes a list's items at the numbers of n bits with their bits in reverse order."""
    return operator.itemgetter(*_reversed(n).tolist())


def _small_table(lengths: list[int]) -> tuple[Sequence[int], int]:
    """The table of a code over few symbols, as that of ``_Code``, and its mask."""
    used = [n << 5 | symbol for symbol, n in enumerate(lengths) if n]
    if len(used) == 1:
        return [(used[0] & 31) << 4], 0
    most = max(lengths)
    flat: list[int] = []
    for x in sorted(used):
        flat += [(x & 31) << 4 | x >> 5] * (1 << (most - (x >> 5)))
    if len(flat) != 1 << most or not used:
        raise WebPError("the code lengths are no complete prefix code")
    return _in_reverse(most)(flat), (1 << most) - 1


class _Code:
    """A canonical prefix code, of ascending symbols and their lengths, as one table over the next bits of the longest code: symbol << 4 | length."""

    def __init__(self, symbols: list[int], lengths: list[int]):
        if len(symbols) == 1:
            self.mask, self.places = 0, np.array(symbols) << 4
            return
        most = max(lengths, default=0)
        both = np.array(lengths, np.int64) << 16 | np.array(symbols, np.int64)
        both.sort()
        size = both >> 16
        times = 1 << (most - size)
        if not len(both) or int(times.sum()) != 1 << most:
            raise WebPError("the code lengths are no complete prefix code")
        self.mask, self.places = (1 << most) - 1, ((both & 0xFFFF) << 4 | size).repeat(times).take(_reversed(most))

    @functools.cached_property
    def table(self) -> list[int]:
        return self.places.tolist()

    def read(self, bits: _Bits) -> int:
        bits.fill()
        found = self.table[bits.held & self.mask]
        bits.held, bits.n = bits.held >> (found & 15), bits.n - (found & 15)
        return found >> 4


def _read_code(bits: _Bits, alphabet: int) -> _Code:
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        symbols = sorted({first, bits.read(8)}) if two else [first]
        if symbols[-1] >= alphabet:
            raise WebPError("a symbol is outside its alphabet")
        return _Code(symbols, [1] * len(symbols))
    own = [0] * 19
    for k in range(4 + bits.read(4)):
        own[CODE_LENGTH_ORDER[k]] = bits.read(3)
    table, mask = _small_table(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    symbols, lengths = [], []
    last, count = 8, 0
    words, held, n, following = bits.words, bits.held, bits.n, bits.next
    while count < alphabet and left > 0:
        left -= 1
        if n < 14:  # a code of up to 7 bits and as many extra ones
            if following >= len(words):
                raise WebPError("truncated")
            held |= words[following] << n
            n += 32
            following += 1
        symbol = table[held & mask]
        held >>= symbol & 15
        n -= symbol & 15
        symbol >>= 4
        if symbol < 16:
            if symbol:
                symbols.append(count)
                lengths.append(symbol)
                last = symbol
            count += 1
        elif symbol == 16:
            again = 3 + (held & 3)
            held >>= 2
            n -= 2
            symbols += range(count, count + again)
            lengths += [last] * again
            count += again
        elif symbol == 17:
            count += 3 + (held & 7)
            held >>= 3
            n -= 3
        else:
            count += 11 + (held & 127)
            held >>= 7
            n -= 7
    bits.held, bits.n, bits.next = held, n, following
    bits.check()
    if count > alphabet:
        raise WebPError("too many code lengths")
    return _Code(symbols, lengths)


def _read_group(bits: _Bits, cache_bits: int) -> list[_Code]:
    """The five codes of a group; one that repeats the bits of the code before, over the same alphabet, is that code."""
    out: list[_Code] = []
    begin = size = before = 0
    for k, alphabet in enumerate(_ALPHABETS):
        alphabet += 1 << cache_bits if k == 0 and cache_bits else 0
        at = bits.at
        if alphabet == before and at + size <= bits.end and bits.between(begin, begin + size) == bits.between(at, at + size):
            bits.skip_to(at + size)
            out.append(out[-1])
        else:
            out.append(_read_code(bits, alphabet))
            begin, size, before = at, bits.at - at, alphabet
    return out


def _extra(bits: _Bits, symbol: int) -> int:
    """A length or distance from its prefix symbol."""
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.read(n) + 1


def _back(bits: _Bits, code: _Code, width: int) -> int:
    """How many pixels a back-reference goes back."""
    distance = _extra(bits, code.read(bits))
    if distance > 120:
        return distance - 120
    dx, dy = SHORT_DISTANCES[distance - 1]
    return max(1, dx + dy * width)


def _run(bits: _Bits, group: list[_Code], out: array, stop: int, width: int, total: int, cache: list[int] | None, cached: int) -> int:
    """Reads pixels with one group of codes until ``stop`` of them are there; returns up to which one the cache has them."""
    (green, gm), (red, rm), (blue, bm), (alpha, am) = ((c.table, c.mask) for c in group[:4])
    held, n, following, words = bits.held, bits.n, bits.next, bits.words
    end, append, at = len(words), out.append, len(out)
    drop = 32 - (len(cache) - 1).bit_length() if cache is not None else 0
    while at < stop:
        if n < 60:  # four codes have up to 15 bits each
            if following + 2 > end:
                if following > end + 4:
                    raise WebPError("truncated")
                words = [*words, 0, 0]
                end += 2
            held |= (words[following] | words[following + 1] << 32) << n
            n += 64
            following += 2
        found = green[held & gm]
        held >>= found & 15
        n -= found & 15
        symbol = found >> 4
        if symbol < 256:
            r = red[held & rm]
            held >>= r & 15
            b = blue[held & bm]
            held >>= b & 15
            a = alpha[held & am]
            held >>= a & 15
            n -= (r & 15) + (b & 15) + (a & 15)
            append((a & 0xFF0) << 20 | (r & 0xFF0) << 12 | symbol << 8 | b >> 4)
            at += 1
        elif symbol < 280:
            bits.held, bits.n, bits.next = held, n, following
            length = _extra(bits, symbol - 256)
            back = _back(bits, group[4], width)
            held, n, following = bits.held, bits.n, bits.next
            if back > at or at + length > total:
                raise WebPError("a back-reference leaves the image")
            if back >= length:
                out.extend(out[at - back : at - back + length])
            else:
                out.extend((out[at - back :] * (length // back + 1))[:length])
            at += length
        else:
            for x in out[cached:]:
                cache[(_CACHE_MULTIPLIER * x & 0xFFFFFFFF) >> drop] = x
            cached = at
            append(cache[symbol - 280])
            at += 1
    bits.held, bits.n, bits.next = held, n, following
    return cached


def _peeked(data: np.ndarray, begin: int, n: int) -> np.ndarray:
    """For each of ``n`` bits from ``begin``, a whole byte's first one, the number that it and the next 24 bits or more make; beyond the end they are zeros."""
    part = np.zeros(n // 8 + 4, np.int64)
    some = data[begin >> 3 : (begin >> 3) + len(part)]
    part[: len(some)] = some
    pair = part[:-1] | part[1:] << 8
    return ((pair[:-2] | pair[2:] << 16)[:, None] >> _EIGHT).reshape(-1)


def _extras(peek: np.ndarray, at: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths or distances from their prefix symbols, with extra bits at ``at``, and the places behind these."""
    n = np.maximum(symbol - 2, 0) >> 1
    value = np.where(symbol < 4, symbol, ((2 + (symbol & 1)) << n) + (peek[at] & ((1 << n) - 1)))
    return value + 1, at + n


_EIGHT = np.arange(8)
#: Bits whose symbols are looked up at once, and how far behind its first bit a symbol can reach.
_SPAN, _REACH = 1 << 17, 64
#: Pictures with fewer pixels are read symbol by symbol.
_MANY = 64


@functools.lru_cache(maxsize=16)
def _short_distances(width: int) -> np.ndarray:
    return np.array([max(1, dx + dy * width) for dx, dy in SHORT_DISTANCES])


def _symbols(bits: _Bits, group: list[_Code], width: int, total: int) -> tuple[np.ndarray, ...]:
    """The symbols of one group of codes up to ``total`` pixels: green symbol, ARGB word, pixels and distance of each.

    The place behind a symbol is worked out for every bit that one could begin at, a span of
    bits at a time; then these places are followed from the first symbol's.
    """
    green, red, blue, alpha, far = group
    data, at, left, out = np.frombuffer(bits.data, np.uint8), bits.at, total, []
    short = _short_distances(width)
    first_table = green.places.astype(np.uint16)
    while left > 0:
        if at > bits.end:
            raise WebPError("truncated")
        base = at & ~7
        span = min(_SPAN, bits.end - base + 8) & ~7
        peek = _peeked(data, base, span + 2 * _REACH)
        first = first_table.take(peek[:span] & green.mask)
        symbol, here = first >> 4, np.arange(span + _REACH)
        place = here[:span] + (first & 15)
        behind: dict[int, np.ndarray] = {}  # the place behind a symbol of each code
        follow = place
        for code in (red, blue, alpha):
            if id(code) not in behind:
                behind[id(code)] = here + (code.places & 15).take(peek[: span + _REACH] & code.mask)
            follow = behind[id(code)].take(follow)
        other = (symbol >= 256).nonzero()[0]
        copied = symbol[other] < 280
        copies, cached = other[copied], other[~copied]
        length, then = _extras(peek, place[copies], symbol[copies].astype(np.int64) - 256)
        found = far.places[peek[then] & far.mask]
        distance, then = _extras(peek, then + (found & 15), found >> 4)
        follow[copies] = then
        follow[cached] = place[cached]
        # places behind the span lead to themselves, so that many steps can be taken between two tests
        step, k, seen = memoryview(np.append(follow, np.arange(span, span + _REACH + 1))), at - base, [at - base]
        while k < span and len(seen) < left:
            seen += [k := step[k] for _ in range(min(128, left - len(seen)))]
        taken = np.array(seen, np.int64)
        taken = taken[: taken.searchsorted(span)]
        k = int(follow[taken[-1]]) if len(taken) else k
        kind = symbol[taken].astype(np.int64)
        pixels, back = np.ones(len(taken), np.int64), np.zeros(len(taken), np.int64)
        refers = ((kind >= 256) & (kind < 280)).nonzero()[0]
        which = np.searchsorted(copies, taken[refers])
        pixels[refers] = length[which]
        back[refers] = np.where(distance[which] > 120, distance[which] - 120, short[np.minimum(distance[which], 120) - 1])
        argb, spot = np.minimum(kind, 255) << 8, place[taken]
        for code, shift in ((red, 16), (blue, 0), (alpha, 24)):
            found = code.places[peek[spot] & code.mask]
            argb |= found >> 4 << shift  # of no meaning, and not used, for what is no literal
            spot = spot + (found & 15)
        ends = np.cumsum(pixels)
        keep = min(len(taken), int(np.searchsorted(ends, left)) + 1)
        at = base + (k if keep == len(taken) else int(taken[keep]))
        left -= int(ends[keep - 1]) if keep else 0
        out.append((kind[:keep], argb[:keep], pixels[:keep], back[:keep]))
    if left < 0:
        raise WebPError("a back-reference leaves the image")
    bits.skip_to(at)
    bits.check()
    return tuple(np.concatenate(column) for column in zip(*out, strict=True))


def _resolved(kind: np.ndarray, argb: np.ndarray, pixels: np.ndarray, back: np.ndarray, cache_bits: int) -> np.ndarray | None:
    """Pixels from symbols: each names the earlier pixel that it repeats, until that is a literal. Nothing if an empty place of the cache is read."""
    begin = np.cumsum(pixels) - pixels
    n = int(pixels.sum())
    source = np.arange(n)
    copies = np.flatnonzero(back)
    if (back[copies] > begin[copies]).any():
        raise WebPError("a back-reference leaves the image")
    spread = ragged(begin[copies], pixels[copies])
    source[spread] -= np.repeat(back[copies], pixels[copies])
    value = np.zeros(n, np.uint32)
    value[begin] = argb.astype(np.uint32)
    hits = kind >= 280
    if hits.any():
        origin = source
        while (origin != (origin := origin[origin])).any():
            pass
        slot = ((value * np.uint32(_CACHE_MULTIPLIER)) >> np.uint32(32 - cache_bits)).astype(np.int64)
        slot[begin[hits]] = kind[hits] - 280
        slot = slot[origin]
        order = np.argsort(slot.astype(np.uint16), kind="stable")
        before = np.full(n, -1)
        before[order[1:]] = np.where(slot[order[1:]] == slot[order[:-1]], order[:-1], -1)
        source[begin[hits]] = before[begin[hits]]
        if (source < 0).any():
            return None
    while (source != (source := source[source])).any():
        pass
    return value[source]


def _read_pixels(bits: _Bits, width: int, height: int, outermost: bool) -> np.ndarray:
    """An entropy-coded image as ARGB words."""
    cache_bits = 0
    if bits.read(1):
        cache_bits = bits.read(4)
        if not 1 <= cache_bits <= 11:
            raise WebPError("colour cache size")
    prefix, shift, groups = None, 0, 1
    if outermost and bits.read(1):
        shift = bits.read(3) + 2
        across = (width + (1 << shift) - 1) >> shift
        image = _read_pixels(bits, across, (height + (1 << shift) - 1) >> shift, False)
        prefix = ((image >> np.uint32(8)) & np.uint32(0xFFFF)).reshape(-1, across)
        groups = int(prefix.max()) + 1
    codes = [_read_group(bits, cache_bits) for _ in range(groups)]
    n, out, cached = width * height, array("I"), 0
    if prefix is None and n >= _MANY:
        begin = bits.at
        found = _resolved(*_symbols(bits, codes[0], width, n), cache_bits)
        if found is not None:
            return found
        bits.skip_to(begin)
    cache = [0] * (1 << cache_bits) if cache_bits else None
    while len(out) < n:
        at = len(out)
        group, stop = 0, n
        if prefix is not None:  # up to the next tile of the row
            x, y = at % width, at // width
            group, stop = int(prefix[y >> shift, x >> shift]), y * width + min(width, ((x >> shift) + 1) << shift)
        cached = _run(bits, codes[group], out, stop, width, n, cache, cached)
        bits.check()
    return np.array(out, np.uint32)


def _channels(argb: np.ndarray) -> np.ndarray:
    """A height x width array of words as samples in the order blue, green, red, alpha."""
    return np.ascontiguousarray(argb, "<u4").view(np.uint8).reshape(*argb.shape, 4)


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _clamp(a: np.ndarray) -> np.ndarray:
    return np.clip(a, 0, 255)


def _predict(mode: int, left: np.ndarray, top: np.ndarray, top_right: np.ndarray, top_left: np.ndarray) -> np.ndarray:
    """The predictions of the format's 14 modes, for samples as integers."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode == 6:
        return _average(left, top_left)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(top_left, top)
    if mode == 9:
        return _average(top, top_right)
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    if mode == 11:
        near_left = np.abs(top - top_left).sum() < np.abs(left - top_left).sum()
        return left if near_left else top
    if mode == 12:
        return _clamp(left + top - top_left)
    if mode == 13:
        mean = _average(left, top)
        gap = mean - top_left
        return _clamp(mean + np.sign(gap) * (np.abs(gap) // 2))  # halves towards zero
    return np.array([0, 0, 0, 255])


def _invert_predictor(argb: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    height, width = argb.shape
    px = _channels(argb).astype(np.int64)
    px[0, 0] += (0, 0, 0, 255)
    px[0] = np.cumsum(px[0], axis=0) & 255
    px[1:, 0] = np.cumsum(np.concatenate([px[:1, 0], px[1:, 0]]), axis=0)[1:] & 255
    kinds = (modes >> np.uint32(8)) & np.uint32(15)
    for y in range(1, height):
        row, above = px[y], px[y - 1]
        for tile in range((width + (1 << shift) - 1) >> shift):
            low, high = max(1, tile << shift), min(width, (tile + 1) << shift)
            mode = int(kinds[y >> shift, tile])
            if mode in (0, 2, 3, 4, 8, 9) or mode >= 14:  # needs nothing of this row
                right = np.concatenate([above[low + 1 : high + 1], row[:1]])[: high - low]
                row[low:high] = (row[low:high] + _predict(mode, row[low:high], above[low:high], right, above[low - 1 : high - 1])) & 255
            elif mode == 1:
                row[low:high] = np.cumsum(np.concatenate([row[low - 1 : low], row[low:high]]), axis=0)[1:] & 255
            else:
                for x in range(low, high):
                    right = above[x + 1] if x + 1 < width else row[0]
                    row[x] = (row[x] + _predict(mode, row[x - 1], above[x], right, above[x - 1])) & 255
    return px.astype(np.uint8).view("<u4").reshape(height, width)


def _colour_delta(factor: np.ndarray, sample: np.ndarray) -> np.ndarray:
    return (factor.astype(np.int8).astype(np.int32) * sample.astype(np.int8).astype(np.int32)) >> 5


def _invert_cross_colour(argb: np.ndarray, factors: np.ndarray, shift: int) -> np.ndarray:
    height, width = argb.shape
    px = _channels(argb).copy()
    each = _channels(factors.astype(np.uint32))[np.arange(height)[:, None] >> shift, np.arange(width)[None, :] >> shift]
    green = px[..., 1]
    red = (px[..., 2] + _colour_delta(each[..., 0], green)).astype(np.uint8)
    blue = px[..., 0] + _colour_delta(each[..., 1], green) + _colour_delta(each[..., 2], red)
    px[..., 2], px[..., 0] = red, blue.astype(np.uint8)
    return px.view("<u4").reshape(height, width)


def _invert_green(argb: np.ndarray) -> np.ndarray:
    px = _channels(argb).copy()
    px[..., 0] += px[..., 1]
    px[..., 2] += px[..., 1]
    return px.view("<u4").reshape(argb.shape)


def _pack_shift(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _invert_palette(argb: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    shift = _pack_shift(len(palette))
    index = (argb >> np.uint32(8)) & np.uint32(255)
    if shift:
        bits = 8 >> shift
        parts = (index[..., None] >> (np.arange(1 << shift, dtype=np.uint32) * np.uint32(bits))) & np.uint32((1 << bits) - 1)
        index = parts.reshape(len(argb), -1)[:, :width]
    table = np.zeros(256, np.uint32)
    table[: len(palette)] = palette
    return table[index]


def decode(data: bytes) -> np.ndarray:
    """A height x width array of ARGB words from a lossless WebP file."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise WebPError("not a lossless WebP file")
    size = struct.unpack("<I", data[16:20])[0]
    if len(data) < 20 + size or data[20] != 0x2F:
        raise WebPError("truncated or without its signature")
    bits = _Bits(data[21 : 20 + size])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    alpha_used = bits.read(1)
    if bits.read(3):
        raise WebPError("version")
    across, steps, seen = width, [], set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise WebPError("a transform is given twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = bits.read(3) + 2
            tiles = (across + (1 << shift) - 1) >> shift
            image = _read_pixels(bits, tiles, (height + (1 << shift) - 1) >> shift, False).reshape(-1, tiles)
            steps.append((kind, across, image, shift))
        elif kind == SUBTRACT_GREEN:
            steps.append((kind, across, None, 0))
        else:
            n = bits.read(8) + 1
            palette = _read_pixels(bits, n, 1, False)
            palette = np.cumsum(_channels(palette.reshape(1, -1))[0], axis=0, dtype=np.uint8).view("<u4").reshape(-1)
            steps.append((kind, across, palette, 0))
            shift = _pack_shift(n)
            across = (across + (1 << shift) - 1) >> shift
    argb = _read_pixels(bits, across, height, True).reshape(height, across)
    for kind, before, extra, shift in reversed(steps):
        if kind == PREDICTOR:
            argb = _invert_predictor(argb, extra, shift)
        elif kind == CROSS_COLOUR:
            argb = _invert_cross_colour(argb, extra, shift)
        elif kind == SUBTRACT_GREEN:
            argb = _invert_green(argb)
        else:
            argb = _invert_palette(argb, extra, before)
    return argb if alpha_used else argb | np.uint32(0xFF000000)


# ---------------------------------------------------------------- writing

#: Longest Huffman code that is written, of the code of code lengths too; bits of the cache, where there is one; least and most pixels of a back-reference, and how far back it goes.
LIMIT, LENGTHS_LIMIT, CACHE, SHORTEST, LONGEST, FARTHEST = 12, 7, 8, 3, 4096, (1 << 20) - 120
#: Red, blue and alpha share one code, which is built and read once, where that costs at most this share more bits.
_SHARED = 0.06
#: Estimated bits that a symbol's code length takes.
_SYMBOL_BITS = 7
_GREEN, _RED, _BLUE, _ALPHA = 1, 2, 0, 3
_OTHERS = [_RED, _BLUE, _ALPHA]
#: Pictures that are worked on together have up to 2^13 pixels each, are up to 2^6, and have so many pixels in all.
_SMALL_BITS, _GROUP_BITS, _TOGETHER = 13, 6, 1 << 14


_NONE = np.zeros(0, np.int64)


class _Fields:
    """Numbers of given widths, written one after the other."""

    def __init__(self):
        self.values: list[np.ndarray] = []
        self.widths: list[np.ndarray] = []
        self.last: tuple[list[int], list[int]] = [], []  # not yet arrays

    def put(self, values: list[int], widths: list[int]) -> None:
        self.last[0].extend(values)
        self.last[1].extend(widths)

    def put_arrays(self, values: np.ndarray, widths: np.ndarray) -> None:
        if self.last[0]:
            self.values.append(np.array(self.last[0], np.int64))
            self.widths.append(np.array(self.last[1], np.int64))
            self.last = [], []
        self.values.append(values)
        self.widths.append(widths)

    def close(self) -> int:
        """How many numbers there are."""
        self.put_arrays(_NONE, _NONE)
        return sum(map(len, self.values))


def _packed(fields: list[_Fields]) -> list[bytes]:
    """The bytes of each, filled up with zeros."""
    first = offsets_of(np.array([f.close() for f in fields]))
    values, widths = (np.concatenate([x for f in fields for x in column(f)]) for column in (operator.attrgetter("values"), operator.attrgetter("widths")))
    ends = offsets_of(widths)
    begin = ends[first]
    sizes = np.diff(begin)
    words = offsets_of((sizes + 31) >> 5)  # each begins at a word of its own
    at = ends[:-1] + (32 * words[:-1] - begin[:-1]).repeat(np.diff(first))
    word, shifted = at >> 5, values << (at & 31)
    n = int(words[-1]) + 2
    # bits of different numbers never meet, so sums are unions; 32 bits are exact as floats
    low = np.bincount(word, weights=shifted & 0xFFFFFFFF, minlength=n)
    low[1:] += np.bincount(word, weights=shifted >> 32, minlength=n)[: n - 1]
    raw = low.astype("<u4").tobytes()
    return [raw[4 * k : 4 * k + (size + 7) // 8] for k, size in zip(words.tolist(), sizes.tolist(), strict=False)]


def _depths(weights: list[int]) -> list[int]:
    """Huffman code lengths for ascending weights: the two lightest of leaves and inner nodes, which also come in ascending order, are joined."""
    n = len(weights)
    none = sum(weights) + 1
    leaves, inner, parent = [*weights, none], [none] * n, [0] * (2 * n - 1)
    leaf, node = leaves[0], none
    i = j = 0
    for k in range(n - 1):
        if leaf <= node:
            total = leaf
            parent[i] = k
            i += 1
            leaf = leaves[i]
        else:
            total = node
            parent[n + j] = k
            j += 1
            node = inner[j]
        if leaf <= node:
            total += leaf
            parent[i] = k
            i += 1
            leaf = leaves[i]
        else:
            total += node
            parent[n + j] = k
            j += 1
            node = inner[j]
        inner[k] = total
        if j == k:
            node = total
    depth = [0] * (n - 1)
    for k in range(n - 3, -1, -1):
        depth[k] = depth[parent[n + k]] + 1
    return [depth[k] + 1 for k in parent[:n]]


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of a complete prefix code over the symbols that occur, of at most ``limit`` bits; 1 where there is one symbol alone."""
    used = counts.nonzero()[0]
    out = np.zeros(len(counts), np.int64)
    if len(used) == 1:
        out[used] = 1
        return out
    order = used[counts[used].argsort(kind="stable")]
    weights = counts[order]
    while True:
        depths = _depths(weights.tolist())
        if depths[0] <= limit:
            out[order] = depths
            return out
        weights = (weights + 1) >> 1  # flatter, in the end equal


def _codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits, reversed for writing, and how many of them, by symbol; a symbol that is alone takes none."""
    used = lengths.nonzero()[0]
    code = np.zeros(len(lengths), np.int64)
    if len(used) < 2:
        return code, code
    size = lengths[used]
    by_size = size.argsort(kind="stable")
    size = size[by_size]
    most = int(size[-1])
    step = 1 << (most - size)
    code[used[by_size]] = _reversed(most)[step.cumsum() - step]
    return code, lengths


@functools.lru_cache(maxsize=1 << 14)
def _repeated(value: int, n: int) -> list[int]:
    """The symbols that store a code length ``n`` times: symbol, extra bits << 5, and number of these << 12."""
    out = []
    if value:
        out.append(value)
        n -= 1
    while n >= 3:
        if value:
            symbol, low, most, width = 16, 3, 6, 2
        else:
            symbol, low, most, width = (18, 11, 138, 7) if n >= 11 else (17, 3, 10, 3)
        take = min(n, most)
        out.append(symbol | (take - low) << 5 | width << 12)
        n -= take
    return out + [value] * n


#: What stores a code: numbers and their widths as lists, then as arrays; with the code's bits and sizes by symbol.
_Stored = tuple[list[int], list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]
_NOUGHT = np.zeros(1, np.int64)
_ORDER = operator.itemgetter(*CODE_LENGTH_ORDER)


def _write_code(counts: np.ndarray) -> _Stored:
    """A code for symbols with the given counts."""
    used = counts.nonzero()[0]
    if len(used) < 2 and (not len(used) or used[0] < 256):
        nothing = np.zeros(len(counts), np.int64)
        return [1, 0, 1, int(used.sum())], [1, 1, 1, 8], _NONE, _NONE, nothing, nothing
    lengths = code_lengths(counts, LIMIT)
    code, size = _codes(lengths)
    if len(used) <= 2 and used[-1] < 256:  # a simple code
        return [1, 1, 1, *used.tolist()], [1, 1, 1, 8, 8], _NONE, _NONE, code, size
    begins = np.concatenate([_NOUGHT, (lengths[1:] != lengths[:-1]).nonzero()[0] + 1, [len(lengths)]])
    tokens: list[int] = []
    for value, n in zip(lengths[begins[:-1]].tolist(), (begins[1:] - begins[:-1]).tolist(), strict=True):
        if n == 1:
            tokens.append(value)
        else:
            tokens += _repeated(value, n)
    token = np.array(tokens)
    symbol = token & 31
    own = code_lengths(np.bincount(symbol, minlength=19), LENGTHS_LIMIT)
    in_order = [*_ORDER(own.tolist())]
    while len(in_order) > 4 and not in_order[-1]:
        in_order.pop()
    bits, sizes = _codes(own)
    each = sizes[symbol]
    return [0, len(in_order) - 4, *in_order, 0], [1, 4, *[3] * len(in_order), 1], bits[symbol] | (token >> 5 & 127) << each, each + (token >> 12), code, size


def _prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number of lengths or distances."""
    x = values - 1
    high = np.frexp(np.maximum(x, 1).astype(np.float64))[1].astype(np.int64) - 1
    n = np.where(x < 4, 0, high - 1)
    return np.where(x < 4, x, 2 * high + ((x >> np.maximum(high - 1, 0)) & 1)), np.where(x < 4, 0, x & ((1 << np.maximum(n, 0)) - 1)), n


@functools.lru_cache(maxsize=16)
def _short_codes(width: int) -> dict[int, int]:
    return {max(1, dx + dy * width): k + 1 for k, (dx, dy) in reversed(list(enumerate(SHORT_DISTANCES)))}


def _references(px: np.ndarray, begin: np.ndarray, who: np.ndarray) -> np.ndarray:
    """(first pixel, length, distance) of runs that occurred before in their picture, none over another."""
    n = len(px) - SHORTEST + 1
    if n < 2:
        return np.zeros((0, 3), np.int64)
    wide = px.astype(np.uint64)
    gram = np.zeros(n, np.uint64)
    for k in range(SHORTEST):
        gram = (gram ^ wide[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        gram ^= gram >> np.uint64(29)
    # sorted by picture, bits of the gram, and place: what is alike stands together in ascending order
    place_bits, who_bits = (_SMALL_BITS, 64 - _GROUP_BITS) if len(begin) > 2 or len(px) <= 1 << _SMALL_BITS else (28, 63)
    place = np.arange(n) - begin[who[:n]]
    inside = (place < (np.diff(begin) - SHORTEST + 1)[who[:n]]).nonzero()[0]
    gram_bits = who_bits - place_bits
    key = who[inside].astype(np.uint64) << np.uint64(who_bits) | (gram[inside] >> np.uint64(64 - gram_bits)) << np.uint64(place_bits) | place[inside].astype(np.uint64)
    key.sort()
    gram = key >> np.uint64(place_bits)
    same = (gram[1:] == gram[:-1]).nonzero()[0]
    first, mask = begin[(key[same] >> np.uint64(who_bits)).astype(np.int64)], np.uint64((1 << place_bits) - 1)
    at, before = first + (key[same + 1] & mask).astype(np.int64), first + (key[same] & mask).astype(np.int64)
    fine = at - before <= FARTHEST
    for k in range(SHORTEST):
        fine &= px[at + k] == px[before + k]
    back = np.zeros(n, np.int64)
    back[at[fine]] = (at - before)[fine]
    begins = np.append(True, back[1:] != back[:-1]).nonzero()[0]
    ends = np.append(begins[1:], n)
    some = back[begins] > 0
    out, place = [], 0
    for begin, end, distance in zip(begins[some].tolist(), ends[some].tolist(), back[begins[some]].tolist(), strict=True):
        begin = max(begin, place)
        end += SHORTEST - 1  # of the pixels that repeat
        while end - begin >= SHORTEST:
            length = min(LONGEST, end - begin)
            out.append((begin, length, distance))
            begin = place = begin + length
    return np.array(out, np.int64).reshape(-1, 3)


_FIXED = 16


@functools.lru_cache(maxsize=1)
def _n_logs() -> np.ndarray:
    return _n_log(np.arange(1 << (_SMALL_BITS + 2)))


def _n_log(n: np.ndarray) -> np.ndarray:
    return np.rint(n * np.log2(np.maximum(n, 1)) * (1 << _FIXED)).astype(np.int64)


def _bits_of(counts: np.ndarray, total: np.ndarray, alphabets: int) -> np.ndarray:
    """Estimated bits of symbols with each row's counts, ``total`` in each of so many alphabets, and of their codes; as whole numbers, so that other rows change nothing."""
    table = _n_logs()
    n_log = table.take if total.max() < len(table) else _n_log
    return alphabets * n_log(total) - n_log(counts).sum(axis=1) + (_SYMBOL_BITS * np.count_nonzero(counts, axis=1) << _FIXED)


_CHANNELS = np.arange(0, 1024, 256)


def _by_channel(sample: np.ndarray, who: np.ndarray, pictures: int) -> np.ndarray:
    """How often each sample value occurs in each channel of each picture."""
    return np.bincount(((who << 10)[:, None] + (sample + _CHANNELS)).reshape(-1), minlength=pictures << 10).reshape(pictures, 1024)


def _slots(px: np.ndarray, who: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Cache slot of each pixel, and whether it has the pixel when its turn comes."""
    slot = ((px * np.uint32(_CACHE_MULTIPLIER)) >> np.uint32(32 - bits)).astype(np.int64)
    key = (who << bits | slot) << 28 | np.arange(len(px))
    key.sort()
    order, key = key & ((1 << 28) - 1), key >> 28
    hit, ordered = np.zeros(len(px), bool), px[order]
    hit[order[1:]] = (key[1:] == key[:-1]) & (ordered[1:] == ordered[:-1])
    return slot, hit


def _write_pixels(fields: list[_Fields], images: list[np.ndarray], outermost: bool) -> None:
    """Entropy-coded images: cache size, one group of codes, symbols of each."""
    m, begin = len(images), offsets_of(np.array([x.size for x in images]))
    px = np.concatenate([x.reshape(-1) for x in images])
    who = np.arange(m).repeat(np.diff(begin))
    sample = _channels(px)
    runs = _references(px, begin, who)
    at, of = runs[:, 0], who[runs[:, 0]]
    alone = np.ones(len(px), bool)
    alone[ragged(at, runs[:, 1])] = False
    single = alone.nonzero()[0]
    n_single = np.bincount(who[single], minlength=m)
    length, length_extra, length_n = _prefixed(runs[:, 1])
    short = [_short_codes(x.shape[1]) for x in images]
    distance, distance_extra, distance_n = _prefixed(np.array([short[k].get(d, d + 120) for k, d in zip(of.tolist(), runs[:, 2].tolist(), strict=True)], np.int64))
    lengths = np.bincount(of * 24 + length, minlength=24 * m).reshape(m, 24)
    slot, hit = _slots(px, who, CACHE)
    bits = []
    for held, plain in ((single[:0], single), (single[hit[single]], single[~hit[single]])):  # without the cache, and with it
        hits = np.bincount(who[held] << CACHE | slot[held], minlength=m << CACHE).reshape(m, -1)
        each = _by_channel(sample[plain], who[plain], m).reshape(m, 4, 256)
        green, others = np.concatenate([each[:, _GREEN], lengths, hits], axis=1), each[:, _OTHERS]
        n_plain = np.bincount(who[plain], minlength=m)
        rest = _bits_of(others.reshape(m, 768), n_plain, 3)
        bits.append((_bits_of(green, n_single + np.bincount(of, minlength=m), 1) + rest, rest, n_plain, green, others))
    cached = (n_single >= 64) & (bits[1][0] < bits[0][0])
    total, rest, n_plain, green, others = (np.where(cached.reshape(-1, *[1] * (x.ndim - 1)), y, x) for x, y in zip(*bits, strict=True))
    together = others.sum(axis=1)
    # three codes that were alike would take so many bits
    shared = _bits_of(together, 3 * n_plain, 1) + (2 * _SYMBOL_BITS * np.count_nonzero(together, axis=1) << _FIXED)
    shared = (np.count_nonzero(others, axis=2).max(axis=1) > 1) & (shared <= rest + _SHARED * total)
    distances = np.bincount(of * 40 + distance, minlength=40 * m).reshape(m, 40)
    n_green = green.shape[1]
    tables = [np.zeros((m, n), np.int64) for n in (n_green, 256, 256, 256, 40)]  # value << 5 | width
    for k in range(m):
        fields[k].put([1, CACHE] if cached[k] else [0], [1, 4] if cached[k] else [1])
        if outermost:
            fields[k].put([0], [1])  # no entropy image
        own = [_write_code(together[k])] * 3 if shared[k] else [_write_code(c) for c in others[k]]
        own = [_write_code(green[k] if cached[k] else green[k, : _ALPHABETS[0]]), *own, _write_code(distances[k])]
        for table, (numbers, widths, more, wide, code, size) in zip(tables, own, strict=True):
            fields[k].put(numbers, widths)
            if len(more):
                fields[k].put_arrays(more, wide)
            table[k, : len(code)] = code << 5 | size
    tables = [x.reshape(-1) for x in tables]
    both = np.zeros((len(px), 4), np.int64)
    from_cache = hit & cached[who]
    plain, held = single[~from_cache[single]], single[from_cache[single]]
    literal, own = sample[plain], who[plain] << 8
    both[plain] = np.stack([tables[0].take(who[plain] * n_green + literal[:, _GREEN]), *[table.take(own + literal[:, channel]) for channel, table in zip(_OTHERS, tables[1:4], strict=True)]], axis=1)
    both[held, 0] = tables[0][who[held] * n_green + _ALPHABETS[0] + slot[held]]
    both[at] = np.stack([tables[0][of * n_green + 256 + length], length_extra << 5 | length_n, tables[4][of * 40 + distance], distance_extra << 5 | distance_n], axis=1)
    alone[at] = True
    both = both[alone].reshape(-1)
    first = 4 * offsets_of(alone)[begin]
    values, widths = both >> 5, both & 31
    for k, (i, j) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        fields[k].put_arrays(values[i:j], widths[i:j])


def _palette_image(argb: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """Places in the palette, in the green samples; several to a pixel where there are few colours."""
    height, width = argb.shape
    index, shift = np.searchsorted(palette, argb).astype(np.uint32), _pack_shift(len(palette))
    if shift:
        per, bits = 1 << shift, 8 >> shift
        index = np.pad(index, ((0, 0), (0, -width % per))).reshape(height, -1, per)
        index = (index << (np.arange(per, dtype=np.uint32) * np.uint32(bits))).sum(axis=2, dtype=np.uint32)
    return np.uint32(0xFF000000) | index << np.uint32(8)


def _subtract_green(sample: np.ndarray) -> np.ndarray:
    out = sample.copy()
    out[..., _BLUE] -= sample[..., _GREEN]
    out[..., _RED] -= sample[..., _GREEN]
    return out


def _distinct(px: np.ndarray) -> np.ndarray:
    ordered = np.sort(px)
    return ordered[np.append(True, ordered[1:] != ordered[:-1])]


def _palette(px: np.ndarray) -> np.ndarray | None:
    """The colours, if there are at most 256."""
    found = _distinct(px[:512])
    if len(px) > 512 and len(found) <= 256:  # with more colours there, the whole has more, too
        found = _distinct(px)
    return found if len(found) <= 256 else None


def _forms(images: list[np.ndarray]) -> list[tuple[int | None, np.ndarray | None, np.ndarray]]:
    """The transform of the fewest estimated bits (none, subtract-green or the palette), the palette, and the picture to write of each."""
    m, begin = len(images), offsets_of(np.array([x.size for x in images]))
    who, sample = np.arange(m).repeat(np.diff(begin)), _channels(np.concatenate([x.reshape(-1) for x in images]))
    greenless = _subtract_green(sample)
    plain, green = (_bits_of(_by_channel(x, who, m), np.diff(begin), 4).tolist() for x in (sample, greenless))
    out = []
    for k, argb in enumerate(images):
        form, least = (None, None, argb), plain[k]
        if green[k] < least:
            form, least = (SUBTRACT_GREEN, None, greenless[begin[k] : begin[k + 1]].view("<u4").reshape(argb.shape)), green[k]
        palette = _palette(argb.reshape(-1))
        if palette is not None:
            index = _palette_image(argb, palette)
            counts = _by_channel(_channels(index.reshape(-1)), np.zeros(index.size, np.int64), 1)
            if int(_bits_of(counts, np.array([index.size]), 4)[0]) + (4 * _SYMBOL_BITS * len(palette) << _FIXED) < least:
                form = PALETTE, palette, index
        out.append(form)
    return out


def encode_all(images: list[np.ndarray]) -> list[bytes]:
    """Lossless WebP files of height x width arrays of ARGB words; each is the same in any company."""
    images = [np.ascontiguousarray(x, np.uint32) for x in images]
    if not all(0 < n <= MAX_SIDE for x in images for n in x.shape):
        raise WebPError("image size")
    out: list[bytes] = []
    for group in _groups([x.size for x in images]):
        out += _encode_group(images[group])
    return out


def _groups(sizes: list[int]) -> Iterator[slice]:
    """Neighbours that are worked on together: small ones up to a bound, larger ones alone."""
    begin = total = 0
    for k, size in enumerate(sizes):
        if k > begin and (total + size > _TOGETHER or k - begin == 1 << _GROUP_BITS or max(size, total if k - begin == 1 else 0) > 1 << _SMALL_BITS):
            yield slice(begin, k)
            begin, total = k, 0
        total += size
    if sizes:
        yield slice(begin, len(sizes))


def _encode_group(images: list[np.ndarray]) -> list[bytes]:
    forms, fields = _forms(images), [_Fields() for _ in images]
    palettes = []
    for argb, (kind, palette, _), own in zip(images, forms, fields, strict=True):
        height, width = argb.shape
        own.put([0x2F, width - 1, height - 1, 1, 0], [8, 14, 14, 1, 3])
        if kind is not None:
            own.put([1, kind], [1, 2])
        if kind == PALETTE:
            own.put([len(palette) - 1], [8])
            steps = _channels(palette)
            palettes.append((own, np.concatenate([steps[:1], np.diff(steps, axis=0)]).astype(np.uint8).view("<u4").reshape(1, -1)))
    if palettes:
        _write_pixels(*map(list, zip(*palettes, strict=True)), False)
    for own in fields:
        own.put([0], [1])
    _write_pixels(fields, [image for _, _, image in forms], True)
    out = []
    for body in _packed(fields):
        chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
        out.append(b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk)
    return out


def encode(argb: np.ndarray) -> bytes:
    """A lossless WebP file of a height x width array of ARGB words."""
    return encode_all([argb])[0]


# ---------------------------------------------------------------- columns


def padded(text: bytes) -> bytes:
    """``text`` with bytes 255 up to a positive multiple of the unit."""
    return text + b"\xff" * ((-len(text)) % UNIT or (UNIT if not text else 0))


#: Pixels of four samples across, rows of them in the tallest picture (wider ones have a multiple), and pixels of the largest picture.
ACROSS = 12
MOST_PIXELS = 6 * ACROSS * MAX_SIDE


def store_all(texts: list[bytes]) -> list[bytes]:
    """The WebP file of each padded text, or files one after the other; what is missing to a whole row is filled with bytes 255."""
    images, files = [], []
    for text in texts:
        payload = np.frombuffer(padded(text), "<u4")
        width = ACROSS * -(-min(len(payload), MOST_PIXELS) // (ACROSS * MAX_SIDE))
        files.append(-(-len(payload) // MOST_PIXELS))
        for i in range(0, len(payload), MOST_PIXELS):
            part = payload[i : i + MOST_PIXELS]
            images.append((np.concatenate([part, np.full(-len(part) % width, 0xFFFFFFFF, "<u4")]) if len(part) % width else part).reshape(-1, width))
    found = iter(encode_all(images))
    return [b"".join(itertools.islice(found, n)) for n in files]


def store(text: bytes) -> bytes:
    return store_all([text])[0]


def pictures(media: bytes) -> Iterator[np.ndarray]:
    """The pictures of files one after the other."""
    at = 0
    while at < len(media) or not at:
        yield decode(media[at:] if at else media)
        at += 8 + struct.unpack_from("<I", media, at + 4)[0]


def load(media: bytes, n_bytes: int) -> tuple[bytes, np.ndarray]:
    """The payload of ``n_bytes`` of text, and the pixels."""
    argb = np.concatenate(list(pictures(media)))
    size = max(UNIT, n_bytes + -n_bytes % UNIT)
    return np.ascontiguousarray(argb, "<u4").tobytes()[:size], argb


def feature(argb: np.ndarray) -> str:
    """Size of the picture, and mean and spread of each channel (alpha, red, green, blue)."""
    px = _channels(argb).reshape(-1, 4)
    n = len(px)
    total = px.sum(axis=0, dtype=np.int64)
    square = np.einsum("ij,ij->j", px, px, dtype=np.int64)
    mean = total / n
    spread = np.sqrt(np.maximum(0, square / n - mean * mean))
    return f"{argb.shape[1]}x{argb.shape[0]}:" + ",".join(f"{mean[k]:.3f}/{spread[k]:.3f}" for k in (3, 2, 1, 0))


RESULTS = [
    T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()),
]


def _texts(column: pa.Array) -> Iterator[list[bytes]]:
    """The bytes of texts, of a bounded size at once where one text allows it."""
    for _, _, data, at in chunks(column):
        raw = data.tobytes()
        yield [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def media_column(df: DataFrame, text: str = "text", name: str = "media") -> DataFrame:
    """``df`` with the text's WebP file as a binary column."""
    others = [c for c in df.columns if c != name]

    def run(batches):
        for batch in batches:
            media = [x for texts in _texts(batch.column(0)) for x in store_all(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(media, pa.binary())], names=[*others, name])

    schema = T.StructType([df.schema[c] for c in others] + [T.StructField(name, T.BinaryType())])
    return df.select(F.col(text).alias("__text"), *others).mapInArrow(run, schema)


def pixels(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with width, height and argb (samples alpha, red, green, blue of each pixel, row by row) of a column of WebP files.

    Files of one width one after the other are one picture below the other. A null or broken file, or
    files of several widths, give nulls in all three.
    """
    results = [T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("argb", T.BinaryType())]
    others = [c for c in df.columns if c not in ("width", "height", "argb")]

    def one(raw: bytes | None):
        try:
            image = np.concatenate(list(pictures(raw))) if raw is not None else None
        except (WebPError, ValueError, struct.error):
            image = None
        return (None, None, None) if image is None else (image.shape[1], image.shape[0], image.astype(">u4").tobytes())

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                wide, high, argb = one(batch.column(0)[k].as_py())
                yield pa.RecordBatch.from_arrays([*(c.slice(k, 1) for c in batch.columns[1:]), pa.array([wide], pa.int32()), pa.array([high], pa.int32()), pa.array([argb], pa.binary())], names=[*others, "width", "height", "argb"])

    return df.select(F.col(media).alias("__media"), *others).mapInArrow(run, T.StructType([df.schema[c] for c in others] + results))


def describe(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with digests and features of each text's stored picture, taken from what is read back of it."""
    names = [f.name for f in RESULTS]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    schema = T.StructType([df.schema[c] for c in kept] + RESULTS)

    def one(raw: bytes, media: bytes):
        payload, argb = load(media, len(raw))
        return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(argb)

    def run(batches):
        for batch in batches:
            rows = [one(*x) for texts in _texts(batch.column(0)) for x in zip(texts, store_all(texts), strict=True)]
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], names=schema.names)

    return df.select(F.col(text).alias("__text"), *kept).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return describe(docs, keep=["doc_id"])
