"""Byte-level pre-splitting for whole batches of texts, and a cache of what each distinct piece encodes to.

The split is the one of the byte-level tokenizers::

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

computed from runs of character classes over arrays of code points instead of
by a regular expression. Special strings of the tokenizer file split the text
first and stand for one token each, as the library does by default.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
import zlib
from collections.abc import Callable

import numpy as np

from siltbed.llm.arrays import HashTable, offsets_of, ragged, span_hashes

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_CLASS = {"L": LETTER, "N": NUMBER}


@functools.lru_cache(maxsize=1)
def class_table() -> bytes:
    """zlib-compressed class of every code point, as the installed tokenizers library sees it.

    The category data of Python and of ``regex`` are of different Unicode
    versions; where the two agree the class is taken from them, and the few
    thousand other code points are put to the library.
    """
    import regex
    from tokenizers import pre_tokenizers

    table, newer = np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.uint8)
    for low in range(0, 0x110000, 0x800):  # 0xD800 to 0xDFFF are one such range
        if low == 0xD800:
            continue
        whole = "".join(map(chr, range(low, low + 0x800)))
        table[low : low + 0x800] = [_CLASS.get(unicodedata.category(c)[0], OTHER) for c in whole]
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, whole):
                newer[low + m.start() : low + m.end()] = kind
    table[newer == SPACE] = SPACE
    ask = np.flatnonzero((table != newer) | (table == SPACE))
    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    found = np.full(len(ask), SPACE, np.uint8)
    for kind, side in ((LETTER, "a"), (NUMBER, "1"), (OTHER, ".")):
        for i in range(0, len(ask), 5000):
            spans = dict(o for _, o in split.pre_tokenize_str("\n".join(f"{side}{chr(c)}{side}" for c in ask[i : i + 5000])))
            found[[i + k for k in range(len(ask[i : i + 5000])) if spans.get(4 * k) == 4 * k + 3]] = kind
    table[ask] = found
    return zlib.compress(table.tobytes())


class Splitter:
    """Splits batches of UTF-8 texts into pre-tokens."""

    def __init__(self, classes: bytes, specials: dict[str, int]):
        self.table = np.frombuffer(zlib.decompress(classes), np.uint8)
        self.specials = sorted(((k.encode(), v) for k, v in specials.items()), key=lambda x: -len(x[0]))

    def _special_spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and tokens of the special strings: the leftmost one, of those the longest, and on from its end."""
        raw = data.tobytes() if self.specials else b""
        found: list[tuple[int, int, int]] = []
        for word, token in self.specials:
            at = raw.find(word)
            while at >= 0:
                found.append((at, len(word), token))
                at = raw.find(word, at + 1)
        start, size, token = np.array(found, np.int64).reshape(-1, 3).T
        inside = np.searchsorted(offsets, start, side="right") == np.searchsorted(offsets, start + size - 1, side="right")
        start, size, token = start[inside], size[inside], token[inside]
        order = np.lexsort((-size, start))
        taken, end = [], 0
        for k, a, b in zip(order.tolist(), start[order].tolist(), (start + size)[order].tolist(), strict=True):
            if a >= end:
                taken.append(k)
                end = b
        return start[taken], (start + size)[taken], token[taken]

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of pre-tokens, their offsets by text, and token ids of special strings (else -1)."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
        cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        n = len(cps)
        first = np.flatnonzero((data & 0xC0) != 0x80)  # byte offset of each character
        a, b, t = self._special_spans(data, offsets)
        cuts = np.concatenate([offsets[:-1], a, b])
        seg = np.zeros(n + 1, bool)
        seg[np.searchsorted(first, cuts)] = True
        seg[n] = True
        kind = self.table[cps]
        run = seg.copy()
        run[1:n] |= kind[1:] != kind[:-1]
        blank = cps == 0x20
        begins = np.flatnonzero(run[:n])
        ends = np.append(begins[1:], n)
        space = kind[begins] == SPACE
        start = np.zeros(n + 1, bool)
        solid = begins[~space]
        joined = np.zeros(len(solid), bool)
        later = solid > 0
        joined[later] = blank[solid[later] - 1] & ~seg[solid[later]]
        start[solid - joined] = True
        start[begins[space]] = True
        followed = ends[space]
        followed = followed[~seg[followed]]
        start[followed - 1] = True
        self._contractions(cps, kind, run, seg, start, n)
        start[n] = False
        at = first[np.flatnonzero(start[:n])]
        ids = None
        if len(a):
            i = np.searchsorted(a, at, side="right") - 1
            inside = (i >= 0) & (at > a[i]) & (at < b[i])
            at, i = at[~inside], i[~inside]
            ids = np.where((i >= 0) & (at == a[i]), t[i], -1)
        stop = np.append(at[1:], len(data))
        return at, stop, np.searchsorted(at, offsets), np.full(len(at), -1, np.int64) if ids is None else ids

    @staticmethod
    def _contractions(cps, kind, run, seg, start, n) -> None:
        p = np.flatnonzero((cps == 0x27) & start[:n])
        p = p[p + 1 < n]
        p = p[run[p] & run[p + 1] & ~seg[p + 1] & (kind[p + 1] == LETTER)]
        if not len(p):
            return
        one = cps[p + 1]
        same = (p + 2 < n) & ~run[np.minimum(p + 2, n)]
        two = np.where(same, cps[np.minimum(p + 2, n - 1)], 0)
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for a, b in ("re", "ve", "ll"):
            size[(one == ord(a)) & (two == ord(b))] = 2
        p, size = p[size > 0], size[size > 0]
        start[p + 1] = False
        start[p + 1 + size] = True


class PieceCache:
    """Token ids of distinct pre-tokens; ``encode`` is called once for each batch of new ones.

    Pieces are told apart by a 64-bit hash of their bytes and length. The cache
    is emptied when it holds ``limit`` pieces, which bounds its memory and
    changes no result.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.table, self.n, self.used = HashTable(), 0, 0
        self.starts, self.lengths, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32)

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        if n <= len(a):
            return a
        out = np.zeros(max(n, 2 * len(a)), a.dtype)
        out[: len(a)] = a
        return out

    def _add(self, keys: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> None:
        self.starts, self.lengths, self.flat = self._room(self.starts, self.n + len(keys)), self._room(self.lengths, self.n + len(keys)), self._room(self.flat, self.used + len(flat))
        self.starts[self.n : self.n + len(keys)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.n : self.n + len(keys)] = lengths
        self.flat[self.used : self.used + len(flat)] = flat
        self.table.put(keys, np.arange(self.n, self.n + len(keys)))
        self.n, self.used = self.n + len(keys), self.used + len(flat)

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Cache position of each span."""
        if self.n > self.limit:
            self._clear()
        keys = span_hashes(data, starts, ends)
        at = self.table.get(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh, where = np.unique(keys[new], return_index=True)
            where = new[where]
            raw = data.tobytes()
            lengths, flat = self.encode([raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
            self._add(fresh, lengths, flat)
            at[new] = self.table.get(keys[new])
        return at


class BatchEncoder:
    """Token ids of batches of whole texts."""

    def __init__(self, classes: bytes, specials: dict[str, int], encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.splitter, self.cache = Splitter(classes, specials), PieceCache(encode)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        starts, ends, by_text, special = self.splitter.split(data, offsets)
        at = self.cache.look_up(data, starts, ends)
        n = np.where(special >= 0, 1, self.cache.lengths[at])
        return np.diff(offsets_of(n)[by_text])

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All token ids one after the other, and their offsets by text."""
        starts, ends, by_text, special = self.splitter.split(data, offsets)
        at = self.cache.look_up(data, starts, ends)
        n = np.where(special >= 0, 1, self.cache.lengths[at])
        flat = self.cache.flat[ragged(self.cache.starts[at], n)]
        ends_of = offsets_of(n)
        if (special >= 0).any():
            hit = np.flatnonzero(special >= 0)
            flat[ends_of[hit]] = special[hit]
        return flat, ends_of[by_text]


@functools.lru_cache(maxsize=1)
def parse_merges(raw: bytes) -> tuple[list[bytes], list[tuple[int, int, int]], dict[str, int]]:
    """Bytes of every id, merges as (left, right, result) in rank order, and special strings of a byte-level tokenizer file."""
    spec = json.loads(raw)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    vocab = spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    words = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for word, i in vocab.items():
        words[i] = bytes(letters[c] for c in word)
    for word, i in special.items():
        words[i] = word.encode()
    merges = []
    for m in spec["model"]["merges"]:
        a, b = m if isinstance(m, list) else m.split(" ")
        merges.append((vocab[a], vocab[b], vocab[a + b]))
    return words, merges, special


def tokenizer_file(path: str) -> bytes:
    """The file as the driver sees it; workers get its bytes (a few MB) and build all tables from them, so the driver holds none."""
    with open(path, "rb") as f:
        return f.read()


def load_merges(path: str) -> tuple[list[bytes], list[tuple[int, int, int]], dict[str, int]]:
    return parse_merges(tokenizer_file(path))


def default_path() -> str:
    """The byte-level vocabulary that the queries use; operators take any such file."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path("byte_bpe_50k.json"))
