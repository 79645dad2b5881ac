"""The reader against a writer of every feature of the format, written here for the tests."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

pytest.importorskip("siltbed.llm")

from siltbed.llm import webp  # noqa: E402


class Bits:
    def __init__(self):
        self.out: list[int] = []

    def put(self, value: int, n: int):
        self.out += [(value >> k) & 1 for k in range(n)]

    def code(self, lengths: dict[int, int], alphabet: int) -> dict[int, tuple[int, int]]:
        """Writes a normal prefix code with repeats and returns (bits, length) by symbol."""
        if len(lengths) == 1:
            (symbol,) = lengths
            if symbol < 256:
                self.put(1, 1), self.put(0, 1), self.put(1, 1), self.put(symbol, 8)
                return {symbol: (0, 0)}
        self.put(0, 1)
        self.put(15, 4)
        sixteen = {v: 4 for v in (*range(14), 17, 18)}  # sixteen codes of four bits
        for v in webp.CODE_LENGTH_ORDER:
            self.put(sixteen.get(v, 0), 3)
        self.put(0, 1)
        own = self.canonical(sixteen)
        k = 0
        while k < alphabet:
            if k not in lengths:
                run = 1
                while k + run < alphabet and k + run not in lengths and run < 138:
                    run += 1
                if run >= 11:
                    self.sym(own[18]), self.put(run - 11, 7)
                    k += run
                    continue
                if run >= 3:
                    self.sym(own[17]), self.put(run - 3, 3)
                    k += run
                    continue
            self.sym(own[lengths.get(k, 0)])
            k += 1
        return self.canonical(lengths)

    @staticmethod
    def canonical(lengths):
        code, last, out = 0, 0, {}
        for s in sorted(lengths, key=lambda s: (lengths[s], s)):
            code <<= lengths[s] - last
            last = lengths[s]
            out[s] = (int(format(code, f"0{last}b")[::-1], 2), last)
            code += 1
        return out

    def sym(self, pair):
        self.put(*pair)

    def prefixed(self, table, value: int, base: int = 0):
        """A length or distance: its prefix symbol and extra bits."""
        value -= 1
        if value < 4:
            self.sym(table[base + value])
            return
        high = value.bit_length() - 1
        second = (value >> (high - 1)) & 1
        self.sym(table[base + 2 * high + second])
        self.put(value & ((1 << (high - 1)) - 1), high - 1)


def skewed(symbols):
    """Code lengths 1, 2, 3, ... capped, then equal: a complete code of uneven lengths."""
    symbols = sorted(set(symbols))
    if len(symbols) == 1:
        symbols.append(symbols[0] + 1 if symbols[0] < 200 else 0)
        symbols.sort()
    out, n = {}, len(symbols)
    for i, s in enumerate(symbols[:3] if n > 8 else symbols[:-1]):
        out[s] = i + 1
    rest = [s for s in symbols if s not in out]
    depth = len(out)
    width = max(0, (len(rest) - 1).bit_length())
    spare = (1 << width) - len(rest)
    for k, s in enumerate(rest):
        out[s] = depth + width - (1 if k < spare else 0)
    return out


def write_image(b: Bits, argb, width: int, outermost: bool, cache_bits: int = 0, refs: bool = False, entropy_tiles: bool = False):
    argb = [int(x) for x in argb]
    ops, k, cache = [], 0, [0] * (1 << cache_bits)
    slot = lambda c: (0x1E35A7BD * c & 0xFFFFFFFF) >> (32 - cache_bits)
    while k < len(argb):
        run = 0
        if refs:
            for back, code in ((width, 1), (1, 2), (7, None)):
                if k >= back and run < 3:
                    n = 0
                    while k + n < len(argb) and argb[k + n] == argb[k + n - back] and n < 4000:
                        n += 1
                    if n >= 3:
                        run, how = n, code if code else back + 120
        if run >= 3:
            ops.append((k, "ref", run, how))
            step = run
        elif cache_bits and cache[slot(argb[k])] == argb[k] and (k or argb[k]):
            ops.append((k, "hit", slot(argb[k]), None))
            step = 1
        else:
            ops.append((k, "lit", argb[k], None))
            step = 1
        for q in range(k, k + step):
            if cache_bits:
                cache[slot(argb[q])] = argb[q]
        k += step
    if cache_bits:
        b.put(1, 1), b.put(cache_bits, 4)
    else:
        b.put(0, 1)
    group_of = lambda k: 0
    if outermost:
        b.put(int(entropy_tiles), 1)
        if entropy_tiles:
            b.put(0, 3)  # tiles of 4 x 4
            across, down = -(-width // 4), -(-(len(argb) // width) // 4)
            which = [(x + y) % 2 for y in range(down) for x in range(across)]
            write_image(b, [0xFF000000 | w << 8 for w in which], across, False)
            group_of = lambda k: which[(k // width // 4) * across + (k % width) // 4]
    tables = []
    for g in range(2 if entropy_tiles else 1):
        own = [o for o in ops if group_of(o[0]) == g]
        green = [o[2] >> 8 & 255 for o in own if o[1] == "lit"] + [280 + o[2] for o in own if o[1] == "hit"]
        lens, dists = Bits(), Bits()
        every = {256 + i: (0, 0) for i in range(24)}
        for o in own:
            if o[1] == "ref":
                for table, value, base, acc in ((every, o[2], 256, "g"), ({i: (0, 0) for i in range(40)}, o[3], 0, "d")):
                    v = value - 1
                    s = v if v < 4 else 2 * (v.bit_length() - 1) + (v >> (v.bit_length() - 2) & 1)
                    (green if acc == "g" else dists.out).append(base + s)
        lits = [o[2] for o in own if o[1] == "lit"] or [0]
        kinds = [(green or [0], 280 + (1 << cache_bits if cache_bits else 0)), ([c >> 16 & 255 for c in lits], 256), ([c & 255 for c in lits], 256), ([c >> 24 for c in lits], 256), (dists.out or [0], 40)]
        tables.append([b.code(skewed(s) if len(set(s)) > 1 or max(s) > 255 else {s[0]: 1}, n) for s, n in kinds])
    for k, kind, value, how in ops:
        t = tables[group_of(k)]
        if kind == "lit":
            for table, shift in ((t[0], 8), (t[1], 16), (t[2], 0), (t[3], 24)):
                b.sym(table[value >> shift & 255])
        elif kind == "hit":
            b.sym(t[0][280 + value])
        else:
            b.prefixed(t[0], value, 256)
            b.prefixed(t[4], how)


def container(b: Bits) -> bytes:
    raw = np.packbits(np.array(b.out, np.uint8), bitorder="little").tobytes()
    chunk = b"VP8L" + len(raw).to_bytes(4, "little") + raw + b"\0" * (len(raw) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def head(width, height) -> Bits:
    b = Bits()
    b.put(0x2F, 8), b.put(width - 1, 14), b.put(height - 1, 14), b.put(1, 1), b.put(0, 3)
    return b


def picture(width=13, height=11, colours=40, seed=0):
    rng = np.random.default_rng(seed)
    table = rng.integers(0, 1 << 32, colours, dtype=np.uint32)
    out = table[rng.integers(0, colours, (height, width))]
    out[4] = out[3]
    out[6, 2:9] = out[6, 1]
    return out


@pytest.mark.parametrize("cache", [0, 1, 5])
@pytest.mark.parametrize("refs", [False, True])
@pytest.mark.parametrize("tiles", [False, True])
def test_prefix_codes_references_cache_and_groups(cache, refs, tiles):
    want = picture()
    b = head(13, 11)
    b.put(0, 1)
    write_image(b, want.reshape(-1), 13, True, cache, refs, tiles)
    assert (webp.decode(container(b)) == want).all()


def bytes_of(argb):
    return [argb >> 24 & 255, argb >> 16 & 255, argb >> 8 & 255, argb & 255]


def argb_of(parts):
    a, r, g, b = (int(x) & 255 for x in parts)
    return a << 24 | r << 16 | g << 8 | b


def predicted(mode, px, x, y, width):
    """The format's predictors, sample by sample."""
    if x == 0 and y == 0:
        return [255, 0, 0, 0]
    if y == 0:
        return bytes_of(px[y][x - 1])
    if x == 0:
        return bytes_of(px[y - 1][x])
    left, top, corner = bytes_of(px[y][x - 1]), bytes_of(px[y - 1][x]), bytes_of(px[y - 1][x - 1])
    right = bytes_of(px[y - 1][x + 1] if x + 1 < width else px[y][0])
    mean = lambda p, q: [(i + j) // 2 for i, j in zip(p, q, strict=True)]
    clamp = lambda v: max(0, min(255, v))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(v - c) for v, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    half = [clamp(m + int((m - c) / 2)) for m, c in zip(mean(left, top), corner, strict=True)]
    return [
        [255, 0, 0, 0], left, top, right, corner, mean(mean(left, right), top), mean(left, corner), mean(left, top), mean(corner, top), mean(top, right),
        mean(mean(left, corner), mean(top, right)), None, [clamp(v + t - c) for v, t, c in zip(left, top, corner, strict=True)], half,
    ][mode]


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    want = picture(9, 7, 30, mode)
    px = want.tolist()
    rest = [[argb_of([p - q for p, q in zip(bytes_of(px[y][x]), predicted(mode, px, x, y, 9), strict=True)]) for x in range(9)] for y in range(7)]
    b = head(9, 7)
    b.put(1, 1), b.put(webp.PREDICTOR, 2), b.put(0, 3)
    write_image(b, [0xFF000000 | mode << 8] * (3 * 2), 3, False)
    b.put(0, 1)
    write_image(b, [v for row in rest for v in row], 9, True)
    assert (webp.decode(container(b)) == want).all()


def test_cross_colour_and_green():
    want = picture(10, 8, 30, 3)
    signed = lambda v: v - 256 if v > 127 else v
    delta = lambda f, c: (signed(f) * signed(c)) >> 5
    to_red, to_blue, red_to_blue = 200, 37, 250
    coded = []
    for v in want.reshape(-1).tolist():
        a, r, g, bl = bytes_of(v)
        coded.append(argb_of([a, r - delta(to_red, g), g, bl - delta(to_blue, g) - delta(red_to_blue, r)]))
    coded = [argb_of([a, r - g, g, bl - g]) for a, r, g, bl in map(bytes_of, coded)]
    b = head(10, 8)
    b.put(1, 1), b.put(webp.CROSS_COLOUR, 2), b.put(0, 3)
    write_image(b, [0xFF000000 | red_to_blue << 16 | to_blue << 8 | to_red] * (3 * 2), 3, False)
    b.put(1, 1), b.put(webp.SUBTRACT_GREEN, 2)
    b.put(0, 1)
    write_image(b, coded, 10, True)
    assert (webp.decode(container(b)) == want).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 30, 200])
def test_palette_through_the_writer(colours):
    want = picture(48, 20, colours, colours)
    assert (webp.decode(webp.encode(want)) == want).all()


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 7000, 200_001])
def test_payloads(n):
    raw = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    for text in (raw, b"ab" * (n // 2), b"\xff" * n):
        media = webp.store(text)
        back, _ = webp.load(media, len(text))
        assert back == webp.padded(text) and len(back) % 576 == 0 and back


@pytest.mark.parametrize("n", [3_931_777, 3_932_352, 5_000_000, 34_300_000])
def test_very_long_texts(n):
    """Sizes at which a row is left over, one that has references beyond the format's reach, and several pictures."""
    rng = np.random.default_rng(n)
    words = [rng.integers(97, 123, 7, dtype=np.uint8).tobytes() + b" " for _ in range(50)]
    text = b"".join(words[k] for k in rng.integers(0, 50, 4000))
    far = rng.integers(0, 256, 20_000, dtype=np.uint8).tobytes()
    text = (far + text * (n // len(text) + 1))[: n - len(far)] + far
    media = webp.store(text)
    back, argb = webp.load(media, n)
    assert len(text) == n and back == webp.padded(text)
    assert argb.shape[1] % 12 == 0 and len(list(webp.pictures(media))) == -(-len(back) // 4 // webp.MOST_PIXELS)


def test_what_the_writer_uses():
    """A written file is read through codes of several lengths, back-references and the cache, and through a transform where one is estimated to save bits."""

    def kinds(media):
        seen = set()
        symbols = webp._symbols

        def spy(bits, group, width, total):
            found = symbols(bits, group, width, total)
            seen.update(["cache"] if (found[0] >= 280).any() else [])
            seen.update(["references"] if found[3].any() else [])
            seen.update(["lengths"] if len(set((group[0].places & 15).tolist())) > 1 else [])
            return found

        webp._symbols = spy
        try:
            argb = webp.decode(media)
        finally:
            webp._symbols = symbols
        bits = webp._Bits(media[21:])
        for n in (14, 14, 1, 3):
            bits.read(n)
        if bits.read(1):
            seen.add(bits.read(2))
        return seen, argb

    rng = np.random.default_rng(2)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9), dtype=np.uint8)) for _ in range(300)]
    prose = b" ".join(words[k] for k in (rng.integers(0, 300, 3000) ** 2 // 300).tolist())
    assert kinds(webp.store(prose + prose[:2000]))[0] >= {"cache", "lengths", "references"}
    assert webp.PALETTE in kinds(webp.store(b"abcd" * 10 + b"efgh" * 300 + b"abcdabcdefgh" * 2000))[0]  # of any size
    grey = rng.integers(0, 256, (60, 48), dtype=np.uint32)
    grey = np.uint32(0xFF000000) | (grey + 5 & 255) << np.uint32(16) | grey << np.uint32(8) | (grey - 9 & 255)
    seen, back = kinds(webp.encode(np.concatenate([grey, rng.permutation(grey.reshape(-1)).reshape(60, 48) ^ np.uint32(1)])))
    assert webp.SUBTRACT_GREEN in seen and (back[:60] == grey).all()


def test_both_readers_agree(monkeypatch):
    """Pictures read by following places, in spans of any size, and read symbol by symbol are the same; so are truncated ones refused."""
    rng = np.random.default_rng(8)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9), dtype=np.uint8)) for _ in range(300)]
    texts = [b" ".join(words[k] for k in rng.integers(0, 300, n).tolist()) for n in (90, 700, 4000)]
    texts += [b"a" * 9000, b"abcd" * 5000 + texts[0], texts[1] * 9, rng.integers(0, 256, 20_000, dtype=np.uint8).tobytes(), b"\0" * 3000 + texts[0] + b"\0" * 300 + texts[0]]
    for text in texts:
        media = webp.store(text)
        for span in (64, 1000, 1 << 17):
            monkeypatch.setattr(webp, "_SPAN", span)
            monkeypatch.setattr(webp, "_MANY", 1)
            fast = webp.load(media, len(text))
            monkeypatch.setattr(webp, "_MANY", 1 << 40)
            slow = webp.load(media, len(text))
            assert fast[0] == slow[0] == webp.padded(text) and (fast[1] == slow[1]).all()
        size = len(media) // 2 & ~1
        broken = media[:4] + (size - 8).to_bytes(4, "little") + media[8:16] + (size - 20).to_bytes(4, "little") + media[20:size]
        for many in (1, 1 << 40):
            monkeypatch.setattr(webp, "_MANY", many)
            if len(media) > 200:
                with pytest.raises(webp.WebPError):
                    webp.decode(broken)


def test_small_pictures_are_written_together(monkeypatch):
    """Small texts share the array operations of the writer, and the file of a text is the same in any company."""
    rng = np.random.default_rng(11)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9), dtype=np.uint8)) for _ in range(200)]
    prose = [b" ".join(words[k] for k in (rng.integers(0, 200, n) ** 2 // 200).tolist()) for n in rng.integers(1, 300, 60).tolist()]
    odd = [b"", b"a", b"x" * 575, bytes(range(256)) * 9, b"\0" * 1152, rng.integers(0, 256, 3000, dtype=np.uint8).tobytes(), b"abcd" * 900, prose[0] * 300]
    texts = [*prose[:30], *odd, *prose[30:], *odd[::-1]]
    alone = [webp.store(t) for t in texts]
    calls, write = [], webp._write_pixels
    monkeypatch.setattr(webp, "_write_pixels", lambda fields, images, outermost: (calls.append(len(images)), write(fields, images, outermost)))
    media = webp.store_all(texts)
    assert media == alone and sum(calls) >= len(texts) and len(calls) < 24
    assert all(webp.load(m, len(t))[0] == webp.padded(t) for m, t in zip(media, texts, strict=True))
    assert webp.store_all([]) == []
    order = rng.permutation(len(texts))
    assert webp.store_all([texts[k] for k in order]) == [alone[k] for k in order]


def test_symbols_that_read_an_empty_place_of_the_cache():
    kind, one = np.array([300, 65]), np.ones(2, np.int64)
    assert webp._resolved(kind, np.array([0, 65 << 8]), one, one * 0, 8) is None


@pytest.mark.parametrize("limit", [7, 12])
def test_code_lengths_are_complete_and_short(limit):
    rng = np.random.default_rng(limit)
    for n in (2, 3, 17, 100):
        for counts in (rng.integers(0, 50, n), 2 ** np.minimum(np.arange(n), 40), np.ones(n, np.int64)):
            counts = np.append(counts, [1, 1])
            lengths = webp.code_lengths(counts, limit)
            used = lengths[counts > 0]
            assert (lengths[counts == 0] == 0).all() and used.max() <= limit and (2.0**-used).sum() == 1
            p = counts[counts > 0] / counts.sum()
            if used.max() < limit:
                assert (p * used).sum() < -(p * np.log2(p)).sum() + 1


def test_broken_files():
    good = webp.store(b"some text" * 100)
    for bad in (b"", good[:30], b"X" + good[1:], good[:20] + b"\0" + good[21:], good[:24] + b"\xe0" + good[25:]):
        with pytest.raises(webp.WebPError):
            webp.decode(bad)


def test_query_columns(spark):
    rows = [(1, "héllo", "x"), (2, None, "x"), (3, "", "x"), (4, "héllo", "x"), (None, "z" * 100_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, feature string")
    got = {r["doc_id"]: r for r in webp.describe(docs).collect()}
    for k, t in ((1, "héllo"), (2, ""), (None, "z" * 100_000)):
        payload = webp.padded(t.encode())
        assert (got[k]["n_bytes"], got[k]["payload_bytes"], got[k]["payload_sha256"], got[k]["tail_crc32"]) == (len(t.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got[1][2:] == got[4][2:] and got[2][2:] == got[3][2:]
    assert webp.describe(docs.limit(0)).count() == 0
    stored = webp.media_column(docs.select("doc_id", "text"))
    back = {r["doc_id"]: r for r in webp.pixels(stored.drop("text")).collect()}
    assert back[1]["width"] == 12 and len(back[1]["argb"]) == 576
