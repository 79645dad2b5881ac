"""Encoding, counting and storing token ids against the library itself."""

from __future__ import annotations

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

pytest.importorskip("siltbed.llm")
tokenizers = pytest.importorskip("tokenizers")

from siltbed.llm import bpe, pretokens, repair, token_counts  # noqa: E402

PARTS = ["'s", "'re", "'ll", "'", "  ", "\n", "\n\n", " ", "a", "B", "é", "ß", "漢", "字", "1", "٣", "½", "<|endoftext|>", "<|endof", "...", "!!", "\u0085", "\x1c", "\x00", "😀", "é", "don't", "I've we'll", "\t", "aaaaaaa", "hello world", " the", "　"]


def texts() -> list[str]:
    rng = random.Random(3)
    out = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    out += ["".join(chr(rng.choice([rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF), rng.randint(32, 126)])) for _ in range(50)) for _ in range(100)]
    return [*out, "", "a" * 3000, "x" * 200 + " " * 500, "".join(rng.choice("abcdefgh") for _ in range(5000)), "same", "same"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(pretokens.default_path())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate([*texts(), None])]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids string").repartition(3)


def test_round_trip(docs, library):
    got = {r["doc_id"]: r for r in bpe.round_trip(docs, pretokens.default_path()).collect()}
    for i, t in enumerate([*texts(), ""]):
        ids = library.encode(t, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()), repr(t)


def test_encode_then_decode(docs):
    coded = bpe.encode(docs.select("doc_id", "text"), pretokens.default_path(), keep=["doc_id"])
    back = {r["doc_id"]: r["text"] for r in bpe.decode(coded, pretokens.default_path()).collect()}
    assert [back[i] for i in range(len(back))] == [*texts(), ""]


def test_counts(docs, library):
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs, pretokens.default_path(), limit=512).collect()}
    for i, t in enumerate([*texts(), ""]):
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len(t.encode()), n, n > 512)


def long_texts():
    rng = random.Random(9)
    syllables = ["the", "quick", "information", "ing", "er", "schön", "straße"]
    return {
        "one piece": "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)), "words": "".join(rng.choice(syllables) for _ in range(200_000)),
        "special": "<|endoftext|>" * 150_000, "special and parts": "".join(rng.choice(["<|endoftext|>", "<|endof", "|>", "text", " "]) for _ in range(50_000)),
        "one letter": "a" * 100_001, "dashes": "-" * 30_011, "period of three": "abc" * 20_003, "no blanks": "".join(chr(rng.randint(0x4E00, 0x5000)) for _ in range(40_000)),
        "blanks": " " * 50_001 + "x", "text": " ".join(rng.choice(syllables) for _ in range(100_000)),
    }


@pytest.mark.parametrize("name", long_texts())
def test_long_pieces_and_special_strings(library, name):
    text = long_texts()[name]
    raw = text.encode()
    data, at = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    words, merges, special = pretokens.load_merges(pretokens.default_path())
    want = library.encode(text, add_special_tokens=False).ids
    began = time.perf_counter()
    automaton = bpe.MergeAutomaton(words, merges)
    ids, _ = pretokens.BatchEncoder(pretokens.class_table(), special, automaton.encode).ids(data, at)
    assert ids.tolist() == want and automaton.decode(ids) == raw
    merger = token_counts.RankMerger(merges, token_counts.byte_ids(words))
    counts = pretokens.BatchEncoder(pretokens.class_table(), special, lambda pieces: (merger.merge(pieces)[0], np.zeros(0, np.int32))).counts(data, at)
    assert counts.tolist() == [len(want)]
    assert time.perf_counter() - began < 60  # seconds where quadratic work takes hours


def test_special_strings_leftmost_and_longest():
    splitter = pretokens.Splitter(pretokens.class_table(), {"<a>": 1, "<a><b>": 2, "b><": 3, "aa": 4})
    texts = ["<a><b><a>x<a", "><b>", "aaaaa", ""]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *map(len, texts)])
    start, end, token = splitter._special_spans(data, at)
    want = []
    for t, begin in zip(texts, at.tolist(), strict=False):  # character by character
        k = 0
        while k < len(t):
            hit = max((w for w in ("<a>", "<a><b>", "b><", "aa") if t.startswith(w, k)), key=len, default="")
            want += [(begin + k, begin + k + len(hit))] if hit else []
            k += len(hit) or 1
    assert list(zip(start.tolist(), end.tolist(), strict=True)) == want and token.tolist() == [2, 1, 4, 4]


def test_pieces_whose_states_never_agree():
    """Merges of period three: no early start that isn't a multiple of it reaches the same states."""
    words = [b"a", b"b", b"aa", b"aaa", b"ab"]
    automaton = bpe.MergeAutomaton(words, [(0, 0, 2), (2, 0, 3), (0, 1, 4)])
    for n in (65, 511, 512, 513, 1100, 5000):
        counts, ids = automaton.encode([b"a" * n, b"ab" * n, b"aab" * (n // 3) + b"a"])
        whole = token_counts.RankMerger([(0, 0, 2), (2, 0, 3), (0, 1, 4)], np.array([1 if b == 98 else 0 for b in range(256)])).merge([b"a" * n, b"ab" * n, b"aab" * (n // 3) + b"a"])
        assert counts.tolist() == whole[0].tolist()
        assert b"".join(words[i] for i in ids) == b"a" * n + b"ab" * n + b"aab" * (n // 3) + b"a"


def test_merges_that_overlap_or_never_apply():
    words = [b"a", b"b", b"aa", b"aaa", b"ab"]
    merges = [(0, 0, 2), (2, 0, 3), (0, 1, 4)]
    singles = np.zeros(256, np.int64)
    singles[98] = 1
    for word in (b"a", b"aa", b"aaa", b"aaaa", b"aaaaa", b"aaab", b"ab", b"aab", b"abab", b""):
        symbols = [0 if c == 97 else 1 for c in word]
        while True:  # one merge after the other
            ranks = [(r, k) for k in range(len(symbols) - 1) for r, (x, y, _) in enumerate(merges) if (x, y) == (symbols[k], symbols[k + 1])]
            if not ranks:
                break
            r, k = min(ranks)
            symbols[k : k + 2] = [merges[r][2]]
        n, flat = token_counts.RankMerger(merges, singles).merge([word])
        assert (n.tolist(), flat.tolist()) == ([len(symbols)], symbols)
        n, flat = bpe.MergeAutomaton(words, merges).encode([word])
        assert (n.tolist(), flat.tolist()) == ([len(symbols)], symbols)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    path = pretokens.default_path()
    assert bpe.round_trip(none, path).count() == token_counts.count_tokens(none, path).count() == repair.read_ids(repair.write_ids(none, path)).count() == 0


def test_stored_ids(docs, library):
    blocks = repair.write_ids(docs, pretokens.default_path(), block_tokens=2000).cache()
    starts = {(r["part"], r["block"]): r["block_start"] for r in repair.starts(blocks).collect()}
    got = {r["doc_id"]: r for r in repair.read_ids(blocks).collect()}
    place = 0
    for i, t in enumerate([*texts(), ""]):
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        r = got[i]
        assert (starts[r["part"], r["block"]] + r["offset"], r["n_tokens"], r["ids_crc32"]) == (place, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        place += len(ids)


def test_stored_ids_of_odd_rows(spark, library):
    long = " ".join("word%d" % (k % 700) for k in range(3000))
    rows = [(5, "b"), (None, "null id"), (5, "a"), (5, "b"), (7, None), (8, ""), (9, long), (None, None), (-3, "first")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, part string, tokens int").repartition(2)
    blocks = repair.write_ids(docs, pretokens.default_path(), block_tokens=100).cache()
    got = repair.read_ids(blocks).select("doc_id", "part", "block", "offset", "n_tokens", "ids_crc32").join(repair.starts(blocks), ["part", "block"]).selectExpr("block_start + offset as at", "doc_id", "n_tokens", "ids_crc32").collect()
    crc = lambda t: zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
    got = sorted(got)
    assert sorted((r["doc_id"] is not None, r["doc_id"], r["ids_crc32"]) for r in got if r["doc_id"] is not None) == sorted((True, i, crc(t)) for i, t in rows if i is not None)
    assert [r["doc_id"] for r in got] == [None, None, -3, 5, 5, 5, 7, 8, 9]  # nulls first, then ascending
    assert [r["at"] for r in got] == [sum(x["n_tokens"] for x in got[:k]) for k in range(len(got))]
    assert got[-1]["n_tokens"] > 100  # longer than a block
    with pytest.raises(TypeError):
        repair.write_ids(docs.withColumn("doc_id", docs.part), pretokens.default_path())


def test_grammar_goes_on_while_pairs_save_bits():
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 5000, 600)
    ids = np.concatenate([np.concatenate([passage, rng.integers(0, 5000, 40)]) for _ in range(60)])
    lengths = np.full(60, 640)
    raw = repair.write_block(np.arange(60), ids, lengths)
    block = repair.Block(raw)
    assert (block.ids() == ids).all()
    assert block.expansion.max() > 100  # rules of rules: a batch of pairs a few times over doesn't reach this
    assert len(raw) < 0.25 * 2 * len(ids)
    run = np.zeros(1 << 16, np.int64)
    block = repair.Block(repair.write_block(np.arange(1), run, np.array([len(run)])))
    assert (block.ids() == run).all() and len(block.symbols) <= 64
    for bits in (1, 5, 8, 13, 17, 32):
        values = rng.integers(0, 1 << bits, repair._PACKED + 77)
        assert (repair.unpack(repair.pack(values, bits), len(values), bits) == values).all()


def test_pieces_go_through_the_library_together(monkeypatch):
    """Few texts for many pieces, and the ids that the library gives each text; also where a text holds what stands between pieces, or special strings."""
    import tokenizers

    seen = []

    class Spy:
        def __init__(self, inner):
            object.__setattr__(self, "inner", inner)

        @classmethod
        def from_str(cls, text):
            return cls(tokenizer_class.from_str(text))

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def __setattr__(self, name, value):
            setattr(self.inner, name, value)

        def encode_batch_fast(self, texts, **more):
            seen.append(len(texts))
            return self.inner.encode_batch_fast(texts, **more)

    tokenizer_class = tokenizers.Tokenizer
    raw = pretokens.tokenizer_file(pretokens.default_path())
    library = tokenizer_class.from_str(raw.decode())
    library.no_truncation()
    library.no_padding()
    monkeypatch.setattr(tokenizers, "Tokenizer", Spy)
    encoder = repair._library_encoder(raw)
    plain = ["", " ".join(f"w{k}x{k * k}" for k in range(3000)), "a  b\n\n c's we'll\t", "<|endoftext|>x<|endoftext|> <|endof", "héé 12٣ 日本 🙂\u00a0\u3000z", " " * 50, "qz" * 3000]
    between = [f"p{repair._BETWEEN}{repair._BETWEEN}q r", repair._BETWEEN, f"<|endof{repair._BETWEEN}text|> {repair._BETWEEN} s", "after"]
    for texts in (plain, between, plain + between):
        data = "".join(texts).encode()
        flat, at = encoder.ids(np.frombuffer(data, np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)]))
        for k, t in enumerate(texts):
            assert flat[at[k] : at[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids
        if texts is plain:
            assert encoder.cache.n > 3000 and sum(seen) < 200


def test_a_block_is_read_from_its_expanded_rules(monkeypatch):
    """Rules are expanded once, not at each of their places; a block whose expansions contradict its rules is refused."""
    rng = np.random.default_rng(9)
    words = [rng.integers(0, 300, 12) for _ in range(20)]
    ids = np.concatenate([words[k] for k in rng.integers(0, 20, 9000)])
    raw = repair.write_block(np.arange(9), ids, np.full(9, len(ids) // 9))
    block, expanded, expand = repair.Block(raw), [], repair.expand
    monkeypatch.setattr(repair, "expand", lambda symbols, *more: (expanded.append(len(symbols)), expand(symbols, *more))[1])
    assert (block.ids() == ids).all()
    assert sum(expanded) <= block.first_rule + len(block.rules) < len(block.symbols)
    block.expansion = block.expansion + 1
    with pytest.raises(repair.CorruptBlock):
        block.ids()
    for n in (0, 1, 7, 8, 9):
        for bits in (1, 3, 9, 17, 31, 32):
            values = rng.integers(0, 1 << bits, n)
            assert (repair.unpack(repair.pack(values, bits), n, bits) == values).all()


def test_grammar_and_random_access():
    rng = np.random.default_rng(5)
    words = [rng.integers(0, 50, rng.integers(2, 9)) for _ in range(40)]
    lengths, flat = [], []
    for n in [0, 1, 3, 500, 2000, 1]:
        ids = np.concatenate([words[k] for k in rng.integers(0, 40, n)] or [np.zeros(0, np.int64)])
        flat.append(np.append(ids, 0))
        lengths.append(len(ids) + 1)
    flat.append(np.zeros(300, np.int64))  # one symbol over and over
    lengths.append(300)
    ids, lengths = np.concatenate(flat), np.array(lengths)
    raw = repair.write_block(np.arange(len(lengths)), ids, lengths)
    block = repair.Block(raw)
    assert len(block.rules) and len(raw) < 4 * len(ids) and (block.ids() == ids).all() and (block.lengths == lengths).all()
    first = np.cumsum(lengths) - lengths
    for _ in range(300):
        k = int(rng.integers(len(lengths)))
        a = int(rng.integers(lengths[k] + 1))
        b = int(rng.integers(a, lengths[k] + 1))
        assert (block.tokens(k, a, b) == ids[first[k] + a : first[k] + b]).all()
    for bad in (raw[:20], b"X" + raw[1:], raw + b"\0"):
        with pytest.raises(repair.CorruptBlock):
            repair.Block(bad)
