"""Document operators against plain versions, and their corner cases."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("siltbed.llm")

from siltbed.llm import components, langid, minhash, mixing, ppm, quality, toxicity  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
LETTERS = [a + b for a in "bcdfglmnprst" for b in "aeiou"]


def prose(rng, n):
    return " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 3))) + rng.choice(["", "", ",", ".\n"]) for _ in range(n))


def corpus():
    rng = random.Random(4)
    out = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    base = prose(rng, 100).split(" ")
    for k in range(25):  # copies with more and more changes
        copy = list(base)
        for _ in range(k // 2):
            copy[rng.randrange(len(copy))] = "changed%d" % rng.randrange(1000)
        out.append(" ".join(copy))
    out += [out[0], out[0], out[1].upper(), "one two", "one  two", "ONE\ttwo", "three", "", " \n ", None, "a b c d " * 400, "\x00 odd   blank s", "é " * 30, "word " * 20_000]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("s", "t", None)[i % 3], "clash", 1) for i, t in enumerate(corpus())]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, kept string, n_words int").repartition(3)


# ---------------------------------------------------------------- quality


def plain_quality(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs):
    got = {r["doc_id"]: r for r in quality.apply_rules(docs).collect()}
    for i, t in enumerate(corpus()):
        want = plain_quality(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, repr(t)[:80]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])


def test_quality_corners(spark):
    none = spark.createDataFrame([], "doc_id long, text string, kept string")
    assert quality.apply_rules(none).count() == 0
    text = " ".join(f"word{i} the" for i in range(40))
    rows = [(1, text, "x"), (1, text, "x"), (None, text, "x"), (None, None, "x")]
    got = quality.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["kept"]) for r in got) == [("1", 80, True), ("1", 80, True), ("None", 0, False), ("None", 80, True)]


def test_quality_filter_is_one_stage_without_python(docs):
    plan = quality.apply_rules(docs).filter("kept").select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert len(plan) < 20_000  # the steps aren't inlined into each other


def test_quality_rules_decide(spark):
    good = "the quick brown fox and the lazy dog met in a wood " * 3
    fine = " ".join(f"{w}{i}" if i % 3 else "the" for i, w in enumerate((good * 2).split()))
    rows = [(1, fine), (2, " ".join(w + "###" for w in fine.split())), (3, fine.replace("the", "xqz")), (4, fine.replace(" ", "")), (5, " ".join(w * 6 for w in fine.split()))]
    got = {r["doc_id"]: r["kept"] for r in quality.apply_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False}


# ---------------------------------------------------------------- near-duplicates


def plain_sets(texts, n):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates(docs, words):
    sets = plain_sets(corpus(), words)
    root = list(range(len(sets)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, words).collect()}
    for i, s in enumerate(sets):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(s), find(i), find(i) == i), (i, repr(corpus()[i])[:60])


def test_drop_copies_keeps_one_of_each(docs):
    kept = minhash.drop_copies(docs.select("doc_id", "text", "source"))
    ids = {r["doc_id"] for r in kept.collect()}
    want = {r["doc_id"] for r in minhash.near_duplicates(docs).filter("kept").collect()}
    assert ids == want and kept.columns == ["doc_id", "text", "source"]


def test_drop_copies_keeps_one_row_of_a_group(spark):
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w30", "other")
    rows = [
        (1, base, "b"), (1, base, "a"), (1, near, "c"), (2, base, "d"), (None, base, "e"),  # one group
        (None, "n " * 9, "f"), (None, "n " * 9, "f"), (3, "some words of their own", "g"), (4, None, "h"), (4, None, "h"), (5, "", "i"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row string").repartition(4)
    got = sorted(map(str, (tuple(r) for r in minhash.drop_copies(docs).collect())))
    kept = sorted(rows[:2] + rows[2:3], key=str)
    firsts = [str(r) for r in kept if str(r) in got]
    assert len(firsts) == 1 and firsts[0] != str(rows[1])  # of id 1: one text, and of its repeated rows the last
    assert [g for g in got if g not in firsts] == sorted(map(str, [rows[5], rows[7], rows[8], rows[9], rows[10]]))
    assert got == sorted(map(str, (tuple(r) for r in minhash.drop_copies(docs.repartition(1)).collect())))
    assert minhash.drop_copies(docs.limit(0)).count() == 0


def test_near_duplicates_corners(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(none).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (None, None), (3, "x")]
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("2", "2", True), ("3", "3", True), ("None", "1", False), ("None", "None", True)]


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.8, 0.95):
        for n in (20, 300, 5000):
            both, own = rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, 1 << 63, (2, n), dtype=np.uint64)
            k = round(n * (1 - share) / (1 + share))
            a, b = np.concatenate([both[k:], own[0][:k]]), np.concatenate([both[k:], own[1][:k]])
            s = minhash.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 2048)
            real = (n - k) / (n + k)
            assert (s != minhash._EMPTY).all() and abs((s[0] == s[1]).mean() - real) < 6 * math.sqrt(real * (1 - real) / 2048) + 1e-9


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 250), (210, 250), (210, 240)]
    got = {r["vertex"]: r["root"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130)) and {got[i] for i in (200, 210, 240, 250)} == {200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- mixing


def plain_targets(size):
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(size.values()))
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level >= 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= 3 * size[s]
            free.discard(s)
    return target | {s: weight[s] * level for s in free}


def test_mix(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    size = {i: len(WORD.findall(t or "")) for i, t in enumerate(corpus())}
    by = Counter()
    for i, n in size.items():
        by[("s", "t", None)[i % 3]] += n
    sized, sources, parts, taken = mixing.mix(docs, block=16, shard_slots=64)
    table = {r["source"]: r for r in sources.collect()}
    want = plain_targets(by)
    times = {r["row_id"]: r for r in parts.join(taken, ["sidx", "block"]).selectExpr("row_id", "words * size(shards) as t", "size(shards) as n").groupBy("row_id").agg({"t": "sum", "n": "max"}).collect()}
    total = Counter()
    for r in sized.collect():
        assert r["size"] == size[r["doc_id"]]
        got = times[r["row_id"]]["sum(t)"] if r["row_id"] in times else 0
        assert got <= 3 * r["size"]
        total[r["source"]] += got
    for s in by:
        assert table[s]["source_size"] == by[s] and table[s]["target"] == pytest.approx(want[s])
        assert abs(total[s] - want[s]) <= 0.01 * want[s] + 48
    slots = mixing.draw(spark, sources, 64).collect()
    for r in sources.collect():  # each slot of a source once, and shards of the right size
        assert sorted(x["number"] for x in slots if x["sidx"] == r["sidx"]) == list(range(r["slots"]))
    per_shard = Counter(x["shard"] for x in slots)
    assert all(n == 64 for s, n in per_shard.items() if s < max(per_shard))


def test_mixed_documents_are_made_of_taken_words(docs):
    source = docs.select("doc_id", "text", "source")
    mixed = mixing.mixed_documents(source, block=16).collect()
    texts = corpus()
    rounds = Counter(r["doc_id"] for r in mixed)
    assert max(rounds.values()) <= 3
    for r in mixed:
        it = iter(WORD.findall(texts[r["doc_id"]]))
        assert all(any(w == x for x in it) for w in WORD.findall(r["text"]))  # in order
    again = mixing.mixed_documents(source.repartition(5), block=16).collect()
    assert sorted(map(str, mixed)) == sorted(map(str, again))


def test_mixed_documents_of_odd_rows(spark):
    rng = random.Random(6)
    rows = [(1, prose(rng, 50), "s", "x", 7), (1, prose(rng, 50), "s", "x", 7), (None, prose(rng, 60), None, "y", 8), (2, None, "s", "z", 9), (3, "", "t", "z", 9), (4, prose(rng, 3000), "t", "z", 1)]
    rows += [rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row_id string, n_words int")
    mixed = mixing.mixed_documents(docs, block=16)
    assert mixed.columns == docs.columns and mixing.mixed_documents(docs.limit(0)).count() == 0
    got = [r for r in mixed.collect()]
    by, size = Counter(), Counter()
    for r in got:
        by[r["source"]] += len(WORD.findall(r["text"]))
        assert any(tuple(r)[2:] == x[2:] and r["doc_id"] == x[0] for x in rows)
    for _, t, s, *_ in rows:
        size[s] += len(WORD.findall(t or ""))
    for s, target in plain_targets(size).items():
        assert abs(by[s] - target) <= 48 and by[s] <= 3 * size[s]


def test_shards_are_packed_blocks(spark, docs):
    rows = docs.select("doc_id", "text", "source")
    _, sources, _, _ = mixing.mix(rows, block=16, shard_slots=64)
    drawn = Counter((r["shard"], r["sidx"]) for r in mixing.draw(spark, sources, 64).collect())
    index = {r["source"]: r["sidx"] for r in sources.collect()}
    got = mixing.shards(rows, block=16, shard_slots=64).collect()
    assert Counter((r["shard"], index[r["source"]]) for r in got) == drawn  # the drawn counts of each shard
    size = {r["source"]: r["source_size"] for r in sources.collect()}
    held = {(r["source"], r["block"]): r["words"] for r in got}
    assert all(len(w) == min(16, size[s] - 16 * b) for (s, b), w in held.items())
    texts = {"s": [], "t": [], None: []}
    for i, t in enumerate(corpus()):
        texts[("s", "t", None)[i % 3]].append(WORD.findall(t or ""))
    for s in texts:  # a source whose blocks are all taken comes back whole
        blocks = sorted(b for x, b in held if x == s)
        if blocks == list(range(len(blocks))) and len(blocks) * 16 >= size[s]:
            assert Counter(w for b in blocks for w in held[s, b]) == Counter(w for t in texts[s] for w in t)
    assert any(len([b for x, b in held if x == s]) * 16 >= size[s] for s in texts)


def test_running_totals_by_bucket(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), k, rng.randint(0, 5)) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    got = {r["k"]: r["before"] for r in mixing.running(df, ["g"], mixing.F.floor(mixing.F.col("k") / 7), ["k"], mixing.F.col("v"), "before").collect()}
    for g, k, _ in rows:
        assert got[k] == sum(v for h, j, v in rows if h == g and j < k)
    bucket = lambda n: spark.range(1).select(mixing.F.lit("0123456789abcdef").alias("h")).select(mixing.by_hash("h", n).alias("x")).first()["x"]
    assert [bucket(n) for n in (0, 10**6, 10**9, 10**11)] == ["012", "012", "0123", "012345"]


@pytest.mark.parametrize("rows", [[], [(1, None, None), (2, "", "s")]])
def test_mix_of_nothing(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized, sources, parts, taken = mixing.mix(docs)
    assert sized.count() == len(rows) and parts.count() == taken.count() == 0
    assert all(r["target"] == 0 for r in sources.collect())


# ---------------------------------------------------------------- language-model score


def plain_ppm(nodes, order, stream):
    """log10 of a byte stream's probability under kept counts, one symbol after the other."""
    counts = [dict(zip(g.tolist(), n.tolist(), strict=True)) for g, n, _, _ in nodes]
    totals = [dict(zip(c.tolist(), n.tolist(), strict=True)) for _, _, c, n in nodes]
    seen = [defaultdict(dict) for _ in nodes]
    for k, level in enumerate(counts):
        for g, n in level.items():
            seen[k][g >> 8][g & 255] = n
    out, history = 0.0, [255] * order
    for symbol in stream:
        barred: set[int] = set()
        for k in range(order, -1, -1):
            context = int.from_bytes(bytes(history[len(history) - k :]), "big") if k else 0
            if context not in totals[k]:
                barred = set()
                continue
            own = seen[k].get(context, {})
            missing = totals[k][context] - sum(own.values())
            kinds = len(own) - len(barred)
            space = totals[k][context] - sum(own.get(s, 0) for s in barred) + kinds
            if symbol in own:
                out += math.log10(own[symbol] / space)
                break
            if missing + kinds > 0:
                out += math.log10((missing + kinds) / space)
            barred = set(own)
        else:
            out -= math.log10(ppm.ALPHABET - len(seen[0].get(0, {})))
        history.append(symbol)
    return out


@pytest.mark.parametrize("nodes", [1 << 20, 300])
def test_ppm(spark, docs, nodes):
    texts = corpus()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    counts, ends = Counter(), 0
    for i, t in enumerate(texts):
        if not held[i]:
            counts.update(WORD.findall((t or "").translate(LOWER)))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    got = {r["doc_id"]: r for r in ppm.score(docs, order=3, nodes=nodes, heavy=50).collect()}
    trie = ppm.train(docs.filter(~ppm.held_out("doc_id")), order=3, nodes=nodes)
    for i, t in enumerate(texts):
        words = WORD.findall((t or "").translate(LOWER))
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words) + math.log10((ends + 1) / (n + v + 1))
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(words) + 1, sum(counts[w] > 0 for w in words) + 1, n)
        assert r["base_score"] == pytest.approx(base)
        if len(t or "") < 2000:
            assert r["score"] == pytest.approx(plain_ppm(trie, 3, [*(t or "").translate(LOWER).encode(), ppm.END]))


def plain_counts(texts, order):
    """What ``plain_ppm`` reads, counted from the texts alone."""
    out = []
    for k in range(order + 1):
        seen, totals = Counter(), Counter()
        for t in texts:
            stream = [255] * order + [*(t or "").translate(LOWER).encode(), ppm.END]
            for i in range(order, len(stream)):
                context = int.from_bytes(bytes(stream[i - k : i]), "big")
                seen[context << 8 | stream[i]] += 1
                totals[context] += 1
        out.append(tuple(np.array(x) for c in (seen, totals) for x in (list(c), list(c.values()))))
    return out


@pytest.mark.parametrize("nodes", [1 << 20, 300, 0])
def test_ppm_keeps_every_gram(spark, docs, nodes):
    texts = corpus()
    counts = plain_counts([t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2], 3)
    got = {r["doc_id"]: r["score"] for r in ppm.score(docs, order=3, nodes=nodes, heavy=50).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain_ppm(counts, 3, [*(t or "").translate(LOWER).encode(), ppm.END]))


def test_ppm_is_a_distribution():
    flat = np.frombuffer(b"abracadabra abracadabra", np.uint8)
    g, _ = ppm.grams(flat, np.array([0, len(flat)]), 2)
    nodes = []
    for k in range(3):
        short = g & np.uint64((1 << (8 * (k + 1))) - 1)
        nodes.append((*np.unique(short, return_counts=True), *np.unique(short >> np.uint64(8), return_counts=True)))
    trie = ppm.Trie(nodes)
    for context in (b"ab", b"ra", b"zz", b"\xff\xff", b"za"):
        every = np.array([int.from_bytes(context, "big") << 8 | s for s in range(ppm.ALPHABET)], np.uint64)
        assert (10 ** trie.log10(every)).sum() == pytest.approx(1.0)


def test_ppm_without_training(spark):
    rows = [(i, t) for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2 for t in ("some text", None)]
    got = ppm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r["held_out"] and r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 for r in got)
    assert ppm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---------------------------------------------------------------- classifiers


def test_language(spark):
    rng = random.Random(2)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["ßu", "öt", "ern"], "cc": ["qué", "ción", "ar"]}
    make = lambda la, n: " ".join("".join(rng.choice(syllables[la]) for _ in range(3)) for _ in range(n))
    rows = [(i, make(la, rng.choice([2, 30])), la, "x") for i, la in enumerate(rng.choice(["aa", "bb", "cc"]) for _ in range(300))]
    rows += [(900, None, "aa", "x"), (901, "12 :: 3", "aa", "x"), (902, "", None, "x"), (903, make("bb", 20_000), None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.train(docs.filter(~langid.held_out("doc_id")))).collect()}
    checked = [i for i, _, la, _ in rows if i < 300 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i]["lang_pred"] == rows[i][2] for i in checked]) >= 0.97
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"] for i in (900, 901, 902)) and got[903]["lang_pred"] == "bb"
    none = langid.train(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}


def plain_language(model, text):
    """Label and probability by the mean of the weights of all n-grams, one after the other."""
    raw = bytearray()
    for c in (text or "").encode():
        if len(raw) and raw[-1] == 0xC3 and 0x80 <= c <= 0x9E and c != 0x97:
            c += 0x20
        raw.append(c)
    low = bytes(raw).lower()
    folded = [0x20]
    for c in low:
        c = c if c >= 128 or 97 <= c <= 122 else 0x20
        if c != 0x20 or folded[-1] != 0x20:
            folded.append(c)
    if folded[-1] != 0x20:
        folded.append(0x20)
    total, n = [0.0] * len(model.languages), 0
    for at, size in enumerate((2, 3, 4)):
        for i in range(len(folded) - size + 1):
            value = int.from_bytes(bytes(folded[i : i + size]), "big")
            h = (value * 0x9E3779B1 & 0xFFFFFFFF) ^ (value >> 15)
            row = (h * (0x85EBCA77 + 2 * (size - 1)) & 0xFFFFFFFF) >> 16
            n += 1
            for c in range(len(total)):
                total[c] += float(model.weights[c][row + (at << 16)])
    z = [(t / max(1, n) + float(b)) / model.temperature for t, b in zip(total, model.bias, strict=True)]
    e = [math.exp(x - max(z)) for x in z]
    return model.languages[e.index(max(e))], max(e) / sum(e)


def spoken(rng):
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["ßu", "Öt", "ern"], "cc": ["qué", "Ción", "ar"]}
    make = lambda la, n: " ".join("".join(rng.choice(syllables[la]) for _ in range(3)) for _ in range(n))
    return [(i, make(la, rng.choice([2, 30])) + rng.choice(["", " 12!", "\n#"]), la) for i, la in enumerate(rng.choice(["aa", "bb", "cc"]) for _ in range(300))]


def test_language_against_a_plain_version(spark):
    rows = spoken(random.Random(5))
    rows += [(400, None, "aa"), (401, "", "bb"), (402, "12 -- 7", None), (None, "kalomi " * 5, "aa"), (None, "kalomi " * 5, "aa"), (403, "lokami " * 30_000, "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", langid.F.lit(3))
    model = langid.train(docs)
    got = Counter((r["doc_id"], r["text"], r["lang_pred"], round(r["score"], 9)) for r in langid.identify(docs, model).collect())
    want = Counter()
    for i, t, _ in rows:
        label, p = plain_language(model, t) if any(c.isalpha() for c in t or "") else ("und", 0.0)
        want[i, t, label, round(p, 9)] += 1
    assert got == want
    again = langid.train(docs.repartition(7))  # null ids and repeated rows included
    assert (again.weights == model.weights).all() and again.threshold == model.threshold
    assert langid.identify(docs.limit(0), model).count() == 0


def test_language_learns_from_whole_texts(spark):
    """What tells the languages apart stands at the end of long texts."""
    rng = random.Random(7)
    same = " ".join(rng.choice(LETTERS) * 2 for _ in range(300))
    rows = [(i, same + (" zzuzzu" if i % 2 else " yyiyyi") * rng.randint(150, 200), "ab"[i % 2]) for i in range(200)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert all(plain_language(model, t)[0] == la for _, t, la in rows[:20])


def plain_toxicity(model, text):
    """Score by filters moved over the words one by one."""
    net = model.network
    low = text.lower() if text.isascii() else text
    words = re.findall(r"[a-z0-9]+", low)
    vectors = []
    for w in words:
        rows = toxicity.word_rows(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0]
        vectors.append(np.sum([net.embedding[r].astype(np.float64) for r in rows], axis=0))
    best = []
    for i, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            top = 0.0
            for at in range(len(vectors)):
                value = float(net.bias[i * toxicity.FILTERS + f])
                for k in range(width):
                    if at + k < len(vectors):
                        value += float(vectors[at + k] @ net.kernels[i][k, :, f].astype(np.float64))
                top = max(top, value)
            best.append(top)
    z = sum(b * float(o) for b, o in zip(best, net.out, strict=True)) + net.out_bias
    raw = text.encode()
    language = model.language.predict(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0][0]
    return 1 / (1 + math.exp(-(z - model.cuts[language] + math.log(toxicity.CUT / (1 - toxicity.CUT)))))


def marked(rng, n, long=0):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = prose(rng, rng.randint(5, 60) + (long if bad else 0)).split(" ")
        if bad:
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = "grumsk" + rng.choice(LETTERS)
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_against_a_plain_version(spark):
    rows, labels = marked(random.Random(13), 300)
    rows += [(None, rows[0][1], "en"), (None, rows[0][1], "en"), (900, None, "en"), (901, "", None), (902, "Grumskba GRUMSKDE 12", "en"), (2, rows[2][1], "en")]
    labels += [(2, 1), (2, 0), (None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", toxicity.F.lit("x"))
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.trained(docs, marks)
    got = toxicity.classify(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["score"] == pytest.approx(plain_toxicity(model, r["text"] or ""), abs=1e-5) and r["predicted"] == int(r["score"] >= 0.7)
    again = toxicity.trained(docs.repartition(5), marks.repartition(3))
    assert (again.network.embedding == model.network.embedding).all() and (again.cuts == model.cuts).all()
    assert toxicity.classify(docs.limit(0), model).count() == 0


def test_toxicity_gradient():
    """Against differences of the loss."""
    rng = np.random.default_rng(4)
    rows = rng.integers(0, 40, (12, 3))
    net = toxicity.Network(
        rng.normal(0, 0.5, (40, toxicity.DIM)), [rng.normal(0, 0.5, (w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS],
        rng.normal(0, 0.1, toxicity.FILTERS * len(toxicity.WIDTHS)), rng.normal(0, 0.5, toxicity.FILTERS * len(toxicity.WIDTHS)), 0.1,
    )
    at_word, by_text, y = rng.integers(0, 12, 30), np.array([0, 0, 9, 10, 30, 30]), np.array([0, 1, 0, 1, 1])

    def loss():
        best, _ = net.activations(net.vectors(rows)[at_word], by_text)
        z = best @ net.out + net.out_bias
        return np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y))

    def slope(array, at, step=1e-6):
        held = array[at]
        array[at] = held + step
        high = loss()
        array[at] = held - step
        low = loss()
        array[at] = held
        return (high - low) / (2 * step)

    found = toxicity.gradient(net, rows, at_word, by_text, y)
    for i, kernel in enumerate(net.kernels):
        for at in np.ndindex(kernel.shape):
            assert found.kernels[i][at] == pytest.approx(slope(kernel, at), abs=1e-7)
    for array, grad in ((net.bias, found.bias), (net.out, found.out)):
        for at in np.ndindex(array.shape):
            assert grad[at] == pytest.approx(slope(array, at), abs=1e-7)
    by_row = np.zeros_like(net.embedding)
    np.add.at(by_row, found.rows, found.by_row)
    for at in np.ndindex(by_row.shape):
        assert by_row[at] == pytest.approx(slope(net.embedding, at), abs=1e-7)


def test_toxicity_of_long_texts(spark):
    """All toxic training texts are long: they are learnt from, and found."""
    rows, labels = marked(random.Random(17), 240, long=2000)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = toxicity.trained(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.network is not None
    got = {r["doc_id"]: r["predicted"] for r in toxicity.classify(docs, model).collect()}
    bad = [i for i, y in labels if y and zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i] for i in bad]) > 0.9


def test_toxicity(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        words = prose(rng, rng.randint(5, 60)).split(" ")
        bad = i % 4 == 0
        if bad:
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = "grumsk" + rng.choice(LETTERS)
        rows.append((i, " ".join(words), "en", 7))
        labels.append((i, int(bad)))
    rows += [(2000, None, "en", 7), (2001, "", "en", 7), (2002, prose(rng, 30_000), "en", 7), (2003, prose(rng, 30_000) + " grumskba grumskde", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, predicted int")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(docs, toxicity.trained(docs, marks)).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i]["predicted"] == labels[i][1] for i in held]) >= 0.97
    assert all(got[i]["predicted"] == 0 for i in (2000, 2001)) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    nothing = toxicity.trained(docs.limit(0), marks)
    assert {r["score"] for r in toxicity.classify(docs, nothing).collect()} == {0.0}
