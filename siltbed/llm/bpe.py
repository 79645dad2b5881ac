"""Byte-pair encoding as a deterministic automaton over tokens.

The automaton starts with one arc from every byte token to every byte token.
Merge rules are compiled in rank order; the gadget of rule r, (u, v) -> w,

* gives w's state the arcs that v's state had before the rule,
* lets every state that still has an arc labelled u have one labelled w,
* cuts the arc from u's state to v.

After the last gadget the only path that spells a byte string is its BPE
encoding, so the state reached is fixed by the last token. Written out the
automaton of a 50k vocabulary has over 10**9 arcs; compiled here are the
gadgets themselves (whose arcs w copies, and when), and an arc is resolved by
following the copies back to two byte tokens, for arrays of arcs at a time.
Arcs that were resolved once are kept in a bounded table.

Encoding runs over distinct pre-split words: all vocabulary entries that start
at each byte are read off a trie, then the states of all prefixes are filled in
from left to right with the one arc that the automaton has. A word of more than
``_IN_STEP`` bytes is cut into pieces that start early, each as if at the start of a
word. Once a piece's states agree with those of the piece before over the length of the longest
entry, they agree from there on; where they don't, the piece is walked from the states
before it. Decoding emits the byte label of every arc.

Null texts are taken as empty; empty texts have no tokens and decode to ""; an
empty table gives an empty result. Very long texts are encoded whole, as a chunk of
their own, and a word may be as long as its text. Special strings that overlap
are taken from the left, of those at one place the longest.
Repeated rows give repeated results. Columns that are not asked for in ``keep``
are dropped; a kept column named like a result is replaced by it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltbed.llm.arrays import HashTable, chunks, offsets_of, ragged
from siltbed.llm.pretokens import BatchEncoder, class_table, default_path, parse_merges, tokenizer_file
from siltbed.llm.worker import Shared, per_worker

_SCRAMBLE = np.uint64(0x9E3779B97F4A7C15)
#: Words up to this many bytes are encoded in step with each other, longer ones in pieces of so many bytes, so many of them at once.
_IN_STEP, _PIECE, _AT_ONCE = 64, 512, 2048


def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (((np.asarray(a).astype(np.uint64) << np.uint64(32)) | np.asarray(b).astype(np.uint64)) + np.uint64(1)) * _SCRAMBLE


class MergeAutomaton:
    """Compiled merges: states are tokens, an arc carries the next token."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]], arcs_kept: int = 1 << 20):
        n = len(labels)
        self.labels, self.arcs_kept = labels, arcs_kept
        self.row_from, self.column_from = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.born = np.full(n, -1, np.int64)
        cuts: dict[tuple[int, int], int] = {}
        for rank, (u, v, w) in enumerate(merges):
            self._gadget(rank, u, v, w, cuts)
        pairs = np.array(list(cuts), np.int64).reshape(-1, 2)
        self.cuts = HashTable(max(1, len(cuts)))
        self.cuts.put(_key(pairs[:, 0], pairs[:, 1]), np.array(list(cuts.values()), np.int64))
        self.arcs = HashTable()
        made = np.flatnonzero(self.born >= 0)
        reached = np.array([len(w) == 1 for w in labels])
        able = self._resolve(self.column_from[made], self.row_from[made], self.born[made])
        for w, ok in sorted(zip(made.tolist(), able.tolist(), strict=True), key=lambda x: self.born[x[0]]):
            reached[w] = ok and reached[self.column_from[w]] and reached[self.row_from[w]]
        self._trie(reached)
        self.label_lengths = np.array([len(w) for w in labels], np.int64)
        self.label_starts = offsets_of(self.label_lengths)[:-1]
        self.label_bytes = np.frombuffer(b"".join(labels), np.uint8)

    def _gadget(self, rank: int, u: int, v: int, w: int, cuts: dict[tuple[int, int], int]) -> None:
        cuts.setdefault((u, v), rank)
        if self.born[w] < 0 and len(self.labels[w]) > 1:
            self.born[w], self.row_from[w], self.column_from[w] = rank, v, u

    def _trie(self, reached: np.ndarray) -> None:
        nodes: dict[int, int] = {}
        token = [-1]
        for i in np.flatnonzero(reached).tolist():
            at = 0
            for b in self.labels[i]:
                at = nodes.setdefault(at << 8 | b, len(token))
                if at == len(token):
                    token.append(-1)
            token[at] = i
        keys = np.fromiter(nodes, np.uint64, len(nodes))
        self.goto = HashTable(len(nodes))
        self.goto.put((keys + np.uint64(1)) * _SCRAMBLE, np.fromiter(nodes.values(), np.int64, len(nodes)))
        self.accepts = np.array(token, np.int64)

    def _resolve(self, x: np.ndarray, y: np.ndarray, until: np.ndarray) -> np.ndarray:
        """Whether the arc from state x labelled y is there after the first ``until`` gadgets."""
        out = np.ones(len(x), bool)
        live = np.arange(len(x))
        x, y, until = x.copy(), y.copy(), until.copy()
        while len(live):
            cut = self.cuts.get(_key(x, y))
            gone = (cut >= 0) & (cut < until)
            out[live[gone]] = False
            bx, by = self.born[x], self.born[y]
            go = ~gone & ((bx >= 0) | (by >= 0))
            live, x, y, bx, by = live[go], x[go], y[go], bx[go], by[go]
            until = np.where(by > bx, by + 1, bx)
            x, y = np.where(bx >= by, self.row_from[x], x), np.where(by >= bx, self.column_from[y], y)
        return out

    def has_arc(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether token y may follow token x."""
        keys = _key(x, y)
        known = self.arcs.get(keys)
        new = np.flatnonzero(known < 0)
        if len(new):
            if self.arcs.n > self.arcs_kept:
                self.arcs = HashTable()
            fresh, at = np.unique(keys[new], return_index=True)
            at = new[at]
            found = self._resolve(x[at], y[at], np.full(len(at), np.int64(1) << 60)).astype(np.int64)
            known[new] = found[np.searchsorted(fresh, keys[new])]
            absent = self.arcs.get(fresh) < 0
            self.arcs.put(fresh[absent], found[absent])
        return known > 0

    def _candidates(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, token) of every vocabulary entry in the words, ordered by start."""
        at, node, where = np.arange(len(data)), np.zeros(len(data), np.int64), np.arange(len(data))
        starts, tokens = [], []
        while len(at):
            node = self.goto.get((((node.astype(np.uint64) << np.uint64(8)) | data[where].astype(np.uint64)) + np.uint64(1)) * _SCRAMBLE)
            live = node >= 0
            at, node, where = at[live], node[live], where[live] + 1
            hit = self.accepts[node] >= 0
            starts.append(at[hit])
            tokens.append(self.accepts[node[hit]])
            live = where < ends[at]
            at, node, where = at[live], node[live], where[live]
        starts, tokens = np.concatenate(starts), np.concatenate(tokens)
        order = np.argsort(starts, kind="stable")
        return starts[order], tokens[order]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token count of each word, and all tokens one word after the other."""
        lengths = np.array([len(w) for w in words], np.int64)
        if not lengths.sum():
            return np.zeros(len(words), np.int64), np.zeros(0, np.int32)
        data = np.frombuffer(b"".join(words), np.uint8)
        begins = offsets_of(lengths)[:-1]
        ends = np.repeat(begins + lengths, lengths)
        starts, tokens = self._candidates(data, ends)
        first = np.searchsorted(starts, np.arange(len(data) + 1))
        state = np.full(len(data), -1, np.int64)  # of the prefix that ends with each byte
        within = np.arange(len(data)) - np.repeat(begins, lengths)
        short = np.repeat(lengths <= _IN_STEP, lengths)
        order = np.argsort(within[short], kind="stable")
        places = np.flatnonzero(short)[order]
        steps = np.searchsorted(within[places], np.arange(_IN_STEP + 1))
        for k in range(_IN_STEP):
            at = places[steps[k] : steps[k + 1]]
            if not len(at):
                break
            n = first[at + 1] - first[at]
            pick = ragged(first[at], n)
            y = tokens[pick]
            end = starts[pick] + self.label_lengths[y] - 1
            ok = np.ones(len(y), bool) if k == 0 else self.has_arc(state[starts[pick] - 1], y)
            state[end[ok]] = y[ok]
        long = np.flatnonzero(lengths > _IN_STEP)
        if len(long):
            self._encode_long(begins[long], lengths[long], first, starts, tokens, state)
        return self._read_back(state, begins, lengths)

    def _encode_long(self, begins: np.ndarray, lengths: np.ndarray, first: np.ndarray, starts: np.ndarray, tokens: np.ndarray, state: np.ndarray) -> None:
        """States of the prefixes of long words, piece by piece."""
        longest = int(self.label_lengths.max())
        early = 2 * longest
        n = -(-lengths // _PIECE)
        low = np.repeat(begins, n) + _PIECE * (ragged(np.zeros(len(n), np.int64), n))
        high = np.minimum(low + _PIECE, np.repeat(begins + lengths, n))
        begin = np.maximum(low - early, np.repeat(begins, n))
        known: dict[tuple[int, int], bool] = {}
        for i in range(0, len(low), _AT_ONCE):
            part = slice(i, i + _AT_ONCE)
            own = self._in_step(begin[part], high[part], first, starts, tokens)
            for k, (a, b, c) in enumerate(zip(begin[part].tolist(), low[part].tolist(), high[part].tolist(), strict=True)):
                seen = min(longest, b - a)
                if seen < longest or (own[k, b - a - seen : b - a] == state[b - seen : b]).all():  # so early a start is the word's
                    state[b:c] = own[k, b - a : c - a]
                else:
                    self._walk(max(a, b - longest), b, c, first, tokens, state, known)

    def _in_step(self, begin: np.ndarray, high: np.ndarray, first: np.ndarray, starts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """States of the prefixes of the spans, each taken as a word."""
        size = high - begin
        own = np.full((len(begin), int(size.max())), -1, np.int64)
        for k in range(own.shape[1]):
            live = np.flatnonzero(size > k)
            at = begin[live] + k
            n = first[at + 1] - first[at]
            y, row = tokens[ragged(first[at], n)], np.repeat(live, n)
            end = k + self.label_lengths[y] - 1
            ok = end < size[row]
            y, row, end = y[ok], row[ok], end[ok]
            if k:
                ok = self.has_arc(own[row, k - 1], y)
                y, row, end = y[ok], row[ok], end[ok]
            own[row, end] = y
        return own

    def _walk(self, at: int, low: int, high: int, first: np.ndarray, tokens: np.ndarray, state: np.ndarray, known: dict[tuple[int, int], bool]) -> None:
        """States from ``low`` to ``high``, with those before ``low`` given; entries start at ``at`` or later, which is inside the word."""
        size, bounds = self.label_lengths, first[at : high + 1].tolist()
        for k in range(at + 1, high):
            x = int(state[k - 1])
            for y in tokens[bounds[k - at] : bounds[k - at + 1]].tolist():
                end = k + int(size[y]) - 1
                if not low <= end < high or state[end] >= 0:
                    continue
                ok = known.get((x, y))
                if ok is None:
                    if len(known) > 1 << 16:
                        known.clear()
                    ok = known[x, y] = bool(self.has_arc(np.array([x]), np.array([y]))[0])
                if ok:
                    state[end] = y

    def _read_back(self, state: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = begins + lengths - 1
        who = np.flatnonzero(lengths)
        at = at[who]
        marked = np.zeros(len(state), bool)
        while len(at):
            marked[at] = True
            at = at - self.label_lengths[state[at]]
            live = at >= begins[who]
            at, who = at[live], who[live]
        counts = np.add.reduceat(np.append(marked, False), np.append(begins, len(marked)))[:-1] if len(begins) else np.zeros(0, np.int64)
        return np.where(lengths > 0, counts, 0).astype(np.int64), state[marked].astype(np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The labels of the arcs that ``ids`` walk along, as bytes."""
        return self.label_bytes[ragged(self.label_starts[ids], self.label_lengths[ids])].tobytes()


class Decimal:
    """Joins ids as decimal numbers with commas, for whole arrays."""

    def __init__(self, n: int):
        text = [b"%d," % i for i in range(n)]
        self.lengths = np.array([len(x) for x in text], np.int64)
        self.starts = offsets_of(self.lengths)[:-1]
        self.flat = np.frombuffer(b"".join(text), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        return self.flat[ragged(self.starts[ids], self.lengths[ids])].tobytes()[:-1]


def _encoder(model: Shared) -> tuple[MergeAutomaton, BatchEncoder]:
    words, merges, special = parse_merges(model.value)
    automaton = MergeAutomaton(words, merges)
    return automaton, BatchEncoder(class_table(), special, automaton.encode)


def _keep(df: DataFrame, keep: list[str] | None, results: list[T.StructField]) -> tuple[list[str], T.StructType]:
    names = {f.name for f in results}
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    return kept, T.StructType([df.schema[c] for c in kept] + results)


def encode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with ids (array of int) of every whole text."""
    model = Shared(df.sparkSession, tokenizer_file(path))  # the size of the vocabulary
    kept, schema = _keep(df, keep, [T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        _, encoder = per_worker("bpe", model.key, lambda: _encoder(model))
        for batch in batches:
            for i, j, data, at in chunks(batch.column(0)):
                flat, by_text = encoder.ids(data, at)
                ids = pa.ListArray.from_arrays(pa.array(by_text.astype(np.int32)), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[1:]), ids], names=schema.names)

    return df.select(F.col(text).alias("__text"), *kept).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with text, decoded from an array of ids; null ids decode to "", broken UTF-8 to U+FFFD."""
    model = Shared(df.sparkSession, tokenizer_file(path))  # the size of the vocabulary
    kept, schema = _keep(df, [c for c in (df.columns if keep is None else keep) if c != ids], [T.StructField("text", T.StringType())])

    def run(batches):
        automaton = per_worker("labels", model.key, lambda: MergeAutomaton(parse_merges(model.value)[0], []))
        for batch in batches:
            rows = batch.column(0)
            texts = [automaton.decode(np.asarray(r.values, np.int64)).decode("utf-8", "replace") if r.is_valid else "" for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=schema.names)

    return df.select(F.col(ids).alias("__ids"), *kept).mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """``keep`` columns with n_tokens, ids_sha256 and decoded_sha256 (and ids) of every whole text, encoded and then decoded."""
    model = Shared(df.sparkSession, tokenizer_file(path))  # the size of the vocabulary
    results = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    kept, schema = _keep(df, keep, [*results, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def run(batches):
        automaton, encoder = per_worker("bpe", model.key, lambda: _encoder(model))
        decimal = per_worker("decimal", len(automaton.labels), lambda: Decimal(len(automaton.labels)))
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for i, j, data, at in chunks(batch.column(0)):
                flat, by_text = encoder.ids(data, at)
                spans = list(zip(by_text[:-1].tolist(), by_text[1:].tolist(), strict=True))
                joined = [sha(decimal.join(flat[a:b])) for a, b in spans]
                back = [sha(automaton.decode(flat[a:b]).decode("utf-8", "replace").encode()) for a, b in spans]
                ids = [pa.ListArray.from_arrays(pa.array(by_text.astype(np.int32)), pa.array(flat, pa.int32()))] if with_ids else []
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[1:]), pa.array(np.diff(by_text)), pa.array(joined), pa.array(back), *ids], names=schema.names)

    return df.select(F.col(text).alias("__text"), *kept).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, default_path(), keep=["doc_id"])
