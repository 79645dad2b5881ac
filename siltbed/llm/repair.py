"""Token ids as grammar-compressed binary blocks.

Texts are encoded by the tokenizers library (each distinct pre-split piece once
to a cache), an end id closes each document, and documents are laid out in
ascending order of id: a range partition of the ids, sorted within. Runs of whole
documents of about ``BLOCK_TOKENS`` ids form a block. A block's ids are numbered
densely; then the frequent pairs of neighbouring symbols are replaced by new
symbols (Re-Pair, a batch of the most frequent pairs at a time) until none is
left that saves more bits than its rule takes, or several rounds have made the block no smaller. Of
the grammars on the way, the one with the fewest bits is kept: a rule that makes
every symbol a bit wider can cost more than it saves.
A rule holds its two symbols and how many ids it expands to, so a reader finds any
token of any document without expanding what comes before it.

A block is one binary value of a Parquet table, so Spark's commit protocol
covers lost executors, and any store that Spark reaches can hold it::

    "SBRP" | version u8 | bits of a gap, of a symbol and of an expansion, u8 each
    documents u32 | ids in use u32 | rules u32 | symbols u32
    per document: id i64, tokens u32, symbols u32 -- as three arrays
    gaps between the ids in use, ascending
    per rule: left, right, expansion -- as three arrays
    symbols

Numbers are little-endian; the arrays below the documents are packed to the bits of the
header, each filled up to a byte. A symbol below the number of ids in use is an id, others are rules.

Null texts are empty (the end id alone), and so are empty ones. An empty table has no
blocks. A very long text is a block alone, as a whole. A null
id sorts first and is read back as null; ids that are no integers are refused.
Rows with equal ids are ordered by a hash of the text; repeated rows stay repeated.
Pairs that are equally frequent go in the order of their symbols.
Extra columns are ignored.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltbed.llm.arrays import chunks, offsets_of, ragged
from siltbed.llm.pretokens import BatchEncoder, class_table, default_path, parse_merges, tokenizer_file
from siltbed.llm.scratch import materialize
from siltbed.llm.worker import Shared, per_worker

MAGIC, VERSION = b"SBRP", 2
END_ID = 0
#: Ids to a block (a longer document is one alone), pairs replaced at a time, and rounds that may go by without a smaller block.
BLOCK_TOKENS, PAIRS, PATIENCE = 1 << 18, 2048, 4
_NULL_ID = -(1 << 63)


class CorruptBlock(ValueError):
    """Bytes that are not a block."""


# ---------------------------------------------------------------- grammar


_SLOT_BITS, _OFTEN = 16, 4096
_NONE = -1


def _frequent_pairs(keys: np.ndarray, ends: np.ndarray, pairs: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of about ``pairs`` of the most frequent pairs, the places (none of ``ends``) of such pairs, and the rank of the pair at each."""
    slot = _slots_of(keys)
    in_slot = np.bincount(slot, minlength=1 << _SLOT_BITS) - np.bincount(slot[ends], minlength=1 << _SLOT_BITS)
    reached = np.cumsum(np.bincount(np.minimum(in_slot, _OFTEN), minlength=_OFTEN + 1)[::-1])[::-1]  # slots with so many or more
    enough = max(least, int(np.searchsorted(-reached, -pairs, side="right")) - 1)
    often = (in_slot >= enough).take(slot)
    often[ends] = False
    at = often.nonzero()[0]  # all places of pairs that occur ``enough`` times
    own = keys.take(at)
    values, n = np.unique(own, return_counts=True)
    best = np.argsort(-n, kind="stable")[:pairs]
    found = values[best[n[best] >= least]]
    if not len(found):
        return found, at[:0], at[:0]
    by_slot = np.full(1 << _SLOT_BITS, _NONE, np.int32)
    by_slot[_slots_of(found)[::-1]] = np.arange(len(found), dtype=np.int32)[::-1]
    rank = by_slot.take(slot.take(at))  # of pairs in one slot the most frequent; the others come in a later round
    hit = (rank >= 0) & (found.take(rank, mode="wrap") == own)
    return found, at[hit], rank[hit]


def _slots_of(keys: np.ndarray) -> np.ndarray:
    if keys.dtype == np.uint32:
        return ((keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - _SLOT_BITS)).astype(np.int64)
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def width(n: int) -> int:
    """Bits of the numbers below ``n``."""
    return max(1, int(n - 1).bit_length())


def compress(ids: np.ndarray, lengths: np.ndarray, first_rule: int, pairs: int = PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, symbols by document, rules as pairs, expansion lengths) for ids below ``first_rule``; no rule spans documents."""
    symbols = ids.astype(np.int32)
    ends = np.cumsum(lengths)[lengths > 0] - 1  # the last symbols of documents
    rules, expansion = np.zeros((0, 2), np.int64), np.ones(first_rule, np.int64)
    best, kept, since = None, None, 0
    while since < PATIENCE:
        wide, long = width(first_rule + len(rules)), width(int(expansion.max(initial=1)) + 1)
        bits = len(symbols) * wide + len(rules) * (2 * wide + long)
        if best is None or bits < best:
            best, kept, since = bits, (symbols, ends, len(rules)), -1
        since += 1
        least = 2 + (long + 1) // wide + 1  # occurrences that save more bits than a rule of this round takes
        half, keys = (np.uint32(16), symbols.view(np.uint32)) if wide <= 16 else (np.uint64(32), symbols.astype(np.uint64))
        keys = (keys[:-1] << half) | keys[1:]
        found, at, rank = _frequent_pairs(keys, ends[:-1], pairs, least)
        number = np.arange(len(at))
        run = np.maximum.accumulate(np.where(np.append(True, at[1:] - at[:-1] > 1)[: len(at)], number, 0))
        take = ((number - run) & 1) == 0  # neighbours that overlap: every other one, from the left
        at, rank = at[take], rank[take]
        often = np.bincount(rank, minlength=len(found)) >= least  # pairs that overlapped others may be rare now
        if not often.all():
            take = often.take(rank)
            at, rank = at[take], rank[take]
        if not len(at):
            break
        number = first_rule + len(rules) + np.cumsum(often) - 1  # of the rules made
        used = found[often]
        new = np.stack([used >> half, used & ((half.dtype.type(1) << half) - half.dtype.type(1))], axis=1).astype(np.int64)
        rules, expansion = np.concatenate([rules, new]), np.concatenate([expansion, expansion[new].sum(axis=1)])
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols = symbols[keep]
        symbols[at - np.arange(len(at))] = number.take(rank)
        ends = ends - np.searchsorted(at + 1, ends, side="right")
    symbols, ends, n = kept
    by_document = np.zeros(len(lengths), np.int64)
    by_document[lengths > 0] = np.diff(ends, prepend=-1)
    return symbols.astype(np.int64), by_document, rules[:n], expansion[first_rule : first_rule + n]


def expand(symbols: np.ndarray, rules: np.ndarray, first_rule: int) -> np.ndarray:
    """The ids that ``symbols`` stand for."""
    while True:
        at = np.flatnonzero(symbols >= first_rule)
        if not len(at):
            return symbols
        size = np.ones(len(symbols), np.int64)
        size[at] = 2
        begin = offsets_of(size)[:-1]
        out = np.empty(int(size.sum()), np.int64)
        out[begin] = symbols
        pair = rules[symbols[at] - first_rule]
        out[begin[at]], out[begin[at] + 1] = pair[:, 0], pair[:, 1]
        symbols = out


# ---------------------------------------------------------------- blocks


_PACKED = 1 << 18


def pack(values: np.ndarray, bits: int) -> bytes:
    """``values`` in ``bits`` bits each, least significant first."""
    parts = []
    for i in range(0, len(values), _PACKED):  # whole bytes, but for the last part
        raw = values[i : i + _PACKED].astype("<u4").view(np.uint8).reshape(-1, 4)
        parts.append(np.packbits(np.unpackbits(raw, axis=1, count=bits, bitorder="little").reshape(-1), bitorder="little").tobytes())
    return b"".join(parts)


def unpack(raw: bytes, n: int, bits: int) -> np.ndarray:
    """``n`` numbers of ``bits`` bits."""
    eights = (n + 7) // 8  # numbers that fill whole bytes together
    rows = np.frombuffer(raw.ljust(eights * bits, b"\0"), np.uint8, eights * bits).reshape(eights, bits)
    out = np.zeros((eights, 8), np.int64)
    for k in range(8):
        first, shift = divmod(k * bits, 8)
        last = (k * bits + bits - 1) // 8
        value = rows[:, first].astype(np.int64) >> shift
        for j in range(first + 1, last + 1):
            value |= rows[:, j].astype(np.int64) << (8 * (j - first) - shift)
        out[:, k] = value & ((1 << bits) - 1)
    return out.reshape(-1)[:n]


def write_block(doc_ids: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> bytes:
    used = np.flatnonzero(np.bincount(ids))
    number = np.zeros(int(used[-1]) + 1, np.int64)
    number[used] = np.arange(len(used))
    symbols, by_document, rules, expansion = compress(number[ids], lengths, len(used))
    gaps = np.diff(used, prepend=0)
    gap, wide, long = width(int(gaps.max(initial=1)) + 1), width(len(used) + len(rules)), width(int(expansion.max(initial=1)) + 1)
    head = MAGIC + struct.pack("<BBBBIIII", VERSION, gap, wide, long, len(lengths), len(used), len(rules), len(symbols))
    parts = [doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), by_document.astype("<u4").tobytes()]
    return head + b"".join(parts) + pack(gaps, gap) + pack(rules[:, 0], wide) + pack(rules[:, 1], wide) + pack(expansion, long) + pack(symbols, wide)


class Block:
    """A block that was read: its tables, and tokens on demand."""

    def __init__(self, raw: bytes):
        if len(raw) < 24 or raw[:4] != MAGIC or raw[4] != VERSION or not all(1 <= x <= 32 for x in raw[5:8]):
            raise CorruptBlock("header")
        _, gap, wide, long, documents, n_used, n_rules, n_symbols = struct.unpack_from("<BBBBIIII", raw, 4)
        tables = [(n_used, gap), (n_rules, wide), (n_rules, wide), (n_rules, long), (n_symbols, wide)]
        at = 24 + documents * 16
        if len(raw) != at + sum((n * bits + 7) // 8 for n, bits in tables):
            raise CorruptBlock("length")
        self.doc_ids = np.frombuffer(raw, "<i8", documents, 24)
        self.lengths, self.by_document = (np.frombuffer(raw, "<u4", documents, 24 + documents * k).astype(np.int64) for k in (8, 12))
        found = []
        for n, bits in tables:
            end = at + (n * bits + 7) // 8
            found.append(unpack(raw[at:end], n, bits))
            at = end
        gaps, left, right, self.expansion, self.symbols = found
        self.used, self.rules, self.first_rule = np.cumsum(gaps), np.stack([left, right], axis=1), n_used

    def ids(self) -> np.ndarray:
        """The ids of all documents, one after the other."""
        size = np.concatenate([np.ones(self.first_rule, np.int64), self.expansion])
        if int(size.sum()) > _PACKED + 8 * int(self.lengths.sum()):  # much more than there is to read
            return self.used[expand(self.symbols, self.rules, self.first_rule)]
        each = self.used[expand(np.arange(len(size)), self.rules, self.first_rule)]  # of every symbol
        if len(each) != int(size.sum()):
            raise CorruptBlock("expansion")
        return each.take(ragged((offsets_of(size)[:-1]).take(self.symbols), size.take(self.symbols)))

    def tokens(self, document: int, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of one document; only the symbols that hold them are expanded."""
        first = int(self.by_document[:document].sum())
        own = self.symbols[first : first + int(self.by_document[document])]
        size = np.ones(len(own), np.int64)
        size[own >= self.first_rule] = self.expansion[own[own >= self.first_rule] - self.first_rule]
        ends = np.cumsum(size)
        low, high = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left")) + 1
        skipped = int(ends[low - 1]) if low else 0
        return self.used[expand(own[low:high], self.rules, self.first_rule)[start - skipped : stop - skipped]]


# ---------------------------------------------------------------- tables


#: What stands between pieces for the library, a code point that is no character, and how many pieces are one text.
_BETWEEN, _JOINED = "\ufdd0", 128


def _library_encoder(raw: bytes) -> BatchEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer, pre_tokenizers

    def library():
        tokenizer = Tokenizer.from_str(raw.decode())
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    joined, plain = library(), functools.cache(library)
    # pieces are split already: of those joined by a token that isn't in the file, each is a word of its own
    joined.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    joined.add_special_tokens([AddedToken(_BETWEEN, normalized=False, special=True)])
    between = joined.token_to_id(_BETWEEN)

    def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [_BETWEEN.encode().join(pieces[k : k + _JOINED]).decode() for k in range(0, len(pieces), _JOINED)]
        found = [x.ids for x in joined.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.array([i for ids in found for i in (*ids, between)], np.int32)
        at = (flat == between).nonzero()[0]
        if len(at) == len(pieces):
            return np.diff(at, prepend=-1) - 1, flat[flat != between]
        found = [x.ids for x in plain().encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]  # a text holds that token's string
        lengths = np.array([len(x) for x in found], np.int64)
        return lengths, np.fromiter((i for x in found for i in x), np.int32, int(lengths.sum()))

    out = BatchEncoder(class_table(), parse_merges(raw)[2], encode)
    out.cache.limit = 1_000_000
    return out


def _blocks(encoder: BatchEncoder, batches, block_tokens: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        keys = batch.column(1).fill_null(_NULL_ID).to_numpy()
        for i, j, data, at in chunks(batch.column(0)):
            flat, by_text = encoder.ids(data, at)
            n = np.diff(by_text) + 1
            ends = np.cumsum(n)
            closed = np.full(int(n.sum()), END_ID, np.int64)
            closed[ragged(ends - n, n - 1)] = flat
            low = 0
            while low < len(n):
                done = int(ends[low - 1]) if low else 0
                high = max(low + 1, int(np.searchsorted(ends, done + block_tokens - size, side="right")))
                if held and ends[low] - done + size > block_tokens:
                    yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                    held, size = [], 0
                    continue
                stop = int(ends[high - 1])
                held.append((keys[i:j][low:high], closed[done:stop], n[low:high]))
                size, low = size + stop - done, high
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def write_ids(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(part, block, documents, tokens, payload): blocks in ascending order of document id."""
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} is no integer column")
    model = Shared(docs.sparkSession, tokenizer_file(path))  # the size of the vocabulary

    def run(batches):
        encoder = per_worker("library", model.key, lambda: _library_encoder(model.value))
        part = TaskContext.get().partitionId()
        for k, (keys, ids, lengths) in enumerate(_blocks(encoder, batches, block_tokens)):
            payload = write_block(keys, ids, lengths)
            yield pa.RecordBatch.from_pylist([{"part": part, "block": k, "documents": len(lengths), "tokens": len(ids), "payload": payload}], schema=schema)

    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("documents", pa.int64()), ("tokens", pa.int64()), ("payload", pa.binary())])
    rows = docs.select(F.col(text).alias("__text"), F.col(key).cast("long").alias("__key"), F.xxhash64(text).alias("__hash"))
    ordered = rows.repartitionByRange("__key", "__hash").sortWithinPartitions("__key", "__hash")
    return ordered.select("__text", "__key").mapInArrow(run, "part long, block long, documents long, tokens long, payload binary")


def read_ids(blocks: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, part, block, offset in the block, n_tokens, ids_crc32) of each document of stored blocks, and its ids as little-endian bytes."""

    def run(batches):
        for batch in batches:
            for part, number, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                block = Block(raw.as_buffer().to_pybytes())
                flat = memoryview(block.ids().astype("<u4").tobytes())
                ends = np.cumsum(block.lengths)
                spans = [flat[4 * a : 4 * b] for a, b in zip((ends - block.lengths).tolist(), ends.tolist(), strict=True)]
                n = len(spans)
                keys = pa.array(block.doc_ids, mask=block.doc_ids == _NULL_ID)
                columns = [keys, pa.array([part] * n, pa.int64()), pa.array([number] * n, pa.int64()), pa.array(ends - block.lengths), pa.array(block.lengths), pa.array([zlib.crc32(x) for x in spans], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array([bytes(x) for x in spans], pa.binary())] if with_ids else [])], names=names)

    schema = "doc_id long, part long, block long, offset long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]
    return blocks.select("part", "block", "payload").mapInArrow(run, schema)


def starts(blocks: DataFrame) -> DataFrame:
    """(part, block, block_start): ids before each block, summed by part first."""
    each = blocks.select("part", "block", "tokens")
    parts = each.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row for each task that wrote
    within = F.coalesce(F.sum("tokens").over(W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("part_start"))
    return each.withColumn("within", within).join(parts, "part").select("part", "block", (F.col("part_start") + F.col("within")).alias("block_start"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    blocks = materialize(write_ids(docs, default_path()), "token-ids")
    return read_ids(blocks, with_ids=False).join(starts(blocks), ["part", "block"]).select("doc_id", (F.col("block_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
