"""Binary run files: blocks, sparse index, Bloom filter and footer, one after the other without gaps.

The store keeps runs as Parquet; this is the format for exchange. All integers
are little-endian. The index is a count (u32) and, for each block, key length (u32), offset (u64),
length (u32) and its first key. The footer holds offset and length (u64 each) of index and filter, the
magic, a version and flags (a byte each).
"""

from __future__ import annotations

import bisect
import itertools
import struct
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.functions import codecs
from siltbed.functions.bloom import BloomFilter
from siltbed.functions.codecs import Record
from siltbed.model import CorruptRunError, DeletedError, InvalidFilterError, NotFoundError, UnsortedRecordsError
from siltbed.operators.layout import BLOCK_COUNT, FOOTER, FOOTER_MAGIC, FOOTER_VERSION, RECORD_HEADER
from siltbed.store import WriteOptions

_CODEC = {"none": codecs.CODEC_NONE, "lz4": codecs.CODEC_LZ4}
_ENTRY, _FOOTER = struct.Struct("<IQI"), struct.Struct("<QQQQ6sBB")
#: Bytes of a part of a run file between tasks.
PART_BYTES = 16 << 20


class Entry(NamedTuple):
    first_key: bytes
    offset: int
    length: int


def encode_index(entries: list[Entry]) -> bytes:
    return struct.pack("<I", len(entries)) + b"".join(_ENTRY.pack(len(e.first_key), e.offset, e.length) + e.first_key for e in entries)


def decode_index(raw: bytes) -> list[Entry]:
    if len(raw) < BLOCK_COUNT:
        raise CorruptRunError("index count is short")
    (n,) = struct.unpack_from("<I", raw)
    out, at = [], BLOCK_COUNT
    for _ in range(n):
        if len(raw) - at < _ENTRY.size:
            raise CorruptRunError("index entry is short")
        key, offset, length = _ENTRY.unpack_from(raw, at)
        at += _ENTRY.size
        if key > len(raw) - at:
            raise CorruptRunError("index key is short")
        out.append(Entry(raw[at : at + key], offset, length))
        at += key
    return out


class Footer(NamedTuple):
    index_offset: int
    index_length: int
    filter_offset: int
    filter_length: int

    def encode(self) -> bytes:
        return _FOOTER.pack(*self, FOOTER_MAGIC.encode(), FOOTER_VERSION, 0)


def decode_footer(raw: bytes) -> Footer:
    """The footer of a whole file. The rules are those of ``layout.footer_error``, in the same order."""
    if len(raw) < FOOTER:
        raise CorruptRunError("file is too small")
    *places, magic, version, flags = _FOOTER.unpack_from(raw, len(raw) - FOOTER)
    f, end = Footer(*places), len(raw) - FOOTER
    after = f.index_offset + f.index_length
    if f.filter_length:
        filters = [(f.filter_offset != after or f.filter_offset > end, "filter offset"), (f.filter_length > end - f.filter_offset, "filter length"), (f.filter_offset + f.filter_length != end, "filter end")]
    else:
        filters = [(f.filter_offset != 0, "filter offset"), (after != end, "index end")]
    rules = [
        (magic != FOOTER_MAGIC.encode(), "magic"), (version != FOOTER_VERSION, "version"), (flags != 0, "flags"),
        (f.index_offset > end, "index offset"), (f.index_length > end - f.index_offset, "index length"), *filters,
    ]
    for broken, what in rules:
        if broken:
            raise CorruptRunError(what)
    return f


class RunWriter:
    """Turns records in ascending key order into the bytes of a file, of which it holds the open block, the index and the filter."""

    def __init__(self, n_records: int, options: WriteOptions | None = None):
        self.options = (options or WriteOptions()).checked()
        self.filter = BloomFilter.of([], self.options.fpr, n_records) if self.options.bloom and n_records else None
        self._index: list[Entry] = []
        self._open: list[Record] = []
        self._bytes, self._at, self._last = BLOCK_COUNT, 0, None

    def add(self, records: Iterable[Record]) -> Iterator[bytes]:
        """The blocks that close before or among ``records``."""
        keys = []
        for r in records:
            if self._last is not None and r.key < self._last:
                raise UnsortedRecordsError(f"{r.key!r} comes after {self._last!r}")
            self._last = r.key
            keys.append(r.key)
            size = RECORD_HEADER + len(r.key) + len(r.value)
            if self._open and self._bytes + size > self.options.block_size:
                yield self._close()
            self._open.append(r)
            self._bytes += size
        if self.filter is not None and keys:
            self.filter.add(keys)

    def finish(self) -> Iterator[bytes]:
        """The last block, index, filter and footer."""
        if self._open:
            yield self._close()
        index = encode_index(self._index)
        coded = self.filter.encode() if self.filter is not None else b""
        yield index + coded + Footer(self._at, len(index), self._at + len(index) if coded else 0, len(coded)).encode()

    def _close(self) -> bytes:
        block = codecs.encode_block(self._open, _CODEC[self.options.codec], self.options.savings)
        self._index.append(Entry(self._open[0].key, self._at, len(block)))
        self._open, self._bytes, self._at = [], BLOCK_COUNT, self._at + len(block)
        return block


def write_run(records: list[Record], options: WriteOptions | None = None) -> bytes:
    writer = RunWriter(len(records), options)
    return b"".join([*writer.add(records), *writer.finish()])


class RunFile:
    """A run file that was read: index and filter, and blocks on demand."""

    def __init__(self, raw: bytes):
        self.raw, self.footer = raw, decode_footer(raw)
        at = self.footer.index_offset
        self.index = decode_index(raw[at : at + self.footer.index_length])
        self._keys = [e.first_key for e in self.index]
        at = self.footer.filter_offset
        try:
            self.filter = BloomFilter.decode(raw[at : at + self.footer.filter_length]) if self.footer.filter_length else None
        except InvalidFilterError as e:
            raise CorruptRunError(f"filter: {e}") from e

    def block(self, entry: Entry) -> list[Record]:
        if entry.offset + entry.length > self.footer.index_offset:
            raise CorruptRunError("a block lies outside the blocks")
        return codecs.decode_block(self.raw[entry.offset : entry.offset + entry.length])

    def scan(self) -> Iterator[Record]:
        for entry in self.index:
            yield from self.block(entry)

    def get(self, key: bytes) -> Record:
        """The record of a key: NotFoundError if the run hasn't one, DeletedError if it is a tombstone. Reads a block at most."""
        if self.filter is not None and not self.filter.may_contain([key])[0]:
            raise NotFoundError(key)
        at = bisect.bisect_right(self._keys, key) - 1
        for r in self.block(self.index[at]) if at >= 0 else []:
            if r.key == key:
                if r.deleted:
                    raise DeletedError(key)
                return r
        raise NotFoundError(key)

    def max_seq(self) -> int:
        return max((r.seq for r in self.scan()), default=0)


# ---------------------------------------------------------------- tables


def run_files(df: DataFrame, run: str, options: WriteOptions | None = None) -> DataFrame:
    """(run, part, data): the file of the (key, seq, value, deleted) rows of each value of the long column ``run``, in parts.

    Spark sorts; a run is written by one task, which holds an open block, the index, the filter and a part. A run's
    number of records comes as a row before its first one. A null run is none: its rows are left out.
    """
    options = (options or WriteOptions()).checked()
    rows = df.filter(F.col(run).isNotNull()).select(F.col(run).cast("long").alias("run"), F.col("key").cast("binary").alias("key"), "seq", F.col("value").cast("binary").alias("value"), "deleted")
    counts = rows.groupBy("run").agg(F.count("*").alias("n"))
    counted = rows.withColumn("n", F.lit(None).cast("long")).unionByName(counts, allowMissingColumns=True)

    def write(batches):
        which, writer, number, held, size = None, None, 0, [], 0

        def parts(blocks: Iterable[bytes], last: bool):
            nonlocal number, held, size
            for block in blocks:
                held.append(block)
                size += len(block)
                if size >= PART_BYTES:
                    yield part()
                    number, held, size = number + 1, [], 0
            if last and held:
                yield part()

        def part():
            return pa.RecordBatch.from_arrays([pa.array([which], pa.int64()), pa.array([number], pa.int64()), pa.array([b"".join(held)], pa.binary())], names=["run", "part", "data"])

        for batch in batches:
            rows_of = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for (one, n), own in itertools.groupby(rows_of, key=lambda r: (r[0], r[5])):
                if n is None:
                    yield from parts(writer.add(Record(key, seq, value or b"", deleted) for _, key, seq, value, deleted, _ in own), False)
                    continue
                if writer is not None:
                    yield from parts(writer.finish(), True)
                which, writer, number, held, size = one, RunWriter(n, options), 0, [], 0
        if writer is not None:
            yield from parts(writer.finish(), True)

    return _whole_runs(counted).sortWithinPartitions("run", F.col("n").asc_nulls_last(), "key").mapInArrow(write, "run long, part long, data binary")


def _whole_runs(df: DataFrame) -> DataFrame:
    """``df`` with all rows of a run in one partition, for a map over partitions.

    Spark leaves out a shuffle by columns that a join or an aggregation below has dealt the rows by, and may then split the partitions of that
    one, as a map asks for none. Nothing below deals rows by a hash of the run, so this shuffle stays.
    """
    return df.repartition(F.xxhash64("run"))


def _files(batches) -> Iterator[tuple[int, RunFile]]:
    which, held = None, []
    for batch in batches:
        for run, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if run != which and held:
                yield which, RunFile(b"".join(held))
                held = []
            which = run
            held.append(data)
    if held:
        yield which, RunFile(b"".join(held))


def _in_order(parts: DataFrame) -> DataFrame:
    return _whole_runs(parts.select("run", "part", "data")).sortWithinPartitions("run", "part")


def run_records(parts: DataFrame) -> DataFrame:
    """(run, key, seq, value, deleted) of the files that ``run_files`` gives; a tombstone's value is null."""

    def read(batches):
        for run, file in _files(batches):
            for entry in file.index:
                rows = file.block(entry)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([run] * len(rows), pa.int64()), pa.array([r.key.decode() for r in rows], pa.string()), pa.array([r.seq for r in rows], pa.int64()), pa.array([None if r.deleted else r.value for r in rows], pa.binary()), pa.array([r.deleted for r in rows], pa.bool_())],
                    names=["run", "key", "seq", "value", "deleted"],
                )

    return _in_order(parts).mapInArrow(read, "run long, key string, seq long, value binary, deleted boolean")


def run_seek(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(run, key, seq, status) of a short list of keys in every file: live, deleted or absent; the sequence is that of a live record."""

    def seek(batches):
        for run, file in _files(batches):
            found = []
            for key in keys:
                try:
                    found.append((run, key, file.get(key.encode()).seq, "live"))
                except DeletedError:
                    found.append((run, key, None, "deleted"))
                except NotFoundError:
                    found.append((run, key, None, "absent"))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 4, (pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["run", "key", "seq", "status"])

    return _in_order(parts).mapInArrow(seek, "run long, key string, seq long, status string")
