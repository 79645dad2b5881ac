"""The codecs over DataFrame columns, a batch of Arrow rows at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.functions import bloom, codecs
from siltbed.functions.codecs import Record


def _bytes(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x.encode() if isinstance(x, str) else x for x in column.to_pylist()]


def encoded_records(df: DataFrame) -> DataFrame:
    """(key, encoded) of (key, seq, value, deleted) rows."""

    def run(batches):
        for b in batches:
            rows = zip(_bytes(b.column(0)), b.column(1).to_pylist(), _bytes(b.column(2)), b.column(3).to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codecs.encode_record(Record(*r)) for r in rows], pa.binary())], names=["key", "encoded"])

    return df.select("key", "seq", "value", "deleted").mapInArrow(run, "key string, encoded binary")


def decoded_records(df: DataFrame) -> DataFrame:
    """(key, seq, value, deleted) of a column ``encoded``."""

    def run(batches):
        for b in batches:
            rows = [codecs.decode_record(x)[0] for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.key.decode() for r in rows], pa.string()), pa.array([r.seq for r in rows], pa.int64()), pa.array([None if r.deleted else r.value for r in rows], pa.binary()), pa.array([r.deleted for r in rows], pa.bool_())],
                names=["key", "seq", "value", "deleted"],
            )

    return df.select("encoded").mapInArrow(run, "key string, seq long, value binary, deleted boolean")


def encoded_blocks(df: DataFrame, block: str) -> DataFrame:
    """(block, records, data): physical blocks of the rows of each value of ``block``, which must be of a block's size."""

    def one(key, table):
        table = table.sort_by("key")
        rows = [Record(*r) for r in zip(_bytes(table["key"]), table["seq"].to_pylist(), _bytes(table["value"]), table["deleted"].to_pylist(), strict=True)]
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "records": pa.array([len(rows)], pa.int64()), "data": pa.array([codecs.encode_block(rows)], pa.binary())})

    return df.select(F.col(block).cast("long").alias("block"), "key", "seq", "value", "deleted").groupBy("block").applyInArrow(one, "block long, records long, data binary")


def decoded_blocks(df: DataFrame) -> DataFrame:
    """(block, key, seq, value, deleted) of physical blocks (block, data)."""

    def run(batches):
        for b in batches:
            for number, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = codecs.decode_block(data)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(rows), pa.int64()), pa.array([r.key.decode() for r in rows], pa.string()), pa.array([r.seq for r in rows], pa.int64()), pa.array([None if r.deleted else r.value for r in rows], pa.binary()), pa.array([r.deleted for r in rows], pa.bool_())],
                    names=["block", "key", "seq", "value", "deleted"],
                )

    return df.select("block", "data").mapInArrow(run, "block long, key string, seq long, value binary, deleted boolean")


def filter_positions(keys: DataFrame, bits: int, hashes: int) -> DataFrame:
    """(key, positions): the bits that each key sets and tests."""

    def run(batches):
        for b in batches:
            at = bloom.probes(_bytes(b.column(0)), bits, hashes).astype(np.int64) if len(b) else np.zeros((0, hashes), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * hashes), pa.array(at.reshape(-1)))], names=["key", "positions"])

    return keys.select("key").mapInArrow(run, "key string, positions array<long>")


def may_contain(keys: DataFrame, probes: DataFrame, fpr: float) -> DataFrame:
    """(key, may_contain) for ``probes`` against the Bloom filter of ``keys``, kept as a table of set bits: it needs no single memory."""
    n = keys.count()
    bits, hashes = bloom.parameters(max(1, n), fpr)
    present = filter_positions(keys, bits, hashes).select(F.explode("positions").alias("bit")).distinct().withColumn("set", F.lit(1))
    asked = filter_positions(probes.select("key").distinct(), bits, hashes).select("key", F.explode("positions").alias("bit"))
    return asked.join(present, "bit", "left").groupBy("key").agg((F.count("set") == F.count("*")).alias("may_contain"))


#: Bytes of a filter that are merged together, and of partial filters that a task holds before it passes them on.
_RANGE, _HELD = 1 << 16, 1 << 26


def filters_by_run(keys: DataFrame, run: str, fpr: float) -> DataFrame:
    """(run, n_keys, bits, hashes, encoded) of the Bloom filter of each run's keys, a null run being one too.

    Tasks pass on the byte ranges of their partial filters that have a bit set; ranges of all
    tasks are merged one by one, and only the last step, whose result is one value, has a whole filter.
    """
    counts = keys.groupBy(F.col(run).alias("__run")).agg(F.count("*").alias("n_keys"))
    sized = keys.join(counts, F.col(run).eqNullSafe(F.col("__run"))).select(F.col(run).cast("string").alias("run"), "key", "n_keys")

    def rows(held):
        out = [(name, n, k, f.data[k * _RANGE : (k + 1) * _RANGE]) for (name, n), f in held.items() for k in range(-(-len(f.data) // _RANGE))]
        out = [x for x in out if x[3].any()]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3].tobytes() for x in out], pa.binary())], names=["run", "n_keys", "part", "data"])

    def part(batches):
        held: dict[tuple[str | None, int], bloom.BloomFilter] = {}
        size = 0
        for b in batches:
            found: dict[tuple[str | None, int], list[bytes]] = {}
            for name, key, n in zip(b.column(0).to_pylist(), _bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                found.setdefault((name, n), []).append(key)
            for which, own in found.items():
                if which not in held:
                    held[which] = bloom.BloomFilter(*bloom.parameters(which[1], fpr))
                    size += len(held[which].data)
                held[which].add(own)
                if size > _HELD:
                    yield rows(held)
                    held, size = {}, 0
        if held:
            yield rows(held)

    def merged(table):
        data = np.frombuffer(table["data"][0].as_py(), np.uint8).copy()
        for raw in table["data"][1:]:
            data |= np.frombuffer(raw.as_py(), np.uint8)
        return table.slice(0, 1).select(["run", "n_keys", "part"]).append_column("data", pa.array([data.tobytes()], pa.binary()))

    def whole(table):
        n = table["n_keys"][0].as_py()
        out = bloom.BloomFilter(*bloom.parameters(n, fpr))
        for k, raw in zip(table["part"].to_pylist(), table["data"], strict=True):
            data = np.frombuffer(raw.as_py(), np.uint8)
            out.data[k * _RANGE : k * _RANGE + len(data)] = data
        return pa.table({"run": table["run"][:1], "n_keys": pa.array([n], pa.int64()), "bits": pa.array([out.bits], pa.int64()), "hashes": pa.array([out.hashes], pa.int32()), "encoded": pa.array([out.encode()], pa.binary())})

    parts = "run string, n_keys long, part long, data binary"
    ranges = sized.mapInArrow(part, parts).groupBy("run", "part").applyInArrow(merged, parts)
    return ranges.groupBy("run").applyInArrow(whole, "run string, n_keys long, bits long, hashes int, encoded binary")
