"""Sizes, block packing, sparse index, and format rules as SQL expressions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siltbed.model import MAX_KEY_BYTES, MAX_VALUE_BYTES
from siltbed.operators.resolve import by_range

#: Fixed values of the formats, in bytes.
RECORD_HEADER, BLOCK_COUNT, BLOCK_HEADER, BLOCK_CHECKSUM, FOOTER = 17, 4, 5, 4, 40
MAX_BLOCK_BYTES = 256 << 20
FOOTER_MAGIC, FOOTER_VERSION = "HYPSST", 2
DEFAULT_BLOCK_SIZE, DEFAULT_SAVINGS, DEFAULT_FPR = 64 << 10, 0.125, 0.01
#: Codecs of runs, by what Parquet calls them.
CODECS = {"none": "uncompressed", "lz4": "lz4_raw"}


def encoded_size(key: Column, value: Column) -> Column:
    """Bytes of an encoded record."""
    return (F.lit(RECORD_HEADER) + F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def blocks(df: DataFrame, run: list[str], block_size: int = DEFAULT_BLOCK_SIZE) -> DataFrame:
    """The blocks of each run of (key, size) rows: block_no, first_key, records, raw_bytes.

    Blocks fill greedily in key order: one starts with its record count, and
    closes before a record that would pass ``block_size`` unless it is empty. Where a block starts
    depends on all before it, so a run takes one task; it reads keys and sizes alone, sorted
    by Spark, and holds one batch of them and the open block.
    """
    size = block_size if block_size > 0 else DEFAULT_BLOCK_SIZE
    kept = [df.schema[c] for c in run]
    schema = T.StructType([*kept, T.StructField("block_no", T.LongType()), T.StructField("first_key", df.schema["key"].dataType), T.StructField("records", T.LongType()), T.StructField("raw_bytes", T.LongType())])

    def pack(batches):
        which, number, first, n, filled = None, 0, None, 0, BLOCK_COUNT
        for batch in batches:
            closed = []
            runs, keys, sizes = batch.select(run).to_pylist(), batch.column("key"), batch.column("size").to_numpy(zero_copy_only=False)
            ends, at = np.cumsum(sizes), 0
            changes = [k for k in range(1, len(runs)) if runs[k] != runs[k - 1]] + [len(runs)]
            for stop in changes:
                if which is not None and runs[at] != which[0]:
                    if n:
                        closed.append((which[0], number, first, n, filled))
                    which, number, n, filled = None, 0, 0, BLOCK_COUNT
                which = (runs[at],)
                while at < stop:
                    done = ends[at - 1] if at else 0
                    take = int(np.searchsorted(ends[:stop], done + size - filled, side="right"))
                    if take <= at and n:  # the next record doesn't fit
                        closed.append((which[0], number, first, n, filled))
                        number, n, filled = number + 1, 0, BLOCK_COUNT
                        continue
                    take = max(take, at + 1)
                    first = first if n else keys[at].as_py()
                    n, filled, at = n + take - at, filled + int(ends[take - 1] - done), take
            yield rows(closed)
        if n:
            yield rows([(which[0], number, first, n, filled)])

    def rows(closed):
        return pa.RecordBatch.from_pylist([c[0] | {"block_no": c[1], "first_key": c[2], "records": c[3], "raw_bytes": c[4]} for c in closed], schema=arrow)

    arrow = to_arrow_schema(schema)
    return df.select(*run, "key", F.col("size").cast("long").alias("size")).repartition(*run).sortWithinPartitions(*run, "key").mapInArrow(pack, schema)


def sparse_index(layout: DataFrame, run: list[str]) -> DataFrame:
    """first_key, offset and length of each uncompressed block in its run's file."""
    length = F.col("raw_bytes") + BLOCK_HEADER + BLOCK_CHECKSUM
    before = F.coalesce(F.sum(length).over(W.partitionBy(*run).orderBy("block_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return layout.select(*run, "block_no", "first_key", before.cast("long").alias("offset"), length.cast("long").alias("length"))


def floor_lookup(index: DataFrame, probes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``probes`` (a column key) with the entry that has the greatest first_key not above the key; nulls if none has.
    With columns ``by``, which both sides have, entries count only where these agree; nulls agree.

    Both sides meet in one pass in key order: ranges of keys that Spark cuts to size are split over
    tasks, the last entry of each range is carried to the next, and inside a range
    a window fills it down, so there is no join on an inequality.
    """
    columns = [c for c in index.columns if c not in by]
    entries = index.select(*by, F.col("first_key").alias("key"), F.lit(0).alias("kind"), F.struct(*columns).alias("entry"))
    wanted = probes.select(*by, "key", F.lit(1).alias("kind"), F.lit(None).cast(entries.schema["entry"].dataType).alias("entry"))
    both = by_range(entries.unionByName(wanted), "key", ("kind",), "floor").withColumnRenamed("__range", "__part").drop("__inner")
    ordered = W.partitionBy(*by, "__part").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = both.withColumn("__found", F.last("entry", ignorenulls=True).over(ordered))
    last = F.max_by(F.when(F.col("kind") == 0, F.col("entry")), F.when(F.col("kind") == 0, F.col("key"))).alias("__last")
    parts = both.groupBy(*by, "__part").agg(last)
    carried = parts.select(*(F.col(c).alias(f"__of_{c}") for c in (*by, "__part")), F.last("__last", ignorenulls=True).over(W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)).alias("__carried"))
    same = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in (*by, "__part")]
    out = inside.filter("kind = 1").join(carried, same).withColumn("__entry", F.coalesce("__found", "__carried"))
    return out.select(*by, "key", *(F.col(f"__entry.{c}").alias(c) for c in columns))


def should_compress(raw: Column, compressed: Column, least: Column) -> Column:
    """Whether compression saves at least the wanted share of the raw bytes."""
    saved = (raw - compressed).cast("double") / raw.cast("double")
    return F.when((raw <= 0) | (compressed >= raw), F.lit(False)).otherwise(saved >= least)


def bloom_bits(n: Column, fpr: Column) -> Column:
    """Bits of a filter, in whole bytes."""
    return (F.ceil(_ideal_bits(n, fpr) / 8) * 8).cast("long")


def bloom_hashes(n: Column, fpr: Column) -> Column:
    """Hash functions of a filter: from the bits before they are filled up to bytes, between 1 and 30."""
    return F.least(F.greatest(F.round(_ideal_bits(n, fpr) / n * math.log(2)), F.lit(1)), F.lit(30)).cast("int")


def _ideal_bits(n: Column, fpr: Column) -> Column:
    return F.ceil(-n.cast("double") * F.log(fpr) / (math.log(2) * math.log(2)))


def record_error(flags: Column, key_bytes: Column, value_bytes: Column, remaining: Column) -> Column:
    """The first rule that a record header breaks, or null."""
    return (
        F.when(flags.bitwiseAND(F.lit(254)) != 0, "flags")
        .when(key_bytes > MAX_KEY_BYTES, "key length")
        .when(value_bytes > MAX_VALUE_BYTES, "value length")
        .when(key_bytes + value_bytes > remaining, "payload is short")
    )


def footer_error(size: Column, magic: Column, version: Column, flags: Column, index_offset: Column, index_length: Column, filter_offset: Column, filter_length: Column) -> Column:
    """The first rule that a footer breaks, or null. Blocks, index, filter and footer must follow each other without gaps."""
    end = size - FOOTER
    index_end = index_offset + index_length
    return (
        F.when(size < FOOTER, "file is too small")
        .when(magic != FOOTER_MAGIC, "magic")
        .when(version != FOOTER_VERSION, "version")
        .when(flags != 0, "flags")
        .when(index_offset > end, "index offset")
        .when(index_length > end - index_offset, "index length")
        .when((filter_length == 0) & (filter_offset != 0), "filter offset")
        .when((filter_length == 0) & (index_end != end), "index end")
        .when((filter_length != 0) & (filter_offset != index_end), "filter offset")
        .when((filter_length != 0) & (filter_offset > end), "filter offset")
        .when((filter_length != 0) & (filter_length > end - filter_offset), "filter length")
        .when((filter_length != 0) & (filter_offset + filter_length != end), "filter end")
    )


def options_error(codec: Column, savings: Column, bloom: Column, fpr: Column) -> Column:
    """The first rule that write options break, or null. A block size of 0 or less means the default and is no error."""
    unordered = F.isnan(savings)
    return (
        F.when(unordered | (savings < 0) | (savings >= 1), "savings")
        .when(~codec.isin(0, 1), "codec")
        .when(bloom & (F.isnan(fpr) | (fpr <= 0) | (fpr >= 1)), "false positive rate")
    )
