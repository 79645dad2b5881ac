"""A log-structured table: batches of versions appended to a log, flushed into sorted runs, merged into one.

Writes, flushes and merges are Spark jobs over batches; a snapshot file that is
stored all or nothing names the segments and runs that count. Every read works
on the snapshot it started from. ``vacuum`` removes the files of snapshots it doesn't keep, so
readers of kept ones are never cut off, and files that no snapshot has named yet stay for ``grace``
seconds, so another writer can still commit them.

One object may be used by several threads: batches are written at the same time and get their
sequence numbers when they are committed; flushes and merges run one at a time, beside
writes and reads. With ``background`` a thread of its own flushes.
"""

from __future__ import annotations

import queue
import threading
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltbed.model import MAX_KEY_BYTES, MAX_VALUE_BYTES, RECORD, TIER_CLOSED, TIER_RUN, ClosedError, DeletedError, NotFoundError, StoreError
from siltbed.operators import resolve
from siltbed.operators.layout import CODECS, DEFAULT_BLOCK_SIZE, DEFAULT_FPR, DEFAULT_SAVINGS
from siltbed.sources import snapshot as snapshots
from siltbed.sources.files import Folder
from siltbed.sources.log import segment_name

#: Rows of a run's Parquet row group are few enough for a key lookup to read little; a record takes some bytes of it at least.
RUN_BLOCK_BYTES, _LEAST_RECORD = 8 << 20, 64


@dataclass(frozen=True)
class WriteOptions:
    """How runs are written: bytes of a block (a Parquet page; 0 or less means the default), codec, the least
    saving for which a block of a binary run is kept compressed, and the Bloom filter on keys."""

    block_size: int = DEFAULT_BLOCK_SIZE
    codec: str = "lz4"
    savings: float = DEFAULT_SAVINGS
    bloom: bool = True
    fpr: float = DEFAULT_FPR

    def checked(self) -> WriteOptions:
        """The options with defaults filled in; ValueError names the first rule that is broken."""
        if not 0 <= self.savings < 1:
            raise ValueError("savings")
        if self.codec not in CODECS:
            raise ValueError("codec")
        if self.bloom and not 0 < self.fpr < 1:
            raise ValueError("false positive rate")
        return self if self.block_size > 0 else WriteOptions(DEFAULT_BLOCK_SIZE, self.codec, self.savings, self.bloom, self.fpr)


class Store:
    """Open with ``Store(spark, root)``; ``max_writes`` pending writes start a flush, ``merge_at`` runs a merge."""

    def __init__(self, spark: SparkSession, root: str, max_writes: int = 1_000_000, merge_at: int = 10, bloom: bool = True, options: WriteOptions | None = None, background: bool = False):
        self.options = (options or WriteOptions(bloom=bloom)).checked()
        self.spark, self.max_writes, self.merge_at = spark, max_writes, merge_at
        self.folder = Folder(spark, root)
        self.snapshot = snapshots.repaired(self.folder, snapshots.read(self.folder))
        self._closed = False
        self._state, self._upkeep = threading.RLock(), threading.RLock()
        self._signal: queue.Queue[bool] | None = queue.Queue(1) if background else None
        self._failure: Exception | None = None
        if background:
            self._worker = threading.Thread(target=self._flush_when_told, name="flush", daemon=True)
            self._worker.start()
        self._flush_if_due()

    # ------------------------------------------------------------ writes

    def write(self, rows: DataFrame, order: str | None = None, stream: tuple[str, int] | None = None) -> None:
        """Appends a batch with key and value columns (and deleted, where rows can be tombstones).

        Sequence numbers follow ``order``, or the order of the rows in the batch's partitions;
        among rows of a key the last one wins. Keys and values over the format's limits are refused.
        With ``stream``, a name and a number, the batch is stored only if the stream's last number in the table is smaller;
        batch and number are stored together.
        """
        self._open()
        if stream is not None and self.snapshot.streams.get(stream[0], -1) >= stream[1]:
            return
        if order is not None:
            rows = rows.repartitionByRange(order).sortWithinPartitions(order)
        deleted = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in rows.columns else F.lit(False)
        value = F.col("value").cast("binary") if "value" in rows.columns else F.lit(None).cast("binary")
        key_fits = F.assert_true(F.octet_length("key") <= MAX_KEY_BYTES, "key is null or too long")
        value_fits = F.assert_true(F.coalesce(F.octet_length("value"), F.lit(0)) <= MAX_VALUE_BYTES, "value is too long")
        batch = rows.select(F.col("key").cast("string").alias("key"), F.when(~deleted, F.coalesce(value, F.lit(b""))).alias("value"), deleted.alias("deleted"))
        batch = batch.withColumn("place", F.monotonically_increasing_id() + F.when(F.coalesce(key_fits, value_fits).isNull(), F.lit(0)))
        name = self._fresh(f"log/{segment_name(self.snapshot.next_segment)}")
        batch.write.parquet(self.folder.at(name))
        n = self._batch(name).count()
        if not n:
            return
        with self._state:
            now = self.snapshot
            streams = now.streams if stream is None else now.streams | {stream[0]: stream[1]}
            self._commit(next_segment=now.next_segment + 1, next_seq=now.next_seq + n, pending_writes=now.pending_writes + n, segments=[*now.segments, f"{name}@{now.next_seq}"], streams=streams)
        self._flush_if_due()

    def put(self, rows: DataFrame) -> None:
        """Appends (key, value) rows."""
        self.write(rows.select("key", "value"))

    def delete(self, keys: DataFrame) -> None:
        """Appends a tombstone for each key, whether or not the key exists."""
        self.write(keys.select("key", F.lit(None).cast("binary").alias("value"), F.lit(True).alias("deleted")))

    def flush(self) -> None:
        """Turns the pending segments into one sorted run with the last version of each key, and merges if there are enough runs."""
        self._open()
        with self._upkeep:
            then = self.snapshot
            if not then.segments:
                return
            name = self._fresh(f"runs/data-{then.next_run}")
            self._write_run(resolve.latest(self._pending(then)), name, then.pending_writes)
            with self._state:  # batches that came meanwhile stay pending
                now = self.snapshot
                self._commit(next_run=then.next_run + 1, pending_writes=now.pending_writes - then.pending_writes, segments=now.segments[len(then.segments) :], runs=[*now.runs, name])
            if len(self.snapshot.runs) >= max(1, self.merge_at):
                self.compact()

    def compact(self) -> None:
        """Merges all runs into one. Tombstones go, which only a merge of all runs may do."""
        self._open()
        with self._upkeep:
            then = self.snapshot
            name = self._fresh(f"runs/compact-{then.next_run}")
            runs = self._runs(then)
            self._write_run(resolve.live(resolve.resolve_layers(runs)), name, runs.count() if self.options.bloom and then.runs else 0)
            with self._state:
                self._commit(next_run=then.next_run + 1, runs=[name])

    # ------------------------------------------------------------ reads

    def versions(self) -> DataFrame:
        """Every stored version with its tier and position."""
        self._open()
        now = self.snapshot
        pending = self._pending(now).select("*", F.lit(TIER_CLOSED).alias("tier"), F.lit(0).cast("long").alias("position"))
        return self._runs(now).unionByName(pending)

    def scan(self) -> DataFrame:
        """The live version of every key."""
        return resolve.live(resolve.resolve_layers(self.versions()))

    def get(self, key: str) -> bytes:
        """The value of one key; DeletedError if its newest version is a tombstone, NotFoundError if there is none."""
        row = resolve.resolve_layers(self.versions().filter(F.col("key") == key)).select("value", "deleted").first()
        if row is None:
            raise NotFoundError(key)
        if row["deleted"]:
            raise DeletedError(key)
        return bytes(row["value"])

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """``keys`` with seq, value and status (live, deleted or absent)."""
        wanted = self.versions().join(keys.select("key").distinct(), "key", "left_semi")
        found = resolve.resolve_layers(wanted)
        status = F.when(F.col("deleted").isNull(), "absent").when(F.col("deleted"), "deleted").otherwise("live")
        return keys.join(found, "key", "left").withColumn("status", status)

    # ------------------------------------------------------------ upkeep

    def vacuum(self, keep: int = 1, grace: float = 86_400.0) -> list[str]:
        """Removes segments and runs that older snapshots name and none of the newest ``keep`` does, and those that no
        snapshot names and nothing has changed in for ``grace`` seconds: a writer may be about to commit them."""
        self._open()
        every = snapshots.every(self.folder)
        kept = set().union(*(s.names() for _, s in every[-max(1, keep) :]))
        named = set().union(*(s.names() for _, s in every))
        there = [f"{top}/{n}" for top in ("runs", "log") for n in self.folder.list(top)]
        gone = [n for n in there if n not in kept and (n in named or self.folder.age(n) > grace)]
        for name in [*gone, *(file for file, _ in every[: -max(1, keep)])]:
            self.folder.delete(name)
        return gone

    def close(self) -> None:
        """Ends the use of this object; pending writes stay in the log. Waits for a flush that runs; closing twice is fine."""
        if self._closed:
            return
        if self._signal is not None:
            self._signal.put(False)
            self._worker.join()
        self._closed = True
        if self._failure is not None:
            raise self._failure

    # ------------------------------------------------------------ inside

    def _open(self) -> None:
        if self._closed:
            raise ClosedError("the store is closed")

    def _flush_if_due(self) -> None:
        if self.snapshot.pending_writes < max(1, self.max_writes):
            return
        if self._signal is None:
            self.flush()
            return
        try:
            self._signal.put_nowait(True)
        except queue.Full:  # it will see these writes, too
            pass

    def _flush_when_told(self) -> None:
        while self._signal.get():
            try:
                if self.snapshot.pending_writes >= max(1, self.max_writes):
                    self.flush()
            except Exception as e:  # told on closing; the writes are still in the log
                self._failure = e

    @staticmethod
    def _fresh(name: str) -> str:
        """A folder that no other writer can have chosen: one that loses the race for a snapshot must not touch the winner's files."""
        return f"{name}.{uuid.uuid4().hex[:12]}"

    def _commit(self, **changes) -> None:
        gone = [n for n in sorted(replace(self.snapshot, **changes).names() - self.snapshot.names()) if not self.folder.exists(n)]
        if gone:  # removed as left behind, after ``grace``
            raise StoreError(f"files of this commit are gone: {', '.join(gone)}")
        self.snapshot = snapshots.commit(self.folder, self.snapshot, **changes)

    def _batch(self, name: str) -> DataFrame:
        return self.spark.read.schema("key string, value binary, deleted boolean, place long").parquet(self.folder.at(name))

    def _pending(self, snapshot: snapshots.Snapshot) -> DataFrame:
        """Rows of the pending segments as records; a batch's places become sequence numbers from its first one."""
        out = self.spark.createDataFrame([], RECORD)
        for entry in snapshot.segments:
            name, first = entry.rsplit("@", 1)
            rows = self._batch(name).withColumn("part", F.shiftright("place", 33))
            counts = rows.groupBy("part").agg(F.count("*").alias("n"))
            before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row for each task that wrote
            starts = counts.select("part", before.alias("before"))
            seq = F.lit(int(first)) + F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
            out = out.unionByName(rows.join(starts, "part").select("key", seq.cast("long").alias("seq"), "value", "deleted"))
        return out

    def _runs(self, snapshot: snapshots.Snapshot) -> DataFrame:
        out = self.spark.createDataFrame([], RECORD).select("*", F.lit(TIER_RUN).alias("tier"), F.lit(0).cast("long").alias("position"))
        for position, name in enumerate(snapshot.runs):
            rows = self.spark.read.schema(RECORD).parquet(self.folder.at(name))
            out = out.unionByName(rows.select("*", F.lit(TIER_RUN).alias("tier"), F.lit(position).cast("long").alias("position")))
        return out

    def _write_run(self, records: DataFrame, name: str, n: int) -> None:
        """One range of keys to each file, sorted within, so that statistics and filters skip what a lookup doesn't need. There are at most ``n`` records."""
        ordered = records.select("key", "seq", "value", "deleted").repartitionByRange("key").sortWithinPartitions("key")
        writer = ordered.write.option("parquet.block.size", RUN_BLOCK_BYTES).option("parquet.page.size", self.options.block_size).option("compression", CODECS[self.options.codec])
        if self.options.bloom and n:
            expected = min(n, RUN_BLOCK_BYTES // _LEAST_RECORD)  # a filter is that of a row group
            writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(expected)).option("parquet.bloom.filter.fpp#key", str(self.options.fpr))
        writer.parquet(self.folder.at(name))
