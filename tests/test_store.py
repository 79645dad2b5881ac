"""The table through its life: writes, flushes, merges, reopening, errors."""

from __future__ import annotations

import struct
import threading

import pytest

from siltbed.functions.codecs import Record, crc32c
from siltbed.model import ClosedError, CorruptRunError, DeletedError, NotFoundError, StoreError, UnsortedRecordsError
from siltbed.sources import run_file
from siltbed.sources import snapshot as snapshots
from siltbed.store import Store, WriteOptions


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "key string, value string")


def contents(store):
    return {r["key"]: (r["seq"], bytes(r["value"])) for r in store.scan().collect()}


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/table"


def test_flush_and_reopen(spark, root):
    store = Store(spark, root, max_writes=2, merge_at=10)
    store.put(rows(spark, [("apple", "red"), ("banana", "yellow")]))
    assert [r.split(".")[0] for r in store.snapshot.runs] == ["runs/data-0"] and store.snapshot.segments == []
    store.put(rows(spark, [("cherry", "")]))
    store.close()
    store.close()
    with pytest.raises(ClosedError):
        store.get("apple")
    again = Store(spark, root, max_writes=2)
    assert again.snapshot.next_seq == 4 and again.get("banana") == b"yellow"
    assert again.get("cherry") == b""  # an empty value is a value


def test_newest_wins_and_tombstones(spark, root):
    store = Store(spark, root, max_writes=100)
    store.put(rows(spark, [("apple", "red"), ("banana", "yellow")]))
    store.flush()
    store.put(rows(spark, [("banana", "#ffe135"), ("cherry", "#de3163"), ("cherry", "again")]))
    store.delete(rows(spark, [("apple", ""), ("never", "")]))
    assert contents(store) == {"banana": (3, b"#ffe135"), "cherry": (5, b"again")}
    with pytest.raises(NotFoundError):
        store.get("apple")
    got = {r["key"]: r["status"] for r in store.multi_get(spark.createDataFrame([("apple",), ("banana",), ("zoo",)], "key string")).collect()}
    assert got == {"apple": "deleted", "banana": "live", "zoo": "absent"}
    store.flush()
    store.compact()
    assert len(store.snapshot.runs) == 1 and contents(store) == {"banana": (3, b"#ffe135"), "cherry": (5, b"again")}
    assert sum(r["deleted"] for r in store.versions().collect()) == 0
    assert store.snapshot.next_seq == 8  # numbers of dropped tombstones are not given out again


def test_automatic_merge_and_vacuum(spark, root):
    store = Store(spark, root, max_writes=1, merge_at=2)
    for k in range(3):
        store.put(rows(spark, [("k", str(k)), (f"k{k}", "x")]))
    assert len(store.snapshot.runs) == 1
    assert store.get("k") == b"2"
    gone = store.vacuum()
    assert gone and store.get("k") == b"2" and len(store.folder.list("runs")) == 1 and store.vacuum() == []


def test_merge_of_nothing_and_of_tombstones(spark, root):
    store = Store(spark, root, max_writes=100)
    store.compact()
    assert len(store.snapshot.runs) == 1 and contents(store) == {}
    store.delete(rows(spark, [("a", "")]))
    store.flush()
    store.compact()
    assert store.versions().count() == 0


def test_order_column_and_batches(spark, root):
    store = Store(spark, root, max_writes=1000)
    batch = spark.createDataFrame([("a", str(i), i) for i in reversed(range(50))], "key string, value string, at int").repartition(5)
    store.write(batch, order="at")
    assert contents(store) == {"a": (50, b"49")}


def test_second_writer_is_refused(spark, root):
    one, two = Store(spark, root), Store(spark, root)
    one.put(rows(spark, [("a", "1")]))
    with pytest.raises(StoreError):
        two.put(rows(spark, [("a", "2")]))
    assert Store(spark, root).get("a") == b"1"


def test_reader_keeps_its_snapshot(spark, root):
    store = Store(spark, root, max_writes=1)
    store.put(rows(spark, [("a", "1")]))
    reader = Store(spark, root, max_writes=1)
    view = reader.scan()
    store.put(rows(spark, [("a", "2")]))
    store.compact()
    assert [bytes(r["value"]) for r in view.collect()] == [b"1"]


def test_oversize_key_is_refused(spark, root):
    with pytest.raises(Exception, match="too long"):
        Store(spark, root).put(rows(spark, [("k" * 65537, "v")]))


def test_snapshot_numbers(spark, tmp_path):
    from siltbed.sources.files import Folder

    folder = Folder(spark, f"file://{tmp_path}/s")
    assert snapshots.read(folder) == snapshots.Snapshot()
    a = snapshots.commit(folder, snapshots.Snapshot(), next_run=7, runs=["runs/data-1", "runs/compact-5"])
    assert snapshots.read(folder) == a and a.runs == ["runs/data-1", "runs/compact-5"]
    with pytest.raises(StoreError):
        snapshots.commit(folder, snapshots.Snapshot(), next_run=1)


def test_key_order_is_bytewise(spark, root):
    from siltbed.operators.resolve import ranked

    keys = ["z", "é", "a", "ab", "Z", "", "10", "2", "\U0001f600", "�"]
    df = rows(spark, [(k, "v") for k in keys])
    got = [r["key"] for r in ranked(df).orderBy("place").collect()]
    assert got == sorted(keys, key=lambda k: k.encode())


def test_stream_ingest(spark, root, tmp_path):
    from siltbed.streaming.ingest import ingest

    source = str(tmp_path / "in")
    spark.createDataFrame([("a", "1", 1), ("b", "2", 2), ("a", "3", 3)], "key string, value string, at int").coalesce(1).write.parquet(source)
    changes = spark.readStream.schema("key string, value string, at int").parquet(source)
    store = Store(spark, root)
    for _ in range(2):  # the second run finds nothing new
        ingest(changes, store, f"file://{tmp_path}/check", order="at").awaitTermination()
    assert contents(store) == {"a": (3, b"3"), "b": (2, b"2")}


def test_vacuum_leaves_what_a_writer_is_about_to_commit(spark, root):
    store = Store(spark, root, max_writes=1)
    store.put(rows(spark, [("a", "1")]))
    other = Store(spark, root, max_writes=100)
    commit, seen = snapshots.commit, []

    def late(folder, old, **changes):  # the other writer's files are there, its snapshot isn't
        if not seen:
            seen.append(store.vacuum())
        return commit(folder, old, **changes)

    snapshots.commit = late
    try:
        other.put(rows(spark, [("b", "2")]))
    finally:
        snapshots.commit = commit
    assert seen and not any("log/" in n and n in other.snapshot.segments[-1] for n in seen[0])
    assert contents(Store(spark, root)) == {"a": (1, b"1"), "b": (2, b"2")}


def test_vacuum_grace_and_kept_snapshots(spark, root):
    store = Store(spark, root, max_writes=1, merge_at=100)
    for k in range(3):
        store.put(rows(spark, [("a", str(k))]))
    reader = Store(spark, root, max_writes=1 << 40)
    view = reader.scan()
    store.compact()
    spark.range(1).write.parquet(store.folder.at("runs/data-99.left-behind"))
    assert not any("runs/data" in n for n in store.vacuum(keep=2))  # the reader's snapshot is kept
    assert [bytes(r["value"]) for r in view.collect()] == [b"2"]
    assert store.vacuum(grace=3600) and store.folder.exists("runs/data-99.left-behind")
    assert store.vacuum(grace=-1) == ["runs/data-99.left-behind"]
    spark.range(1).write.parquet(store.folder.at("runs/data-99.left-behind"))
    assert Store(spark, root).snapshot.next_run == 100  # above all that lie there


def test_commit_of_vanished_files_is_refused(spark, root):
    store = Store(spark, root)
    with pytest.raises(StoreError, match="gone"):
        store._commit(runs=["runs/data-7.nowhere"])


def test_deleted_is_told_from_absent(spark, root):
    store = Store(spark, root)
    store.put(rows(spark, [("a", "1")]))
    store.delete(rows(spark, [("a", "")]))
    with pytest.raises(DeletedError):
        store.get("a")
    with pytest.raises(NotFoundError) as e:
        store.get("b")
    assert not isinstance(e.value, DeletedError)


@pytest.mark.parametrize(("options", "what"), [({"savings": 1.0}, "savings"), ({"savings": -0.1}, "savings"), ({"codec": "zip"}, "codec"), ({"fpr": 0.0}, "false positive"), ({"fpr": 1.0}, "false positive")])
def test_options_are_checked(spark, root, options, what):
    with pytest.raises(ValueError, match=what):
        Store(spark, root, options=WriteOptions(**options))
    assert WriteOptions(block_size=0, bloom=False, fpr=7.0).checked().block_size == 65536


@pytest.mark.parametrize("bloom", [True, False])
def test_filters_and_codecs_are_in_the_files(spark, root, bloom, tmp_path):
    import glob

    store = Store(spark, root, options=WriteOptions(bloom=bloom, codec="none" if bloom else "lz4"))
    store.put(rows(spark, [(f"k{i}", "v") for i in range(500)]))
    store.flush()
    for path in glob.glob(f"{tmp_path}/table/runs/*/*.parquet"):
        reader = spark._jvm.org.apache.parquet.hadoop.ParquetFileReader.open(spark._jvm.org.apache.hadoop.conf.Configuration(), spark._jvm.org.apache.hadoop.fs.Path(f"file://{path}"))
        column = reader.getFooter().getBlocks().get(0).getColumns().get(0)
        assert (column.getBloomFilterOffset() > 0) == bloom and column.getCodec().toString() == ("UNCOMPRESSED" if bloom else "LZ4_RAW")
        reader.close()
    assert store.get("k77") == b"v"


def test_threads_read_and_write(spark, root):
    """Readers and writers of one object, flushed in the background: every write is there once, and no read fails."""
    store = Store(spark, root, max_writes=4, merge_at=3, background=True)
    store.put(rows(spark, [("shared", "start")]))
    failures = []

    def guarded(f):
        def run():
            try:
                f()
            except Exception as e:
                failures.append(e)

        return threading.Thread(target=run)

    def write(who):
        for k in range(3):
            store.put(rows(spark, [(f"{who}-{k}", str(k)), ("shared", who)]))

    def read():
        for _ in range(5):
            assert store.get("shared") in (b"start", b"w0", b"w1")
            assert store.scan().count() >= 1

    threads = [guarded(lambda who=w: write(who)) for w in ("w0", "w1")] + [guarded(read) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    store.close()
    assert not failures
    again = Store(spark, root, max_writes=1 << 40)
    got = contents(again)
    assert set(got) == {"shared", *(f"w{w}-{k}" for w in (0, 1) for k in range(3))} and again.snapshot.next_seq == 14
    assert len({s for s, _ in got.values()}) == len(got)
    assert again.snapshot.runs  # the worker flushed


def test_streams_have_marks_of_their_own(spark, root, tmp_path):
    from siltbed.streaming.ingest import ingest

    store = Store(spark, root)
    for name in ("one", "two"):  # two streams, both starting at batch 0
        spark.createDataFrame([(name, "1")], "key string, value string").write.parquet(str(tmp_path / name))
        changes = spark.readStream.schema("key string, value string").parquet(str(tmp_path / name))
        ingest(changes, store, f"file://{tmp_path}/check-{name}").awaitTermination()
    assert set(contents(store)) == {"one", "two"} and len(store.snapshot.streams) == 2


def test_a_batch_that_is_run_again_is_stored_once(spark, root):
    store = Store(spark, root)
    flush, store._flush_if_due = store._flush_if_due, lambda: (_ for _ in ()).throw(RuntimeError("lost after the commit"))
    with pytest.raises(RuntimeError):
        store.write(rows(spark, [("a", "1")]), stream=("s", 0))
    store._flush_if_due = flush
    for other in (store, Store(spark, root)):  # the same object, and after reopening
        other.write(rows(spark, [("a", "1")]), stream=("s", 0))
        assert other.versions().count() == 1
    store.write(rows(spark, [("a", "2")]), stream=("s", 1))
    assert store.versions().count() == 2


# ---------------------------------------------------------------- binary run files


def records(n=300):
    return [Record(f"k{i:04}".encode(), i + 1, b"" if i % 7 == 0 else f"value {i} ".encode() * (i % 5 + 1), i % 7 == 0) for i in range(n)]


@pytest.mark.parametrize("options", [WriteOptions(), WriteOptions(block_size=64, codec="none"), WriteOptions(block_size=500, bloom=False), WriteOptions(savings=0.99)])
def test_run_file_round_trip_and_seek(options):
    raw = run_file.write_run(records(), options)
    file = run_file.RunFile(raw)
    assert list(file.scan()) == records() and file.max_seq() == 300 and (file.filter is not None) == options.bloom
    assert file.get(b"k0001").value == b"value 1 value 1 "
    for key, error in ((b"k0000", DeletedError), (b"k0001x", NotFoundError), (b"", NotFoundError), (b"zzz", NotFoundError)):
        with pytest.raises(NotFoundError) as e:
            file.get(key)
        assert type(e.value) is error
    assert [e.offset for e in file.index] == [0, *(e.offset + e.length for e in file.index[:-1])]
    if options.bloom:
        assert file.filter.may_contain([r.key for r in records()]).all()  # tombstones included


def test_run_file_layout_by_hand():
    raw = run_file.write_run([Record(b"a", 5, b"xy")], WriteOptions(codec="none", bloom=False))
    record = struct.pack("<IIQB", 1, 2, 5, 0) + b"axy"
    body = struct.pack("<BI", 0, 4 + len(record)) + struct.pack("<I", 1) + record
    block = body + struct.pack("<I", crc32c(body))
    index = struct.pack("<I", 1) + struct.pack("<IQI", 1, 0, len(block)) + b"a"
    assert raw == block + index + struct.pack("<QQQQ", len(block), len(index), 0, 0) + b"HYPSST" + bytes([2, 0])
    empty = run_file.RunFile(run_file.write_run([]))
    assert not empty.index and empty.filter is None and empty.max_seq() == 0


def test_run_file_refuses_unsorted_records():
    with pytest.raises(UnsortedRecordsError):
        run_file.write_run([Record(b"b", 1), Record(b"a", 2)])
    assert len(list(run_file.RunFile(run_file.write_run([Record(b"a", 1), Record(b"a", 2)])).scan())) == 2


def test_damaged_run_files():
    good = run_file.write_run(records(50), WriteOptions(block_size=200))
    footer = run_file.decode_footer(good)

    def with_footer(**changes):
        return good[:-40] + footer._replace(**changes).encode()

    end = len(good) - 40
    broken = [
        (good[:39], "too small"), (good[:-8] + b"X" + good[-7:], "magic"), (good[:-2] + b"\x63\0", "version"), (good[:-1] + b"\1", "flags"),
        (with_footer(index_offset=end + 1), "index offset"), (with_footer(index_length=end), "index length"), (with_footer(filter_length=0), "filter offset"), (with_footer(filter_offset=0, filter_length=0), "index end"),
        (with_footer(filter_offset=footer.filter_offset + 1), "filter offset"), (with_footer(filter_length=end), "filter length"), (with_footer(filter_length=footer.filter_length - 1), "filter end"),
        (good[: footer.filter_offset] + b"\x09" + good[footer.filter_offset + 1 :], "filter"),
    ]
    for raw, what in broken:
        with pytest.raises(CorruptRunError, match=what):
            run_file.RunFile(raw)
    flipped = run_file.RunFile(good[:20] + bytes([good[20] ^ 1]) + good[21:])
    with pytest.raises(CorruptRunError, match="checksum"):
        list(flipped.scan())
    index = good[footer.index_offset : footer.filter_offset]
    for raw in (b"", index[:10], index[:-1], struct.pack("<I", 9999) + index[4:]):
        with pytest.raises(CorruptRunError):
            run_file.decode_index(raw)


def test_run_files_of_a_table(spark):
    rows_of = [(k % 3, r.key.decode(), r.seq, None if r.deleted else r.value, r.deleted) for k, r in enumerate(records(400))]
    df = spark.createDataFrame(rows_of, "run long, key string, seq long, value binary, deleted boolean").repartition(5)
    part, run_file.PART_BYTES = run_file.PART_BYTES, 1000
    try:
        parts = run_file.run_files(df, "run", WriteOptions(block_size=300)).cache()
        assert parts.count() > 6  # several of each run
        got = [(r["run"], r["key"], r["seq"], None if r["value"] is None else bytes(r["value"]), r["deleted"]) for r in run_file.run_records(parts).collect()]
        assert sorted(got, key=str) == sorted(rows_of, key=str)
        seen = {(r["run"], r["key"]): (r["seq"], r["status"]) for r in run_file.run_seek(parts, ["k0000", "k0001", "nothing"]).collect()}
        assert seen[0, "k0000"] == (None, "deleted") and seen[1, "k0001"] == (2, "live") and seen[2, "k0001"] == (None, "absent") and len(seen) == 9
        assert run_file.run_seek(parts, []).count() == 0
    finally:
        run_file.PART_BYTES = part


def test_run_files_keep_runs_whole_whatever_the_plan(spark):
    """Joins by the run that turn into broadcast joins as they run, as with large tables: the shuffle by run that they had is then read in slices."""
    rows_of = [(k % 3, r.key.decode(), r.seq, None if r.deleted else r.value, r.deleted) for k, r in enumerate(records(400))]
    plan = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "2k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in plan.items():
        spark.conf.set(k, v)
    part, run_file.PART_BYTES = run_file.PART_BYTES, 1000
    try:
        df = spark.createDataFrame(rows_of, "run long, key string, seq long, value binary, deleted boolean")
        wanted = spark.createDataFrame([(k,) for k in range(3)], "run long")
        for one in (df, df.join(wanted, "run")):
            parts = run_file.run_files(one, "run", WriteOptions(block_size=300))
            assert parts.count() == parts.select("run", "part").distinct().count() > 6
            got = [(r["run"], r["key"], r["seq"], None if r["value"] is None else bytes(r["value"]), r["deleted"]) for r in run_file.run_records(parts).collect()]
            assert sorted(got, key=str) == sorted(rows_of, key=str)
    finally:
        run_file.PART_BYTES = part
        for k in plan:
            spark.conf.unset(k)


def test_run_seek_and_records_of_joined_parts(spark):
    """Parts that a join by the run has dealt already, which turns into a broadcast join as it runs: a file's parts stay together."""
    rows_of = [(k % 3, r.key.decode(), r.seq, None if r.deleted else r.value, r.deleted) for k, r in enumerate(records(400))]
    plan = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "2k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    part, run_file.PART_BYTES = run_file.PART_BYTES, 1000
    try:
        files = run_file.run_files(spark.createDataFrame(rows_of, "run long, key string, seq long, value binary, deleted boolean"), "run", WriteOptions(block_size=300)).collect()
        for k, v in plan.items():
            spark.conf.set(k, v)
        parts, wanted = spark.createDataFrame(files, "run long, part long, data binary").repartition(4), spark.createDataFrame([(k,) for k in range(3)], "run long")
        joined = parts.join(wanted, "run")
        got = [(r["run"], r["key"], r["seq"], None if r["value"] is None else bytes(r["value"]), r["deleted"]) for r in run_file.run_records(joined).collect()]
        assert sorted(got, key=str) == sorted(rows_of, key=str)
        seen = {(r["run"], r["key"]): (r["seq"], r["status"]) for r in run_file.run_seek(joined, ["k0000", "k0001", "nothing"]).collect()}
        assert seen[0, "k0000"] == (None, "deleted") and seen[1, "k0001"] == (2, "live") and seen[2, "k0001"] == (None, "absent") and len(seen) == 9
    finally:
        run_file.PART_BYTES = part
        for k in plan:
            spark.conf.unset(k)
