"""Registered queries over the driver's tables, each with its SQL.

``events`` is read as a change log: the user is the key, the event number the
sequence, an error event a tombstone, and props the value. ``documents`` gives
records of realistic sizes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions import udfs
from siltbed.operators import layout, resolve, rotation
from siltbed.sources import log, run_file, snapshot
from siltbed.sources.files import shared_dir
from siltbed.store import Store, WriteOptions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

RUN_WRITES = 1000
_LOG = """log as (select cast(user_id as varchar) as key, event_id as seq, case when event_type = 'error' then null else props end as value,
  event_type = 'error' as deleted, event_id // 1000 as run_pos from events),
newest as (select * from (select *, row_number() over (partition by key order by run_pos desc, seq desc) as rn from log) where rn = 1)"""
_DOCS = "docs as (select cast(doc_id as varchar) as key, source as run, 17 + strlen(cast(doc_id as varchar)) + coalesce(strlen(text), 0) as size from documents)"


def query(sql: str | None = None):
    """Registers a function as a query under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    deleted = F.col("event_type") == "error"
    return events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.when(~deleted, F.col("props")).alias("value"), deleted.alias("deleted"))


def layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log as runs of RUN_WRITES sequence numbers, from old to new."""
    return change_log(spark, sf_dir).withColumn("tier", F.lit(0)).withColumn("position", F.floor(F.col("seq") / RUN_WRITES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records of one run for each source; a null text is an empty value."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").cast("string").alias("key"), F.col("doc_id").alias("seq"), F.coalesce("text", F.lit("")).alias("value"), F.lit(False).alias("deleted"), F.col("source").alias("run"))


@query(f"with {_LOG} select key, seq, value from newest where not deleted")
def compact_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs merged: the newest version of each key, tombstones dropped."""
    return resolve.live(resolve.resolve_layers(layered(spark, sf_dir))).select("key", "seq", "value")


@query(f"with {_LOG} select key, seq, value, deleted from newest")
def put_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last write of each key, tombstones kept."""
    return resolve.latest(change_log(spark, sf_dir)).select("key", "seq", "value", "deleted")


@query(f"with {_LOG} select key, seq from newest where deleted")
def delete_tombstone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that end in a delete."""
    return resolve.latest(change_log(spark, sf_dir)).filter("deleted").select("key", "seq")


@query(f"with {_LOG} select key, seq, value from newest where key = '42' and not deleted")
def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key's live version."""
    return resolve.point_get(change_log(spark, sf_dir), "42").select("key", "seq", "value")


@query(f"""with {_LOG}, keys as (select cast(c_custkey as varchar) as key from customer)
select keys.key, seq, value, case when newest.key is null then 'absent' when deleted then 'deleted' else 'live' end as status from keys left join newest on keys.key = newest.key""")
def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many keys at once, with what became of each."""
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("key"))
    return resolve.multi_get(change_log(spark, sf_dir), keys).select("key", "seq", "value", "status")


@query(f"with {_LOG} select key, seq, deleted, row_number() over (order by key) as place from newest")
def sorted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in key order, tombstones included."""
    return resolve.ranked(resolve.latest(change_log(spark, sf_dir)).select("key", "seq", "deleted"))


@query("select event_id as seq, row_number() over (order by event_id) as write_no, (row_number() over (order by event_id) - 1) // 1000 as run_no from events")
def memtable_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch that each write goes to."""
    return rotation.rotate(change_log(spark, sf_dir), RUN_WRITES).select("seq", "write_no", "run_no")


@query(f"""with {_LOG}, numbered as (select *, (row_number() over (order by seq) - 1) // 1000 as run_no from log),
last_of as (select *, row_number() over (partition by run_no, key order by seq desc) as r, count(*) over (partition by run_no) as writes from numbered)
select run_no, max(writes) as writes, count(*) as distinct_keys, count(*) filter (where deleted) as tombstones, min(key) as min_key, max(key) as max_key, max(seq) as max_seq from last_of where r = 1 group by run_no""")
def flush_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each flushed run holds."""
    writes = rotation.rotate(change_log(spark, sf_dir), RUN_WRITES)
    runs = writes.groupBy("run_no", "key").agg(F.count("*").alias("n"), F.max_by("deleted", "seq").alias("deleted"), F.max("seq").alias("seq"))
    return runs.groupBy("run_no").agg(
        F.sum("n").alias("writes"), F.count("*").alias("distinct_keys"), F.count_if("deleted").alias("tombstones"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.max("seq").alias("max_seq")
    )


@query("""with recursive step as (
  select t as threshold, 0 as flushes, 0 as runs from (values (1), (2), (4), (10)) v(t)
  union all select threshold, flushes + 1, case when runs + 1 >= threshold then 1 else runs + 1 end from step where flushes < (select (count(*) + 99) // 100 from events))
select cast(threshold as bigint) as threshold, cast(flushes as bigint) as flushes, cast(runs as bigint) as runs from step""")
def compaction_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs left after each flush of batches of 100 writes, for several thresholds; the SQL steps through them."""
    flushes = change_log(spark, sf_dir).agg(F.explode(F.sequence(F.lit(0), F.ceil(F.count("*") / 100))).alias("flushes"))
    both = flushes.withColumn("threshold", F.explode(F.array(*(F.lit(t).cast("long") for t in (1, 2, 4, 10)))))
    return both.select("threshold", F.col("flushes").cast("long").alias("flushes"), rotation.runs_after(F.col("flushes"), F.col("threshold")).alias("runs"))


@query("""with n as (select (count(*) + 999) // 1000 as f from events)
select 'before' as state, (select string_agg('data-' || i || '.sst', ',' order by i) from range((select f from n)) r(i)) as paths, f as next_run from n
union all select 'after', 'compact-' || f || '.sst', f + 1 from n""")
def manifest_after_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered runs and the next number, before and after a merge."""
    runs = rotation.rotate(change_log(spark, sf_dir), RUN_WRITES).agg((F.max("run_no") + 1).alias("f"))
    names = F.array_join(F.transform(F.sequence(F.lit(0), F.col("f") - 1), lambda i: F.concat(F.lit("data-"), i.cast("string"), F.lit(".sst"))), ",")
    states = F.array(
        F.struct(F.lit("before").alias("state"), names.alias("paths"), F.col("f").alias("next_run")),
        F.struct(F.lit("after").alias("state"), F.concat(F.lit("compact-"), F.col("f").cast("string"), F.lit(".sst")).alias("paths"), (F.col("f") + 1).alias("next_run")),
    )
    return runs.select(F.inline(states))


@query("select event_id // 1000 as run_pos, max(event_id) as max_seq from events group by 1")
def max_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's greatest sequence number."""
    return layered(spark, sf_dir).groupBy(F.col("position").alias("run_pos")).agg(F.max("seq").alias("max_seq"))


@query(f"""with {_LOG}, memory as (select count(distinct key) as pending from log where run_pos = (select max(run_pos) from log))
select (select coalesce(max(seq), 0) + 1 from log) as next_seq, (select count(distinct run_pos) - 1 from log) as runs, pending as pending_keys from memory""")
def recover_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What opening finds when the last batch is still in the log: the next sequence, the runs, and the keys waiting."""
    rows = layered(spark, sf_dir).groupBy("position").agg(F.max("seq").alias("top"), F.count_distinct("key").alias("keys"))
    return rows.agg((F.coalesce(F.max("top"), F.lit(0)) + 1).alias("next_seq"), (F.count("*") - 1).alias("runs"), F.max_by("keys", "position").alias("pending_keys"))


@query(f"with {_LOG} select run_pos, key, seq, value, deleted from (select *, row_number() over (partition by run_pos, key order by seq desc) as r from log) where r = 1")
def run_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of the log, tombstones included."""
    return resolve.latest(layered(spark, sf_dir).drop("tier"), keys=("position", "key")).select(F.col("position").alias("run_pos"), "key", "seq", "value", "deleted")


_PATHS = ("wal-10.log", "dir/wal-2.log", "wal-1.log", "wal-.log", "wal-x.log", "data-1.sst", "wal-7.log.tmp", "wal-+3.log", "wal-007.log")


@query(f"""with p as (select unnest({list(_PATHS)}) as path), s as (select path, try_cast(nullif(regexp_extract(parse_filename(path), '^wal-([+-]?[0-9]+)\\.log$', 1), '') as bigint) as segment_id from p)
select path, segment_id, row_number() over (order by segment_id, path) as place from s where segment_id is not null""")
def wal_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log segments among file names, in numeric order."""
    paths = spark.createDataFrame([(p,) for p in _PATHS], "path string")
    return log.segments(paths).select("path", "segment_id", F.col("place").cast("long").alias("place"))


@query(f"with {_LOG} select key, seq, value, deleted from (select *, row_number() over (partition by key order by seq // 1500 desc, seq % 1500 desc) as r from log) where r = 1")
def wal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that replaying all segments gives."""
    rows = change_log(spark, sf_dir).withColumn("segment_id", F.floor(F.col("seq") / 1500)).withColumn("position", F.col("seq") % 1500)
    return log.replay(rows).select("key", "seq", "value", "deleted")


_MANIFESTS = ((2, "data-1.sst"), (2, "compact-8.sst"), (2, "data-4.sst"), (2, "a-b-9.sst"), (2, "data-x.sst"), (20, "data-1.sst"), (20, "dir/compact-8"))


@query(f"""with m(next_id, path) as (values {", ".join(f"({n}::bigint, '{p}')" for n, p in _MANIFESTS)}),
ids as (select next_id, case when len(string_split(parse_filename(path), '-')) = 2 then try_cast(regexp_replace(string_split(parse_filename(path), '-')[2], '\\.sst$', '') as bigint) end as id from m)
select next_id, greatest(next_id, coalesce(max(id) + 1, next_id)) as safe_id from ids group by next_id""")
def manifest_next_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next run numbers that no listed file has."""
    rows = spark.createDataFrame(list(_MANIFESTS), "next_id long, path string")
    return rows.groupBy("next_id").agg(F.max(snapshot.run_id(F.col("path"))).alias("top")).select("next_id", snapshot.safe_next(F.col("next_id"), F.col("top")).alias("safe_id"))


@query("select doc_id, 17 + strlen(cast(doc_id as varchar)) + coalesce(strlen(text), 0) as size from documents")
def encoded_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document as a record."""
    return documents(spark, sf_dir).select(F.col("seq").alias("doc_id"), layout.encoded_size(F.col("key"), F.col("value")).alias("size"))


def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.blocks(documents(spark, sf_dir).select("run", "key", layout.encoded_size(F.col("key"), F.col("value")).alias("size")), ["run"])


_BLOCKS = f"""with recursive {_DOCS}, numbered as (select run, key, size, row_number() over (partition by run order by key) as i from docs),
walk as (
  select run, i, key, size, cast(0 as bigint) as block_no, cast(4 + size as bigint) as filled from numbered where i = 1
  union all
  select n.run, n.i, n.key, n.size, case when w.filled + n.size > 65536 then w.block_no + 1 else w.block_no end, case when w.filled + n.size > 65536 then 4 + n.size else w.filled + n.size end
  from walk w join numbered n on n.run = w.run and n.i = w.i + 1),
laid as (select run, block_no, min(key) as first_key, count(*) as records, cast(4 + sum(size) as bigint) as raw_bytes from walk group by run, block_no),
placed as (select run, block_no, first_key, cast(coalesce(sum(raw_bytes + 9) over (partition by run order by block_no rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset", raw_bytes + 9 as length from laid)"""


@query(_BLOCKS + " select run, block_no, first_key, records, raw_bytes from laid")
def block_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks that each source's documents are packed into."""
    return _layout(spark, sf_dir)


@query(_BLOCKS + ' select run, block_no, first_key, "offset", length from placed')
def sparse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each block starts and ends."""
    return layout.sparse_index(_layout(spark, sf_dir), ["run"])


@query(_BLOCKS + """, keys as (select cast(c_custkey as varchar) as key from customer), runs as (select distinct run from placed)
select runs.run, keys.key, arg_max(placed.block_no, placed.first_key) as block_no, max(placed.first_key) as first_key
from keys cross join runs left join placed on placed.run = runs.run and placed.first_key <= keys.key group by runs.run, keys.key""")
def index_floor_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block of every run in which each key would stand."""
    index = layout.sparse_index(_layout(spark, sf_dir), ["run"]).select("run", "first_key", "block_no")
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("key"))
    probes = keys.crossJoin(documents(spark, sf_dir).select("run").distinct())
    return layout.floor_lookup(index, probes, ("run",)).select("run", "key", "block_no", "first_key")


@query("select doc_id from (select doc_id, text, lag(text) over (order by doc_id) as before from documents) where before > text")
def unsorted_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text stands before the previous one's: a run in this order would be refused."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("key"))
    return resolve.unsorted(docs, "doc_id", chunk=1 << 12).select("doc_id")


_SIZES, _RATES = (1, 10, 1000, 12345, 1_000_000, 50_000_000), (0.5, 0.1, 0.01, 0.001, 1e-9)


@query(f"""with v as (select n, p from (select unnest({list(_SIZES)}) as n), (select unnest({list(_RATES)}::double[]) as p)),
i as (select cast(n as bigint) as n, p, ceil(-n::double * ln(p) / (ln(2.0) * ln(2.0))) as m from v)
select n, p, cast(ceil(m / 8) * 8 as bigint) as bits, cast(least(greatest(round(m / n * ln(2.0)), 1), 30) as int) as hashes from i""")
def bloom_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of Bloom filters."""
    rows = spark.createDataFrame([(n, p) for n in _SIZES for p in _RATES], "n long, p double")
    return rows.select("n", "p", layout.bloom_bits(F.col("n"), F.col("p")).alias("bits"), layout.bloom_hashes(F.col("n"), F.col("p")).alias("hashes"))


def _rows(columns: str, rows: tuple) -> str:
    return f"v({columns}) as (values {', '.join('(' + ', '.join('null' if x is None else repr(x) for x in r) + ')' for r in rows)})"


_SAVINGS = ((100, 87, 0.13), (100, 80, 0.125), (100, 90, 0.125), (100, 100, 0.0), (100, 110, 0.0), (0, 0, 0.0), (-1, 0, 0.0))


@query(f"""with {_rows("raw, compressed, least", _SAVINGS)} select raw::bigint as raw, compressed::bigint as compressed, least::double as least,
case when raw <= 0 or compressed >= raw then false else (raw - compressed)::double / raw::double >= least::double end as pays from v""")
def should_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a compressed block is kept."""
    rows = spark.createDataFrame(list(_SAVINGS), "raw long, compressed long, least double")
    return rows.select("*", layout.should_compress(F.col("raw"), F.col("compressed"), F.col("least")).alias("pays"))


_OPTIONS = ((0, 1, 0.125, True, 0.01), (65536, 0, 0.0, False, 5.0), (1, 1, -0.1, True, 0.01), (1, 1, 1.0, True, 0.01), (1, 9, 0.5, True, 0.01), (1, 1, 0.5, True, 0.0), (1, 1, 0.5, True, 1.0))


@query(f"""with {_rows("block_size, codec, savings, bloom, fpr", _OPTIONS)} select codec::int as codec, savings::double as savings, bloom, fpr::double as fpr,
case when block_size <= 0 then 65536 else block_size end::bigint as block_size,
case when savings < 0 or savings >= 1 then 'savings' when codec not in (0, 1) then 'codec' when bloom and (fpr <= 0 or fpr >= 1) then 'false positive rate' end as error from v""")
def options_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write options and the first rule they break."""
    rows = spark.createDataFrame(list(_OPTIONS), "block_size long, codec int, savings double, bloom boolean, fpr double")
    size = F.when(F.col("block_size") <= 0, F.lit(layout.DEFAULT_BLOCK_SIZE)).otherwise(F.col("block_size")).cast("long")
    return rows.select("codec", "savings", "bloom", "fpr", size.alias("block_size"), layout.options_error(F.col("codec"), F.col("savings"), F.col("bloom"), F.col("fpr")).alias("error"))


_FOOTERS = (
    (140, "HYPSST", 2, 0, 60, 40, 0, 0), (160, "HYPSST", 2, 0, 60, 40, 100, 20), (39, "HYPSST", 2, 0, 0, 0, 0, 0), (140, "HYPSSX", 2, 0, 60, 40, 0, 0), (140, "HYPSST", 99, 0, 60, 40, 0, 0),
    (140, "HYPSST", 2, 1, 60, 40, 0, 0), (140, "HYPSST", 2, 0, 101, 0, 0, 0), (140, "HYPSST", 2, 0, 60, 41, 0, 0), (140, "HYPSST", 2, 0, 60, 40, 5, 0), (140, "HYPSST", 2, 0, 60, 30, 0, 0),
    (160, "HYPSST", 2, 0, 60, 40, 260, 20), (160, "HYPSST", 2, 0, 60, 40, 100, 160), (160, "HYPSST", 2, 0, 60, 40, 100, 10),
)


@query(f"""with {_rows("size, magic, version, flags, io, il, fo, fl", _FOOTERS)} select size::bigint as size, magic, version::int as version, flags::int as flags, io::bigint as io, il::bigint as il, fo::bigint as fo, fl::bigint as fl,
case when size < 40 then 'file is too small' when magic <> 'HYPSST' then 'magic' when version <> 2 then 'version' when flags <> 0 then 'flags' when io > size - 40 then 'index offset' when il > size - 40 - io then 'index length'
when fl = 0 and fo <> 0 then 'filter offset' when fl = 0 and io + il <> size - 40 then 'index end' when fl <> 0 and fo <> io + il then 'filter offset' when fl <> 0 and fo > size - 40 then 'filter offset'
when fl <> 0 and fl > size - 40 - fo then 'filter length' when fl <> 0 and fo + fl <> size - 40 then 'filter end' end as error from v""")
def footer_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footers and the first rule they break."""
    rows = spark.createDataFrame(list(_FOOTERS), "size long, magic string, version int, flags int, io long, il long, fo long, fl long")
    return rows.select("*", layout.footer_error(*(F.col(c) for c in ("size", "magic", "version", "flags", "io", "il", "fo", "fl"))).alias("error"))


_HEADERS = ((0, 5, 5, 10), (1, 3, 0, 3), (128, 1, 1, 2), (0, 65537, 1, 99999), (0, 65536, 1, 99999), (0, 1, 67108865, 99999999), (0, 10, 10, 5), (128, 65537, 67108865, 0))


@query(f"""with {_rows("flags, k, v, remaining", _HEADERS)} select flags::int as flags, k::bigint as k, v::bigint as v, remaining::bigint as remaining,
case when flags & 254 <> 0 then 'flags' when k > 65536 then 'key length' when v > 67108864 then 'value length' when k + v > remaining then 'payload is short' end as error from v""")
def record_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record headers and the first rule they break."""
    rows = spark.createDataFrame(list(_HEADERS), "flags int, k long, v long, remaining long")
    return rows.select("*", layout.record_error(F.col("flags"), F.col("k"), F.col("v"), F.col("remaining")).alias("error"))


@query()
def bloom_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which customer numbers may be among the document keys."""
    probes = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("key"))
    return udfs.may_contain(documents(spark, sf_dir).select("key"), probes, layout.DEFAULT_FPR)


@query()
def bloom_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored Bloom filter of every run's keys."""
    return udfs.filters_by_run(documents(spark, sf_dir).select("run", "key"), "run", layout.DEFAULT_FPR)


@query(f"with {_LOG} select key, seq, value, deleted from log")
def record_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log through the binary record format and back."""
    rows = change_log(spark, sf_dir).withColumn("value", F.col("value").cast("binary"))
    return udfs.decoded_records(udfs.encoded_records(rows)).select("key", "seq", F.col("value").cast("string").alias("value"), "deleted")


@query("select cast(doc_id as varchar) as key, doc_id as seq, coalesce(text, '') as value, doc_id // 16 as block from documents")
def block_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through compressed, checksummed blocks of 16 and back."""
    rows = documents(spark, sf_dir).withColumn("value", F.col("value").cast("binary")).withColumn("block", F.floor(F.col("seq") / 16))
    return udfs.decoded_blocks(udfs.encoded_blocks(rows, "block")).select("key", "seq", F.col("value").cast("string").alias("value"), "block")


_LAST_OF_RUN = "kept as (select * from (select *, row_number() over (partition by run_pos, key order by seq desc) as r from log) where r = 1)"


def _run_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary file of each run of the change log, with small blocks."""
    runs = resolve.latest(layered(spark, sf_dir).drop("tier"), keys=("position", "key"))
    return run_file.run_files(runs, "position", WriteOptions(block_size=4096))


@query(f"with {_LOG}, {_LAST_OF_RUN} select run_pos, key, seq, value, deleted from kept")
def run_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run through a binary file with blocks, index, filter and footer, and back."""
    rows = run_file.run_records(_run_parts(spark, sf_dir))
    return rows.select(F.col("run").alias("run_pos"), "key", "seq", F.col("value").cast("string").alias("value"), "deleted")


@query(f"""with {_LOG}, {_LAST_OF_RUN}, runs as (select distinct run_pos from log), keys as (select cast(n_nationkey as varchar) as key from nation)
select runs.run_pos, keys.key, case when not deleted then seq end as seq, case when kept.key is null then 'absent' when deleted then 'deleted' else 'live' end as status
from runs cross join keys left join kept on kept.run_pos = runs.run_pos and kept.key = keys.key""")
def run_file_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation numbers looked up in every run's file through its filter and index."""
    keys = [r["key"] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("key")).collect()]  # 25 rows
    return run_file.run_seek(_run_parts(spark, sf_dir), keys).select(F.col("run").alias("run_pos"), "key", "seq", "status")


@query("select c_custkey, cast(c_custkey as varchar) as key from customer where c_custkey in (select doc_id from documents)")
def bloom_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer numbers among the document keys: those that the filter lets through, checked; a key that it lost would be missing."""
    docs = documents(spark, sf_dir).select("key")
    passed = bloom_membership(spark, sf_dir).filter("may_contain").join(docs, "key", "left_semi")
    return passed.select(F.col("key").cast("long").alias("c_custkey"), "key")


@query("""with n as (select source as run, count(*) as n_keys from documents group by source), i as (select run, n_keys, ceil(-n_keys::double * ln(0.01::double) / (ln(2.0) * ln(2.0))) as m from n)
select run, n_keys, cast(ceil(m / 8) * 8 as bigint) as bits, cast(least(greatest(round(m / n_keys * ln(2.0)), 1), 30) as int) as hashes, cast(12 + ceil(m / 8) as bigint) as bytes from i""")
def bloom_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and shape of every run's stored filter."""
    return bloom_codec(spark, sf_dir).select("run", "n_keys", "bits", "hashes", F.octet_length("encoded").cast("long").alias("bytes"))


# ---------------------------------------------------------------- the store itself

_STORE_BATCHES = 4
_NUMBERED = """log as (select cast(user_id as varchar) as key, row_number() over (order by event_id) as seq, props as value, event_type = 'error' as deleted from events),
newest as (select * from (select *, row_number() over (partition by key order by seq desc) as rn from log) where rn = 1)"""


def _filled(spark: SparkSession, sf_dir: str) -> Store:
    """A store that got the change log in batches: flushed twice, with the last batches still in its log."""
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", max_writes=1 << 62)
    log_rows = change_log(spark, sf_dir)
    low, high = log_rows.agg(F.coalesce(F.min("seq"), F.lit(0)), F.coalesce(F.max("seq"), F.lit(0))).first()
    place = F.floor((F.col("seq") - low) * _STORE_BATCHES / F.lit(high - low + 1))
    for k in range(_STORE_BATCHES):
        store.write(log_rows.filter(place == k), order="seq")
        if k < 2:
            store.flush()
    return store


@query(f"with {_NUMBERED} select key, seq, value from newest where not deleted")
def store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live rows of a store with two runs and a log."""
    return _filled(spark, sf_dir).scan().select("key", "seq", F.col("value").cast("string").alias("value"))


@query(f"""with {_NUMBERED}, keys as (select cast(c_custkey as varchar) as key from customer)
select keys.key, seq, case when newest.key is null then 'absent' when deleted then 'deleted' else 'live' end as status, (select count(*) + 1 from log) as next_seq from keys left join newest on keys.key = newest.key""")
def store_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys looked up in the store after it was closed and opened anew, and the next sequence number it found."""
    first = _filled(spark, sf_dir)
    first.close()
    store = Store(spark, first.folder.root, max_writes=1 << 62)
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("key"))
    return store.multi_get(keys).select("key", "seq", "status", F.lit(store.snapshot.next_seq).cast("long").alias("next_seq"))


@query(f"with {_NUMBERED} select key, seq, value, deleted, 0 as position, 1 as runs from newest where not deleted")
def store_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store holds after its log was flushed and all runs were merged: one run without tombstones."""
    store = _filled(spark, sf_dir)
    store.flush()
    store.compact()
    store.vacuum()
    rows = store.versions().select("key", "seq", F.col("value").cast("string").alias("value"), "deleted", F.col("position").cast("int").alias("position"))
    return rows.withColumn("runs", F.lit(len(store.snapshot.runs)))
